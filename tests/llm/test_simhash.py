from collections import Counter

import numpy as np
import pytest
import xxhash
from tidemark.llm import queries, simhash
from against_sql import DATA


def brute(rows):
    """The contract word for word, with all pairs."""
    out = []
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
        w = [x for x in low.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if x]
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        out.append((doc, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    fps = list({f for _, f in out})
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                group[root(a)] = root(b)
    least = {}
    for doc, f in out:
        if doc is not None:
            least[root(f)] = min(doc, least.get(root(f), doc))
    return Counter((doc, f"{f:016x}", least.get(root(f))) for doc, f in out)


def test_same_as_brute_force(spark, docs, odd):
    from pyspark.sql import functions as F

    odd = odd.select(F.when(F.length("text") < 20_000, F.col("text")).alias("text"), "doc_id")  # the brute force is slow
    for rows in (docs, odd):
        got = Counter(tuple(r) for r in simhash.near_duplicates(rows).select("doc_id", "fingerprint", "component_id").collect())
        assert got == brute([(r["doc_id"], r["text"]) for r in rows.collect()])


def test_dense_groups_and_chains(spark):
    """Fingerprints around a few centres: all links within 2 bits, over chains, as brute force finds them."""
    r = np.random.default_rng(5)
    fps = {0, (1 << 64) - 1}
    for centre in r.integers(0, 1 << 63, 8).tolist():
        for _ in range(120):
            f = centre
            for bit in r.integers(0, 64, r.integers(0, 5)).tolist():
                f ^= 1 << bit
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.exact_links(spark.createDataFrame([(s,) for s in signed], "fp long"), 2).collect()
    want = {i: i for i in fps}
    have = {i: i for i in fps}

    def root(of, f):
        while of[f] != f:
            f = of[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                want[root(want, a)] = root(want, b)
    for e in edges:
        a, b = e["a"] % (1 << 64), e["b"] % (1 << 64)
        assert (a ^ b).bit_count() <= 2
        have[root(have, a)] = root(have, b)
    key = lambda of: Counter(frozenset(x for x in fps if root(of, x) == g) for g in {root(of, f) for f in fps})
    assert key(want) == key(have)
    with pytest.raises(ValueError):
        simhash.exact_links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_no_rows(spark, none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd).collect()
    ids = [r["doc_id"] for r in kept]
    assert 4 in ids and 5 not in ids and ids.count(3) == 1 and ids.count(None) == 1 and 0 in ids and 1 not in ids and 2 not in ids
    assert set(kept[0].asDict()) == set(odd.columns)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_keep_one_against_jaccard(spark):
    """On texts with copies at known distances: what is at 0.85 or more goes, what is under 0.6 stays."""
    r = np.random.default_rng(2)
    base = [[f"w{x}" for x in r.integers(0, 5000, 400)] for _ in range(40)]
    rows, far = [], []
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
        close, distant = list(w), list(w)
        close[200] = "changed"
        for p in range(0, 400, 12):
            distant[p] = f"z{p}"
        rows += [(100 + i, " ".join(close)), (200 + i, " ".join(distant))]
        sh = lambda t: {tuple(t[j : j + 5]) for j in range(len(t) - 4)}
        assert jaccard(sh(w), sh(close)) > 0.95 and jaccard(sh(w), sh(distant)) < 0.6
        far.append(200 + i)
    kept = {x["doc_id"] for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(40)) | set(far)


def test_query_covers_all_documents(spark, docs):
    assert queries.op5_simhash(spark, DATA).count() == docs.count()


def test_wide_links_compares_large_nodes_whole(spark):
    """One node of 5,000 fingerprints, cut into many blocks, whose only links are between distant ranks."""
    r = np.random.default_rng(8)
    fps = r.integers(0, 256, (5000, 32), np.uint8)
    mask = np.random.default_rng(1000).choice(256, 8, replace=False)
    for i in mask.tolist():
        fps[:, i // 8] &= 255 - (128 >> i % 8)
    free = np.setdiff1d(np.arange(256), mask)
    fps[2500:] = fps[:2500]
    for row in range(2500, 5000):
        for i in r.choice(free, 30, replace=False).tolist():
            fps[row, i // 8] ^= 128 >> i % 8
    reps = spark.createDataFrame([(i, x.tobytes(), None) for i, x in enumerate(fps)], "id long, fp binary, label long")
    got = [(e["a"], e["b"]) for e in simhash.wide_links(reps, 256, 48, 1, 8, chunk=300).collect()]
    assert sorted(got) == [(i, i + 2500) for i in range(2500)]
    assert sorted((e["a"], e["b"]) for e in simhash.wide_links(reps.where("id % 5 = 0"), 256, 48, 3, 8).collect()) == [(i, i + 2500) for i in range(0, 2500, 5)]


def test_keep_one_decides_by_exact_sets(spark):
    """Copies at 0.76 to 0.84: just those at 0.8 or more go, also where a passage often repeated makes fingerprints of all shingles alike or unlike."""
    r = np.random.default_rng(5)
    sh = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    rows, want = [], set()
    for i in range(120):
        w = [f"w{x}" for x in r.integers(0, 9000, 300)]
        edits = 5 + i % 4
        close = list(w)
        for p in range(20, 20 + 30 * edits, 30):
            close[p] = f"z{p}"
        if i % 3 == 0:
            close += [f"p{x}" for x in range(6)] * 100
        rows += [(i, " ".join(w)), (1000 + i, " ".join(close))]
        want |= {i} | ({1000 + i} if jaccard(sh(w), sh(close)) < 0.8 else set())
    for i in range(40):
        passage = [f"q{i}x{x}" for x in range(9)] * 60
        a, b = ([f"{i}{c}{x}" for x in range(80)] for c in "ab")
        rows += [(2000 + i, " ".join(passage + a)), (3000 + i, " ".join(passage + b))]
        want |= {2000 + i, 3000 + i}
    assert 120 < len(want & set(range(2000))) < 240
    kept = {x["doc_id"] for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == want


def test_a_crowded_group_gives_few_pairs_and_loses_no_link(spark):
    """A large group of near copies, a chain that hangs on it, and texts that are within the radius but not similar enough."""
    r = np.random.default_rng(9)
    sh = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    base = [f"w{x}" for x in r.integers(0, 9000, 200)]

    def changed(w, n):
        w = list(w)
        for p in r.choice(np.arange(0, 200, 10), n, replace=False).tolist():
            w[p] = f"z{r.integers(0, 10**9)}"
        return w

    texts = [changed(base, n) for n in [1] * 300 + [4] * 60 + [8] * 60]
    for _ in range(5):
        texts.append(changed(texts[-1], 2))
    sets = [sh(w) for w in texts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    want = {root(i) for i in range(len(texts))}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.keep_one(docs).collect()} == want and 1 < len(want) < 100
    fps = spark.createDataFrame([(i, simhash.majority(simhash.shingle_hashes(" ".join(w).encode(), 5), 4), i) for i, w in enumerate(texts[:300])], "id long, fp binary, label long")
    got = simhash.wide_links(fps, 256, 62, 28, 8, most=4).collect()
    assert sum(x["a"] is not None for x in got) < 10_000 and any(x["t"] is not None for x in got)
