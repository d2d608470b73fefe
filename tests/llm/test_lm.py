import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tidemark.llm import lm


def test_score_is_that_of_single_steps_with_1024_known_words():
    r = np.random.default_rng(4)
    counts = np.sort(r.integers(1, 1000, 1500))[::-1].astype(float)
    v = lm.Vocabulary([lm.END] + [b"w%d" % i for i in range(1499)], counts, int(counts.sum()), 1500)
    assert v.known == 1024 and v.n_classes == 32 and lm.HIDDEN == 16
    w, n = lm.start_weights(v), lm.HIDDEN
    texts = [" ".join(f"w{i}" for i in r.integers(0, 1600, size)).encode() for size in (0, 1, 7, 90)]
    got = lm.score(w, v, [v.encode(t)[0] for t in texts])
    sig = lambda a: 1 / (1 + np.exp(-a))
    for text, have in zip(texts, got):
        h, before, want = np.zeros(n), v.known + 2, 0.0
        for y in v.encode(text)[0].tolist():
            a = w["X"][before]
            zr = sig(a[: 2 * n] + h @ w["Uzr"])
            h = h + zr[:n] * (np.tanh(a[2 * n :] + (zr[n:] * h) @ w["Un"]) - h)
            c = v.word_class[y] if y < v.known else v.n_classes
            p = np.exp(h @ w["Wc"] + w["bc"])
            want += np.log10(p[c] / p.sum())
            if y < v.known:
                own = np.flatnonzero(v.word_class == c)
                q = np.exp(h @ w["Ww"][:, own] + w["bw"][own])
                want += np.log10(q[own == y][0] / q.sum())
            before = y if y < v.known else v.known if y < v.n_words else v.known + 1
        assert abs(have - want) < 1e-3


def small(seed=4, known=60):
    r = np.random.default_rng(seed)
    counts = np.sort(r.integers(1, 50, known))[::-1].astype(float)
    return r, lm.Vocabulary([lm.END] + [b"w%d" % i for i in range(known - 1)], counts, int(counts.sum()), known)


def test_gradients_are_those_of_finite_differences():
    r, v = small()
    w = {k: x.astype(np.float64) for k, x in lm.start_weights(v).items()}
    ids = [r.integers(0, 62, n).astype(np.int32) for n in (9, 5, 7)]
    y, x, s, _ = lm.grid(ids, v, 2)

    def loss():
        states, kept, _ = lm.forward(w, x, s, np.zeros((2, lm.HIDDEN)))
        mask = y.ravel() >= 0
        return states, kept, mask, lm.outputs(w, v, states.reshape(-1, lm.HIDDEN)[mask].astype(np.float64), y.ravel()[mask])[0].sum() * -np.log(10)

    states, kept, mask, _ = loss()
    grads = {k: np.zeros_like(a) for k, a in w.items()}
    _, back = lm.outputs(w, v, states.reshape(-1, lm.HIDDEN)[mask].astype(np.float64), y.ravel()[mask], grads)
    d = np.zeros((mask.size, lm.HIDDEN))
    d[mask] = back
    lm.backward(w, x, s, kept, d.reshape(*y.shape, lm.HIDDEN), grads)
    for k in lm.NAMES:
        for at in r.integers(0, w[k].size, 6).tolist():
            flat, keep = w[k].reshape(-1), w[k].reshape(-1)[at]
            flat[at] = keep + 1e-3
            up = loss()[3]
            flat[at] = keep - 1e-3
            down = loss()[3]
            flat[at] = keep
            assert abs((up - down) / 2e-3 - grads[k].reshape(-1)[at]) < 2e-2 * max(1, abs(grads[k].reshape(-1)[at])), k


def test_a_very_long_document_keeps_the_grid_small():
    r, v = small()
    ids = [r.integers(0, 60, n) for n in [40_000] + [30] * 2000]
    y, *_ = lm.grid(ids, v, lm.width(ids, 1024, 64))
    assert y.size <= 3.2 * sum(map(len, ids)) and (y >= 0).sum() == sum(map(len, ids))


def test_frequent_words(spark):
    rows = [(b"a%d" % i, i // 3 + 1) for i in range(300)]
    counts = spark.createDataFrame(rows, "word binary, c long")
    want = sorted(((w, c) for w, c in rows), key=lambda x: (-x[1], x[0]))
    for most in (300, 299, 40, 0):
        words, c = lm.frequent(counts, most)
        assert len(words) <= most and list(zip(words, c)) == [(w, float(n)) for w, n in want[: len(words)]]
        assert len(words) >= most - 8 if most < 300 else len(words) == 300
    assert lm.frequent(spark.createDataFrame([(b"x", 1), (b"y", 1)], "word binary, c long"), 1)[0] == []


def test_base_figures_and_odd_rows(spark, odd, none):
    """base_score, n_tokens, n_known and train_tokens by the contract's formula; nulls, blanks, repeated rows, long texts, a null id."""
    odd = odd.withColumn("score", F.lit("clash"))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [None]
    c = Counter(x for i, t in rows if not held(i) for x in low(t))
    n, distinct = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(low(t)), sum(x in c for x in low(t)), n, round(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (distinct + 1))) for x in low(t)), 4)) for i, t in rows)
    got = lm.lm_scores(odd).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.lm_scores(none).count() == 0
    alone = next(i for i in range(100) if held(i))
    got = lm.lm_scores(spark.createDataFrame([(alone, "no training rows")], "doc_id long, text string")).collect()
    assert [(r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got] == [(0, 0, 0.0)]


def test_scores_do_not_depend_on_the_layout_and_beat_the_base(spark, docs):
    docs = docs.select("doc_id", "text")
    few, many = ({r["doc_id"]: r for r in lm.lm_scores(docs.repartition(n)).collect()} for n in (2, 16))
    assert max(abs(few[i]["score"] - many[i]["score"]) / abs(few[i]["score"]) for i in few) < 1e-3
    held = [r for r in few.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
