import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tidemark.llm import quality_model as q
from tidemark.llm.common import crc_mod


def plain_ftrl(rows, labels, epochs=6, alpha=1.0, beta=1.0, l1=1e-3, l2=1e-3):
    """The same updates one feature at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(s):
        if abs(z[s]) <= l1:
            return 0.0
        return (math.copysign(l1, z[s]) - z[s]) / ((beta * 0.05 + math.sqrt(n[s])) / alpha + l2)

    for _ in range(epochs):
        for x, y in zip(rows, labels):
            w = {s: weight(s) for s in x}
            margin = max(-30, min(30, 10 * sum(w[s] * v for s, v in x.items())))
            for s, v in x.items():
                g = (1 / (1 + math.exp(-margin)) - y) * v
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / alpha * w[s]
                n[s] += g * g
    return {s: weight(s) for s in z}


def counted(text):
    """Shares of a text's slots, and the intercept."""
    slots = [int(s) for part, _ in q.features([text]) for s in part]
    x = defaultdict(float)
    for s in slots:
        x[s] += 1 / len(slots)
    x[q.BIAS] = 0.2
    return dict(x)


def test_weights_are_those_of_a_plain_loop():
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 40 if i % 2 else 60, 30)).encode() for i in range(60)] + [b"", b"same same same"]
    labels = [i % 2 for i in range(62)]
    want = plain_ftrl([counted(t) for t in texts], labels)
    got = q.train_shard(texts, labels)
    assert all(abs(got[s] - w) < 1e-9 for s, w in want.items()) and set(np.flatnonzero(got)) <= set(want)
    scores = q.score_texts(texts, got)
    plain = [1 / (1 + math.exp(-10 * sum(want.get(s, 0) * v for s, v in counted(t).items()))) for t in texts]
    assert np.allclose(scores, plain)


def test_n_grams_of_whole_texts(monkeypatch):
    """Unigrams, bigrams and equal neighbours are counted; a text cut at white space has the same slots as the whole."""
    text = b"a b b c " * 50 + b"end"
    slots = np.concatenate([s for s, _ in q.features([text])])
    assert len(slots) == 201 + 200 + 50 and (slots == q.SAME).sum() == 50
    pieces = q.pieces
    monkeypatch.setattr(q, "pieces", lambda texts: pieces(texts, 17))
    cut = np.concatenate([s for s, _ in q.features([b"x y", text, b""])])
    assert sorted(cut) == sorted(np.concatenate([slots, *(s for s, _ in q.features([b"x y"]))]))


def test_mean_of_shards_counts_every_document(spark, monkeypatch):
    """A shard without weights is part of the divisor."""
    monkeypatch.setattr(q, "train_shard", lambda texts, labels: np.eye(1, q.BIAS + 1, 5)[0] * (len(texts) > 3))
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    own = [r["n"] for r in docs.where(crc_mod("doc_id", 4) != 2).groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(q.SHARDS))).agg(F.count("*").alias("n")).collect()]
    assert any(n <= 3 for n in own)
    assert abs(q.train(docs, labels)[5] - sum(n for n in own if n > 3) / sum(own)) < 1e-12


def test_held_out_documents_and_odd_rows(spark, docs, labels, odd, none):
    got = {r["doc_id"]: r for r in q.classify(docs, labels).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(got[i]["score"], y) for i, y in known.items() if got[i]["held_out"]]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in held for b, z in held if y > z]
    assert sum(pairs) / len(pairs) > 0.9
    odd = odd.withColumn("score", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("quality", F.lit("clash"))
    rows = q.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] in (0, 1, 2)]
    assert len(set(same)) == 1 and {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert q.keep_good(odd, labels).columns == odd.columns and q.classify(none, labels).count() == q.keep_good(none, labels).count() == 0
    nothing = labels.where("false")
    assert {r["score"] for r in q.classify(odd, nothing).collect()} == {0.5} and q.keep_good(odd, nothing).count() == 0
    strange = labels.selectExpr("doc_id", "7 as quality").unionByName(labels.selectExpr("cast(null as long) as doc_id", "1 as quality"))
    assert {r["score"] for r in q.classify(odd, strange).collect()} == {0.5}
