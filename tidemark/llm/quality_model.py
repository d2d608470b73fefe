"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, crc_mod, hashed_words, mix, pieces

BITS = 18
#: Most labelled documents that training reads; the smallest by a hash of their id are taken.
MAX_TRAIN_DOCS = 16_000
SHARDS = 8
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: Slots of weights besides the hashed ones: the same word twice running, and the intercept.
SAME, BIAS = 1 << BITS, (1 << BITS) + 1


def features(texts: list[bytes]):
    """For groups of whole texts: slots of unigrams and bigrams, and the index of the text of each; a bigram of equal words also has SAME."""
    carry: dict[int, np.uint64] = {}
    for group in pieces(texts):
        h, local = hashed_words(group)
        index = np.array([i for i, _, _ in group], np.int64)
        doc = index[local]
        pair = doc[1:] == doc[:-1]
        a, b, d = h[:-1][pair], h[1:][pair], doc[1:][pair]
        for k, (i, _, cont) in enumerate(group):  # the pair across a cut of a long text
            own = np.flatnonzero(local == k) if cont or k == len(group) - 1 else ()
            if cont and i in carry and len(own):
                a, b, d = np.append(a, carry[i]), np.append(b, h[own[0]]), np.append(d, i)
            if len(own):
                carry = {i: h[own[-1]]}
        same = d[a == b]
        slots = np.concatenate([h, mix(a * _PAIR + b)]) >> np.uint64(64 - BITS)
        yield np.concatenate([slots.astype(np.int64), np.full(len(same), SAME)]), np.concatenate([doc, d, same])


def train_shard(texts: list[bytes], labels: list[int], epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Weights after FTRL-proximal passes over the documents in the given order."""
    rows = []
    for i, t in enumerate(texts):
        slots = np.concatenate([s for s, _ in features([t])] or [np.zeros(0, np.int64)])
        slot, n = np.unique(slots, return_counts=True)
        rows.append((np.append(slot, BIAS), np.append(n / max(1, len(slots)), 0.2)))
    z, g2 = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(s):
        return np.where(np.abs(z[s]) <= l1, 0.0, (np.sign(z[s]) * l1 - z[s]) / ((beta * 0.05 + np.sqrt(g2[s])) / alpha + l2))

    for _ in range(epochs):
        for (s, x), y in zip(rows, labels):
            w = weights(s)
            g = (1 / (1 + np.exp(-np.clip(w @ x * 10, -30, 30))) - y) * x
            z[s] += g - (np.sqrt(g2[s] + g * g) - np.sqrt(g2[s])) / alpha * w
            g2[s] += g * g
    return weights(np.arange(BIAS + 1))


def train(docs: DataFrame, labels: DataFrame, holdout: int = 4, held: int = 2, max_docs: int = MAX_TRAIN_DOCS) -> np.ndarray:
    """Weights from labelled documents whose crc32(doc_id) mod holdout isn't held: the mean of SHARDS models, weighted by documents.

    Labels other than 0 and 1 and null ids are left out. Without any label of one of the two kinds the intercept decides.
    """
    own = labels.where("quality in (0, 1) and doc_id is not null").where(crc_mod("doc_id", holdout) != held)
    sample = own.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    rows = rows.withColumn("shard", F.pmod("h", F.lit(SHARDS)).cast("int"))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
        order = np.random.default_rng(1).permutation(t.num_rows)
        texts, y = byte_texts(t["text"].combine_chunks()), t["quality"].to_pylist()
        w = train_shard([texts[i] for i in order], [y[i] for i in order])
        slot = np.union1d(np.flatnonzero(w), [BIAS])  # a shard reports its documents even if all its weights are zero
        return pa.table({"slot": pa.array(slot, pa.int32()), "sum": pa.array(w[slot] * t.num_rows), "n": pa.array(np.where(np.arange(len(slot)) == 0, t.num_rows, 0), pa.int64())})

    found = rows.groupBy("shard").applyInArrow(fit, "slot int, sum double, n long").groupBy("slot").agg(F.sum("sum").alias("s"), F.sum("n").alias("n")).toPandas()
    w = np.zeros(BIAS + 1)
    w[found.slot.to_numpy(int)] = found.s.to_numpy() / max(1, int(found.n.sum()))
    return w


def score_texts(texts: list[bytes], w: np.ndarray) -> np.ndarray:
    """Sparse dot products of the texts' n-gram shares with the weights, as probabilities."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for slots, doc in features(texts):
        total += np.bincount(doc, w[slots], len(texts))
        n += np.bincount(doc, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip((total / np.maximum(n, 1) + 0.2 * w[BIAS]) * 10, -30, 30)))


def scorer(spark, w: np.ndarray):
    """Column function text -> score; the weights (2 MB at most) are broadcast."""
    shared = spark.sparkContext.broadcast(w.astype(np.float32))

    def score(text: pa.Array) -> pa.Array:
        return pa.array(score_texts(byte_texts(text), shared.value), pa.float64())

    return lambda c: F.arrow_udf(score, "double")(c.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, holdout: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Null and empty texts score by the intercept alone. Repeated rows are scored alike, null ids keep a null id
    (and aren't held out), no rows give no rows; other columns are ignored.
    """
    w = train(docs, labels, holdout, held)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", holdout) == held).alias("held_out"), scorer(docs.sparkSession, w)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score threshold or more, with all their columns, rows and texts as they were; any column names.

    Null and empty texts score by the intercept alone. No rows give no rows; without labels the score is 0.5, so that no document reaches the threshold.
    """
    return docs.where(scorer(docs.sparkSession, train(docs, labels))(F.col("text")) >= threshold)
