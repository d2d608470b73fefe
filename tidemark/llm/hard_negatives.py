"""Hard negatives by a distributed kNN join over Voronoi cells.

Vectors become whole numbers. A row x is a candidate at (x, sqrt(M - |x|^2)), M being the largest squared length, and an anchor q asks at (q, 0): then the distance d of
the two says all about the inner product, which is (|q|^2 + M - d^2) / 2. Pivots come from a bounded sample. Each candidate lies in the cell of its nearest pivot,
each anchor in the group of the pivot that is nearest once its last coordinate is zero too. Three joins follow, each of matrices of a block of anchors and a slice of candidates:

1. an anchor meets the cell of its own pivot; the last of its best rows of the same label bounds what can still be among them;
2. candidates of other cells go to those groups alone that they might serve by the bounds, and the positives are settled;
3. candidates go to the groups that they might serve as negatives, by the window of scores that the group's positives leave.

The bounds are exact, so nothing is lost; vectors without clusters give bounds that exclude nothing, and then every candidate meets every anchor once. Blocks and slices are dealt by
a hash of the row, so neither a label nor a cell that holds most of the rows makes a large task. What the driver and each task hold of the whole is a row a pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import first_of, materialize

#: Anchors in a block, candidates in a slice, most pivots and most rows of the sample they come from.
BLOCK, SLICE, MOST_PIVOTS, SAMPLE = 1024, 512, 1024, 8192
_LIMIT = (1 << 63) - 1


def relabelled(label: Column, vec_id: Column) -> Column:
    """The label that the report uses: shifted by one within ten classes for ids divisible by 7."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter lists are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), pa.float64()))


def products(a: np.ndarray, b: np.ndarray, factor: int = 100) -> np.ndarray:
    """Inner products of whole-numbered rows, exact also when multiplied by factor: of doubles where these hold them, else of Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most * factor < 2**53:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)))


def longs(scores) -> pa.Array:
    """Scores as 64-bit numbers, capped at their range."""
    return pa.array([max(-_LIMIT, min(_LIMIT, int(s))) for s in scores], pa.int64())


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Candidates with the coordinate that makes them equally long."""
    return np.hstack([v, np.sqrt(np.maximum(0.0, most - (v * v).sum(1, keepdims=True)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and b."""
    with np.errstate(all="ignore"):
        return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def pivots_of(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """n centres of the sample by a few rounds of k-means, begun at evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds if n > 1 else 0):
        near = distances(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n_near = np.bincount(near, minlength=n)[:, None]
        centres = np.where(n_near > 0, sums / np.maximum(n_near, 1), centres)
    return centres


def whole_rows(embeddings: DataFrame) -> DataFrame:
    """uid, vec_id, label and v (whole numbers as doubles) of the rows that take part, written once."""
    x = F.transform("embedding", lambda e: e.cast("double") * 256)
    odd = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("v")).where("vec_id is not null and label is not null and v is not null").where(~odd)
    # floor() of Spark gives longs, which large numbers don't fit
    return materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", relabelled(F.col("label"), F.col("vec_id")).alias("label"), "v").mapInArrow(_floored, "uid long, vec_id long, label long, v array<double>"))


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b["v"]
        values = pc.floor(v.flatten())
        sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b["uid"], b["vec_id"], b["label"], pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)], names=["uid", "vec_id", "label", "v"])


def placed(rows: DataFrame, centres: np.ndarray, most: float, is_anchor: Column) -> DataFrame:
    """Rows with v of one width, the cell of their nearest pivot and, for anchors, their group, distance to its pivot and squared length; written once."""
    width, shared = centres.shape[1] - 1, rows.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        for b in batches:
            v = matrix(b["v"], width)
            asks = np.array(b["asks"].to_pylist(), bool)
            cell = distances(lifted(v, most), shared.value).argmin(1) if len(v) else np.zeros(0, int)
            far = distances(v, shared.value[:, :-1])
            group = far.argmin(1) if len(v) else cell
            yield pa.RecordBatch.from_arrays(
                [b["uid"], b["vec_id"], b["label"], lists(v), pa.array(cell, pa.int32()), pa.array(group, pa.int32(), mask=~asks), pa.array(far[np.arange(len(v)), group], mask=~asks), pa.array((v * v).sum(1), mask=~asks)],
                names=["uid", "vec_id", "label", "v", "cell", "group", "away", "square"],
            )

    out = rows.withColumn("asks", is_anchor).mapInArrow(place, "uid long, vec_id long, label long, v array<double>, cell int, group int, away double, square double")
    return materialize(out)


def served(candidates: DataFrame, anchors: DataFrame, centres: np.ndarray, most: float, beyond_home: bool) -> DataFrame:
    """Candidates with the group, a row for each that they might serve. anchors have lo and hi, the least and the largest score that an answer can have (null: no bound)."""
    # the distance of a score; greatest() passes over nulls, so that a bound that is missing is dealt with before
    away = lambda s, none: F.when(F.col(s).isNull(), F.lit(none)).otherwise(F.sqrt(F.greatest(F.col("square") + most - 2 * F.col(s), F.lit(0.0))))
    bounds = anchors.groupBy("group").agg(
        F.max("away").alias("widest"), F.min("away").alias("least"), F.max(away("lo", float("inf"))).alias("far"), F.min(away("hi", 0.0)).alias("near")
    ).toPandas()  # a row a pivot at most
    groups = bounds["group"].to_numpy(int)
    asked_at = np.hstack([centres[groups, :-1], np.zeros((len(groups), 1))])
    table = candidates.sparkSession.sparkContext.broadcast((groups, asked_at, *(bounds[c].to_numpy(float) for c in ("widest", "least", "far", "near"))))

    def serve(batches):
        ids, own, widest, least, far, near = table.value
        for b in batches:
            v, home = matrix(b["v"], centres.shape[1] - 1), b["cell"].to_numpy()
            d = distances(lifted(v, most), own)
            slack = 1e-6 * (1 + d + widest + np.where(np.isfinite(far), far, 0))
            out = (np.maximum(d - widest, least - d) > far + slack) | (d + widest < near - slack)  # not a number, from overflow, excludes nothing
            if beyond_home:
                out |= home[:, None] == ids[None]
            row, g = np.nonzero(~out)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b[c].take(row) for c in ("uid", "vec_id", "label", "v")), pa.array(ids[g], pa.int32())], names=["uid", "vec_id", "label", "v", "group"])

    return candidates.select("uid", "vec_id", "label", "v", "cell").mapInArrow(serve, "uid long, vec_id long, label long, v array<double>, group int")


def joined(anchors: DataFrame, candidates: DataFrame, meet, schema: str) -> DataFrame:
    """meet(anchors, candidates) of each block of a group's anchors and each slice of the candidates with that group, in a task group of their own."""
    n = anchors.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_b")).join(candidates.groupBy("group").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("_s")), "group")
    n = F.broadcast(materialize(n))  # a row a pivot at most
    part = lambda c: F.pmod(F.xxhash64("uid"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = anchors.join(n, "group").withColumn("_i", part("_b")).withColumn("_j", every("_s")).drop("_b", "_s")
    right = candidates.join(n, "group").withColumn("_j", part("_s")).withColumn("_i", every("_b")).drop("_b", "_s")
    left, keys = left.select(*[F.col(c).alias(c) for c in left.columns]), ["group", "_i", "_j"]  # columns of its own, as both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def best(scores: np.ndarray, allowed: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the largest allowed score of each row, then of the next, n times; the first column of equals."""
    if not scores.shape[1]:
        return
    left = np.where(allowed, scores, -np.inf)
    for _ in range(n):
        top = left.argmax(1)
        row = np.flatnonzero(left[np.arange(len(left)), top] > -np.inf)
        if not len(row):
            return
        yield row, top[row]
        left[row, top[row]] = -np.inf


def _sides(a: pa.Table, c: pa.Table, width: int):
    c = c.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
    return c, products(matrix(a["v"], width), matrix(c["v"], width)), a["label"].to_numpy()[:, None] == c["label"].to_numpy()[None]


def same_label(width: int, n: int):
    """The n best rows of the anchor's label, the anchor itself left out."""

    def meet(a: pa.Table, c: pa.Table) -> pa.Table:
        c, s, same = _sides(a, c, width)
        found = list(best(s, same & (a["uid"].to_numpy()[:, None] != c["uid"].to_numpy()[None]), n))
        row, col = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))
        return pa.table({"auid": a["uid"].take(pa.array(row)), "uid": c["uid"].take(pa.array(col)), "vec_id": c["vec_id"].take(pa.array(col)), "score": longs(s[row, col])})

    return meet


def in_windows(width: int, n: int, low: int, high: int):
    """The n best rows of other labels for each positive whose score lies in its window."""

    def meet(a: pa.Table, c: pa.Table) -> pa.Table:
        c, s, same = _sides(a, c, width)
        ids, scores = a["positive_ids"].to_pylist(), a["positive_scores"].to_pylist()
        rows: list[tuple] = []
        for k in range(max(map(len, ids), default=0)):
            own = np.array([i for i, x in enumerate(ids) if len(x) > k], int)
            p = np.array([scores[i][k] for i in own], s.dtype)[:, None]
            for row, col in best(s[own], ~same[own] & (low * p <= 100 * s[own]) & (100 * s[own] <= high * p), n):
                rows += [(own[r], k, c_) for r, c_ in zip(row, col)]
        at, k, col = (np.array(x, int) for x in (zip(*rows) if rows else ((), (), ())))
        return pa.table({
            "auid": a["uid"].take(pa.array(at)), "k": pa.array(k, pa.int32()), "anchor_id": a["vec_id"].take(pa.array(at)), "positive_id": pa.array([ids[i][j] for i, j in zip(at, k)], pa.int64()),
            "positive_score": pa.array([scores[i][j] for i, j in zip(at, k)], pa.int64()), "uid": c["uid"].take(pa.array(col)), "negative_id": c["vec_id"].take(pa.array(col)), "negative_score": longs(s[at, col]),
        })

    return meet


def mine(embeddings: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor (a vec_id divisible by every) and each of its positives.

    Positives are the anchor's first n_positives other rows of the same label, negatives the first n_negatives rows of other labels whose score is
    from low to high per cent of the positive's, both by falling integer inner product, equals by vec_id. Rows without vec_id, label or vector, or with a component that is null,
    not a number or not finite once it is multiplied by 256, take no part. Repeated rows are rows of their own, as anchors too. A vector shorter than others counts as filled
    with zeros. An anchor without positives, and a positive without negatives (any below zero), have no rows; no rows give no rows; other columns are ignored. Scores beyond 64
    bits are capped and then tie.
    """
    spark = embeddings.sparkSession
    rows = whole_rows(embeddings)
    is_anchor = F.col("vec_id") % every == 0
    seen = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most"), F.max(F.size("v")).alias("width"), F.count_if(is_anchor).alias("anchors")).first()
    if not seen["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    most, width = float(seen["most"]), int(seen["width"])
    sample = rows.select("v", F.xxhash64("vec_id").alias("h"), "uid").orderBy("h", "uid").limit(SAMPLE).select("v").toPandas()["v"]
    sample = matrix(pa.array([list(v) for v in sample], pa.list_(pa.float64())), width)
    centres = pivots_of(lifted(sample, most), min(MOST_PIVOTS, len(sample), -(-seen["anchors"] // BLOCK) * 2))
    rows = placed(rows, centres, most, is_anchor)
    asking = rows.where("group is not null").select("uid", "vec_id", "label", "v", "group", "away", "square")
    candidates = rows.select("uid", "vec_id", "label", "v", "cell")

    found = "auid long, uid long, vec_id long, score long"
    own = lambda a: a.select("uid", "vec_id", "label", "v", "group")
    order = (F.desc("score"), F.col("vec_id"), F.col("uid"))
    home = joined(own(asking), candidates.withColumnRenamed("cell", "group"), same_label(width, n_positives), found)
    home = materialize(first_of(home, ["auid"], n_positives, "k", *order))
    known = home.where(F.col("k") == n_positives).select(F.col("auid").alias("uid"), F.col("score").cast("double").alias("lo"))
    asked = asking.join(known, "uid", "left").withColumn("hi", F.lit(None).cast("double"))
    others = joined(own(asking), served(candidates, asked, centres, most, beyond_home=True), same_label(width, n_positives), found)
    positives = first_of(home.drop("k").unionByName(others), ["auid"], n_positives, "k", *order).where("score >= 0")
    listed = positives.groupBy("auid").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("p")).select(F.col("auid").alias("uid"), F.col("p.vec_id").alias("positive_ids"), F.col("p.score").alias("positive_scores"))
    window = asking.join(listed, "uid").withColumns({"lo": F.array_min("positive_scores") * (low / 100), "hi": F.array_max("positive_scores") * (high / 100)})
    window = materialize(window)

    schema = "auid long, k int, anchor_id long, positive_id long, positive_score long, uid long, negative_id long, negative_score long"
    met = joined(window.select("uid", "vec_id", "label", "v", "group", "positive_ids", "positive_scores"), served(candidates, window, centres, most, beyond_home=False), in_windows(width, n_negatives, low, high), schema)
    last = first_of(met, ["auid", "k"], n_negatives, "rank", F.desc("negative_score"), F.col("negative_id"), F.col("uid"))
    return last.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid AS auid, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY auid ORDER BY score DESC, vec_id, uid) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.auid, p.uid ORDER BY s.score DESC, s.vec_id, s.uid) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.auid = s.auid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
