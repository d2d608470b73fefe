"""Block vectors: cosine, the change set between two filings, nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.current import first_n

CARRY, CHANGE = 0.97, 0.70


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, taken from the list's flat values; each of length 1 (a zero vector stays)."""
    flat = column.combine_chunks()
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def tiled(left: DataFrame, right: DataFrame, meet, schema: str, size: int, alone: bool = False) -> DataFrame:
    """meet(pair, rows of the left, rows of the right) for every two parts of the sides of each pair, in a task group of their own.

    left and right: pair, id, embedding. A side's parts hold about ``size`` rows, dealt by a hash, so that no group grows with a pair. With alone a pair that has one side only is met too.
    """
    pick = lambda d, side: d.select("pair", "id", "embedding", F.lit(side).alias("side"))
    rows = pick(left, 0).unionByName(pick(right, 1))
    parts = rows.groupBy(F.col("pair").alias("_pair")).agg(*[F.ceil(F.count_if(F.col("side") == k) / size).cast("int").alias(f"_n{k}") for k in (0, 1)])
    parts = parts.withColumns({f"_n{k}": F.greatest(F.lit(1), f"_n{k}") for k in (0, 1)}) if alone else parts.where("_n0 > 0 and _n1 > 0")
    rows = rows.join(parts, rows["pair"].eqNullSafe(parts["_pair"]))
    own = lambda k: F.pmod(F.xxhash64("id", "embedding"), F.col(f"_n{k}")).cast("int")
    every = lambda k: F.sequence(F.lit(0), F.col(f"_n{k}") - 1)
    rows = rows.withColumn("_i", F.explode(F.when(F.col("side") == 0, F.array(own(0))).otherwise(every(0))))
    rows = rows.withColumn("_j", F.explode(F.when(F.col("side") == 1, F.array(own(1))).otherwise(every(1))))

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return meet(key[0], *(t.filter(pc.equal(t["side"], side)).sort_by("id") for side in (0, 1)))

    return rows.select("pair", "_i", "_j", "id", "embedding", "side").groupBy("pair", "_i", "_j").applyInArrow(compare, schema)


def changes(current: DataFrame, prior: DataFrame, pair: str, carry: float = CARRY, change: float = CHANGE, size: int = 1024) -> DataFrame:
    """pair, change_type, current_index, prior_index, similarity of all blocks added, changed or dropped, and those carried.

    current and prior: pair, block_index, embedding. For a current block the best prior decides: at least ``carry`` is carried, at least ``change``
    is changed (against that prior, the lowest index of equals), else it is added. A prior block whose best is below ``change`` is dropped. Several
    current blocks may match one prior. Thresholds hold for the exact value, the output is rounded to 4 places. With one side empty all is
    added or dropped, without similarity. Parts of about ``size`` blocks of either side meet as matrices; the best of each block over all parts decides.
    """
    kind = dict(current.dtypes)[pair]

    def meet(key: pa.Scalar, c: pa.Table, p: pa.Table) -> pa.Table:
        ci, pi = c["id"].to_numpy(), p["id"].to_numpy()
        if len(ci) and len(pi):
            sim = matrix(c["embedding"]) @ matrix(p["embedding"]).T
            match, best = [*pi[sim.argmax(1)].tolist(), *[None] * len(pi)], [*sim.max(1).tolist(), *sim.max(0).tolist()]
        else:
            match = best = [None] * (len(ci) + len(pi))
        n = len(match)
        return pa.table({"pair": pa.array([key.as_py()] * n, key.type), "side": pa.array([0] * len(ci) + [1] * len(pi), pa.int32()), "own": pa.array(np.concatenate([ci, pi]), pa.int64()), "match": pa.array(match, pa.int64()), "best": pa.array(best, pa.float64())})

    pick = lambda d: d.select(F.col(pair).alias("pair"), F.col("block_index").cast("long").alias("id"), "embedding")
    met = tiled(pick(current), pick(prior), meet, f"pair {kind}, side int, own long, match long, best double", size, alone=True)
    top = F.max(F.when(F.col("best").isNotNull(), F.struct("best", (-F.col("match")).alias("m"))))
    best = met.groupBy("pair", "side", "own").agg(top.alias("top")).select("pair", "side", "own", F.col("top.best").alias("best"), (-F.col("top.m")).alias("match"))
    best = best.where((F.col("side") == 0) | F.col("best").isNull() | (F.col("best") < change))
    label = F.when(F.col("side") == 1, "dropped").when(F.col("best") >= carry, "carried").when(F.col("best") >= change, "changed").otherwise("added")
    best = best.withColumn("change_type", label)
    current_index, prior_index = F.when(F.col("side") == 0, F.col("own")), F.when(F.col("side") == 1, F.col("own")).when(F.col("change_type") != "added", F.col("match"))
    return best.select("pair", "change_type", current_index.alias("current_index"), prior_index.alias("prior_index"), F.round("best", 4).alias("similarity"))


def change_counts(rows: DataFrame) -> DataFrame:
    kinds = ("added", "changed", "carried", "dropped")
    return rows.groupBy("pair").agg(*[F.count_if(F.col("change_type") == k).alias(f"{k}_count") for k in kinds])


def nearest(queries: DataFrame, rows: DataFrame, within: str, n: int, size: int = 1024) -> DataFrame:
    """query_id, vec_id, similarity and position of the n most similar other rows with the same value of ``within`` for each query (vec_id, embedding), equals by vec_id.

    Parts of both sides meet as matrices, and a part of rows gives a query its n best alone, so no row stands for a pair of vectors. Null values of ``within`` meet nothing.
    """

    def meet(key: pa.Scalar, q: pa.Table, r: pa.Table) -> pa.Table:
        qi, ri = q["id"].to_numpy(), r["id"].to_numpy()  # sorted, so that the first of equals has the smallest id
        sim = matrix(q["embedding"]) @ matrix(r["embedding"]).T
        sim[qi[:, None] == ri[None]] = -np.inf
        at = []
        for _ in range(min(n, len(ri))):
            best = sim.argmax(1)
            value = sim[np.arange(len(qi)), best]
            keep = np.flatnonzero(value > -np.inf)
            at.append((qi[keep], ri[best[keep]], value[keep]))
            sim[np.arange(len(qi)), best] = -np.inf
        a, b, s = (np.concatenate(x) for x in zip(*at))
        return pa.table({"query_id": a, "vec_id": b, "similarity": s})

    pick = lambda d: d.where(F.col(within).isNotNull() & F.col("embedding").isNotNull()).select(F.col(within).alias("pair"), F.col("vec_id").cast("long").alias("id"), "embedding")
    near = tiled(pick(queries), pick(rows), meet, "query_id long, vec_id long, similarity double", size)
    return first_n(near, ["query_id"], n, F.desc("similarity"), F.col("vec_id"), rank="position")
