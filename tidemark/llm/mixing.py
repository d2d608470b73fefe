"""Mixing sources to exact target weights by Pfair scheduling: blocks get release times and deadlines, earliest deadline first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Ranges of the order's hash that are numbered on their own; their totals are summed up in the second pass.
BUCKETS = 4096

#: Characters of all named sources up to which they are broadcast; more are joined by an exchange, where adaptive execution splits a hot source.
MOST_BROADCAST = 4 << 20


def parts(weights: dict) -> dict:
    """Whole numbers in exactly the weights' proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def standing(part: list[int], blocks: list[int], at: int) -> list[int]:
    """Blocks of each source that ``schedule`` has placed before slot ``at``, without the slots before it.

    All blocks due by then are placed. Of those released before and due later, one a source at most, a schedule that never waits has placed each, in
    the order of their deadlines, that still finds room: for every slot a up to its release, the blocks released from a on must fit between a and ``at``. Early
    slots needn't be looked at: the shares' sums leave room there for all these blocks, or for as many as slots are free in all.
    """
    total = sum(part)
    done = [min(n, at * p // total) for p, n in zip(part, blocks)]
    open_ = [(-(-(j + 1) * total // part[k]), k, j * total // part[k]) for k, (j, n) in enumerate(zip(done, blocks)) if j < n and j * total // part[k] < at]
    if not open_:
        return done
    free = at - sum(done)

    def roomy(a: int) -> bool:
        least = sum(min(at * p - n * total, p * (at - a)) if j == n else at * p % total for p, n, j in zip(part, blocks, done))
        return least >= min(free, len(open_)) * total

    start = min(r for _, _, r in open_)
    while start > 0 and not roomy(start):
        start = max(0, 2 * start - at)
    released = np.zeros(at - start, np.int64)
    for k, j in enumerate(done):
        first = -(-start * part[k] // total)
        np.add.at(released, np.array([i * total // part[k] - start for i in range(first, j)], np.int64), 1)
    room = np.arange(at - start, 0, -1) - np.cumsum(released[::-1])[::-1]
    for _, k, release in sorted(open_):
        if free and room[: release - start + 1].min() > 0:
            room[: release - start + 1] -= 1
            done[k] += 1
            free -= 1
    return done


def schedule(part: list[int], blocks: list[int], start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, number, release, deadline, slot) of the blocks in the slots from start to end, by earliest deadline first; sources are their places in the lists.

    With w a source's exact share, its j-th block (from 0) is released at floor(j / w) and due by ceil((j + 1) / w). The shares add up to 1, so every
    block meets its deadline: after any number of slots a source that has blocks left is less than one block off its share. Slots of sources that
    have run out stay empty and take no time here. Held at once: one block of each source.
    """
    total, ready, at = sum(part), [], start
    done = standing(part, blocks, start) if start else [0] * len(part)
    coming = [(j * total // part[k], k, j) for k, (j, n) in enumerate(zip(done, blocks)) if j < n]
    heapq.heapify(coming)
    while coming or ready:
        if not ready:
            at = max(at, coming[0][0])
        if end is not None and at >= end:
            return
        while coming and coming[0][0] <= at:
            release, k, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * total // part[k]), k, j, release))
        due, k, j, release = heapq.heappop(ready)
        yield k, j, release, due, at
        at += 1
        if j + 1 < blocks[k]:
            heapq.heappush(coming, ((j + 1) * total // part[k], k, j + 1))


def numbered(rows: DataFrame, group: str, order: list) -> DataFrame:
    """Adds ``n``, each row's number (from 0) in its group: numbers within hash ranges, then prefix sums over the ranges' totals."""
    w = Window.partitionBy(group, "_bucket").orderBy(*order)
    local = materialize(rows.withColumn("_local", F.row_number().over(w) - 1))
    totals = local.groupBy(group, "_bucket").agg(F.count("*").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.withColumn("_base", F.coalesce(before, F.lit(0))).withColumnsRenamed({group: "_g", "_bucket": "_b"}).drop("_t")
    return local.join(base, local[group].eqNullSafe(base["_g"]) & (local["_bucket"] == base["_b"])).withColumn("n", F.col("_base") + F.col("_local"))


def planned(spark: SparkSession, part: dict[str | None, int], blocks: dict[str | None, int], slots: int = 1 << 18, batch: int = 1 << 16) -> DataFrame:
    """p (pool), j, r, d and t (release, deadline and slot) of every block; part and blocks: of each pool.

    Ranges of ``slots`` slots are scheduled apart from each other, each from where the pools stand at its first slot. A task holds the pools and one range's blocks.
    """
    pools = sorted(blocks, key=lambda p: (p is None, p or ""))
    parts_of, n = [part[p] for p in pools], [blocks[p] for p in pools]
    last = max((-(-b * sum(parts_of) // w) for w, b in zip(parts_of, n)), default=0)
    ranges = -(-last // slots)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                found = list(schedule(parts_of, n, k * slots, (k + 1) * slots))
                for lo in range(0, len(found), batch):
                    i, *rest = zip(*found[lo : lo + batch])
                    yield pa.record_batch([pa.array([pools[x] for x in i], pa.string()), *(pa.array(x, pa.int64()) for x in rest)], names=["p", "j", "r", "d", "t"])

    return materialize(spark.range(0, ranges, 1, max(1, min(ranges, 10_000))).mapInArrow(run, "p string, j long, r long, d long, t long"))


def mix(docs: DataFrame, weights: dict[str | None, float], block: int = 16, other: float = 1.0) -> DataFrame:
    """doc_id, source, n (number in its source), block, release, deadline, slot and place (order within the mix) of every document.

    A source's documents are taken in the order of a hash of their id and put in blocks of ``block``. Sources that ``weights`` doesn't name, null
    among them, share the weight ``other`` as one. Shares are exact, of the weights of the sources that have documents. When a source has no
    blocks left its slots stay empty, and the others go on at their relative weights; nothing is dropped or repeated. Repeated rows have places of
    their own; rows without an id come in any order; no rows give no rows; other columns are ignored.
    """
    return _mixed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.lit(0).cast("long").alias("tie")), weights, block, other).drop("tie")


def _mixed(rows: DataFrame, weights: dict[str | None, float], block: int, other: float = 1.0) -> DataFrame:
    """``mix`` of rows (doc_id, source, tie), of which those without an id are told apart by tie."""
    spark = rows.sparkSession
    part = parts({**{s: weights[s] for s in weights if s is not None}, None: weights.get(None, other)})
    named = spark.createDataFrame([(s,) for s in part if s is not None], "p string")
    if sum(len(s or "") + 16 for s in part) <= MOST_BROADCAST:
        named = F.broadcast(named)
    rows = rows.join(named, rows["source"] == named["p"], "left").withColumnRenamed("p", "pool")
    # rows without an id are spread over all ranges; they are written with their number, so it stays as it is
    rows = rows.withColumn("h", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("tie", F.monotonically_increasing_id())))
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("h", 52).cast("int"))
    own = materialize(numbered(rows, "pool", ["h", "doc_id", "source", "tie"]).select("doc_id", "source", "tie", "pool", "n", F.expr(f"n div {block}").alias("block")))
    sizes = {r["pool"]: r["blocks"] for r in own.groupBy("pool").agg((F.max("block") + 1).alias("blocks")).collect()}  # one row for each source named
    plan = planned(spark, part, sizes)
    out = own.join(plan, own["pool"].eqNullSafe(plan["p"]) & (own["block"] == plan["j"]))
    return out.select("doc_id", "source", "tie", "n", "block", F.col("r").alias("release"), F.col("d").alias("deadline"), F.col("t").alias("slot"), (F.col("t") * block + F.col("n") % block).alias("place"))


def _sizes(docs: DataFrame) -> dict[str, int]:
    """Documents of each source; the driver holds a row for each source."""
    return {r["source"]: r["count"] for r in docs.where("source is not null").groupBy(F.col("source").cast("string").alias("source")).count().collect()}


def equal_weights(docs: DataFrame) -> dict[str | None, float]:
    """Weight 1 for each source."""
    return dict.fromkeys(_sizes(docs), 1.0)


def root_weights(docs: DataFrame) -> dict[str | None, float]:
    """Square roots of the sources' numbers of documents."""
    return {s: float(n) ** 0.5 for s, n in _sizes(docs).items()}


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float], block: int = 16) -> DataFrame:
    """All of docs, with their columns (of any names), dealt out and sorted by their place in the mix, so that files and rows written hold that order.

    The k-th of the rows with one id takes the k-th place of that id, in the order of their sources; rows without an id are told apart by a hash of their columns.
    No rows give no rows.
    """
    doc, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    tie = F.when(doc.isNull(), whole).otherwise(F.lit(0).cast("long"))
    place = materialize(_mixed(docs.select(doc.alias("doc_id"), source.alias("source"), tie.alias("tie")), weights, block).selectExpr("doc_id as _id", "tie as _tie", "source as _s", "place as _place"))
    # rows and places of an id are numbered and brought together in the same partition, so the rows are dealt out once for both
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), doc.alias("_id"), tie.alias("_tie"), source.alias("_s"), whole.alias("_h"))
    both = own.unionByName(place, allowMissingColumns=True).repartition("_id", "_tie")
    key = ["_id", "_tie"]
    both = both.withColumn("_k", F.row_number().over(Window.partitionBy(*key, F.col("_row").isNull()).orderBy("_s", "_h", "_place")))
    both = both.withColumn("_to", F.max("_place").over(Window.partitionBy(*key, "_k"))).where("_row is not null")
    return both.repartitionByRange("_to").sortWithinPartitions("_to").select("_row.*")
