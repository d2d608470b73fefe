"""Current views: which of several runs, versions or times of a key's rows count now.

``latest_run`` and ``latest_all`` keep every row at the newest value (ties included), ``latest_one`` keeps one. All three aggregate before they
shuffle rows, so a key that holds a large part of the table does not land in one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_all(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """All rows of a key whose ``at`` is the key's largest; rows with a null key or ``at`` go."""
    newest = rows.groupBy(*keys).agg(F.max(at).alias(at))
    return rows.join(newest, [*keys, at]).select(rows.columns)


def latest_run(rows: DataFrame, key: str, run: str = "run_id") -> DataFrame:
    """The whole of each key's newest run: what only an older run has disappears, never merged anchor by anchor."""
    return latest_all(rows, [key], run)


def latest_one(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row a key: the largest by ``order``, which should end in a unique column. Null keys are a key."""
    best = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def first_n(rows: DataFrame, keys: Sequence[str], n: int, *order: Column, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; Spark limits each key before the shuffle."""
    name = rank or "_rank"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """A page of a totally ordered listing; limit and offset below zero count as the default and zero."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(limit if limit > 0 else 50)


def optional(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Filters by value unless it is empty."""
    return rows.where(F.col(column) == value) if value else rows


def ranked_sources(keys: DataFrame, key: str, sources: Sequence[DataFrame]) -> DataFrame:
    """For each key the values of the first source that has it, and the source's number (from 1); unknown keys go.

    Sources have the key and the same further columns, at most one row a key.
    """
    every = None
    for i, s in enumerate(sources, 1):
        s = s.withColumn("source_rank", F.lit(i))
        every = s if every is None else every.unionByName(s)
    return first_n(every.join(keys.select(key).distinct(), key, "left_semi"), [key], 1, F.col("source_rank"))
