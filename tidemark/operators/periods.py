"""As-of and forward joins over periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.current import first_n


def with_prior(filings: DataFrame, keys: Sequence[str], period: str, filing: str, candidate: Column | None = None) -> DataFrame:
    """Adds ``prior``: the filing of the greatest strictly earlier period of the same keys that is a ``candidate`` (ties: the greatest id), else null.

    The condition holds for priors alone: filings that aren't candidates themselves have a prior too.
    """
    own = filings.groupBy(*keys, period).agg(F.max(F.when(F.lit(True) if candidate is None else candidate, F.col(filing))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    return filings.join(own.withColumn("prior", F.last("_last", ignorenulls=True).over(before)).drop("_last"), [*keys, period], "left")


def following(anchors: DataFrame, events: DataFrame, key: str, anchor: str, since: str, at: str, n: int, *order) -> DataFrame:
    """For each anchor the first n events of its key strictly after it."""
    own = anchors.select(key, anchor, since)
    return first_n(own.join(events, key).where(F.col(at) > F.col(since)), [anchor], n, *order, rank="position")


def newer_than(rows: DataFrame, events: DataFrame, key: str, at: str, watermark) -> DataFrame:
    """Rows for whose key an event is later than the watermark: any such event exists if and only if the key's latest one is."""
    last = events.groupBy(key).agg(F.max(at).alias("last_event"))
    return rows.join(last, key).where(F.col("last_event") > watermark)
