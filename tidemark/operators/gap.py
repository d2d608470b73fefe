"""Gaps and sinks: a stage's work is what has no output yet at its version; writes are idempotent by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str], **version) -> DataFrame:
    """Inputs without an output at the version (column = value); running a stage over its gap twice gives an empty gap."""
    done = outputs
    for column, value in version.items():
        done = done.where(F.col(column) == value)
    return inputs.join(done.select(*keys), list(keys), "left_anti")


def seen(entries: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Entries whose key is known."""
    return entries.join(known.select(key), key, "left_semi")


def unseen(entries: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return entries.join(known.select(key), key, "left_anti")


def append_new(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of the batch to append: keys that the target lacks, the first of each key by ``order``."""
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), order).alias("_row")).select("_row.*")
    return first.join(target.select(*keys), list(keys), "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The target after the batch: per key the batch's last row by ``order`` (a column of both), else the target's."""
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*target.columns), F.struct("_new", order)).alias("_row")).select("_row.*")


def upsert_keeping(target: DataFrame, batch: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Upsert in which a null in the batch doesn't overwrite the columns ``keep``; other columns take the batch's value."""
    old, new = target.alias("old"), batch.alias("new")
    here = F.col(f"new.{keys[0]}").isNotNull()

    def value(c):
        if c in keys or c in keep:
            return F.coalesce(f"new.{c}", f"old.{c}").alias(c)
        return F.when(here, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return old.join(new, condition, "full_outer").select(*[value(c) for c in target.columns])


def replace_groups(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with every group of the batch (by keys) replaced whole."""
    return target.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch)


def fill_nulls(rows: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """Null values of a column filled from another table with one row a key."""
    other = known.select(key, F.col(column).alias("_known"))
    return rows.join(other, key, "left").withColumn(column, F.coalesce(column, "_known")).drop("_known")


def universally(parents: DataFrame, children: DataFrame, key: str, holds) -> DataFrame:
    """Parents none of whose children fail the condition; those without children are among them."""
    return parents.join(children.where(~holds).select(key), key, "left_anti")
