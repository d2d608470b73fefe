"""Disclosure changes as readers see them: feed, coverage, evidence, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.current import first_n, latest_all

CHANGE = ["accession_number", "section", "model_id", "change_seq"]


def latest_synthesis(rows: DataFrame) -> DataFrame:
    return latest_all(rows, ["accession_number", "section"], "synthesized_at")


def latest_verdicts(rows: DataFrame) -> DataFrame:
    return latest_all(rows, CHANGE, "judged_at")


def latest_specificity(rows: DataFrame) -> DataFrame:
    return latest_all(rows, CHANGE, "classified_at")


def with_flags(changes: DataFrame, specificity: DataFrame, keys: list[str]) -> DataFrame:
    """Adds has_specific and ever_classified for each row's keys."""
    flags = specificity.groupBy(*keys).agg(F.max(F.col("is_specific")).alias("has_specific"), F.lit(True).alias("ever_classified"))
    return changes.join(flags, keys, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_specific", "ever_classified")})


def in_feed(direction: Column) -> Column:
    """What the feed shows: not stable, and something specific or never classified (needs ``with_flags``)."""
    return (direction != "stable") & (F.col("has_specific") | ~F.col("ever_classified"))


def bucket(specific: Column, direction: Column, change_type: Column) -> Column:
    """unclassified, eased, specific or common_mode."""
    gone = (direction == "eased") | (change_type == "dropped")
    return F.when(specific.isNull(), "unclassified").when(specific & F.coalesce(gone, F.lit(False)), "eased").when(specific, "specific").otherwise("common_mode")


def coverage(rows: DataFrame, key: str) -> DataFrame:
    """Companies in all and those with something in the feed; rows need ``with_flags``."""
    return rows.agg(F.count_distinct(key).alias("companies"), F.count_distinct(F.when(F.col("has_specific"), F.col(key))).alias("with_specific"), F.count_distinct(F.when(F.col("ever_classified"), F.col(key))).alias("classified"))


def captions(rows: DataFrame, key: str, text: str, n: int, *order: Column) -> DataFrame:
    """The first n texts of each key as an ordered list."""
    best = first_n(rows, [key], n, *order, rank="_p")
    return best.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", text))), lambda s: s[text]).alias("captions"))


def realized(change_type: Column, is_realized: Column) -> Column:
    """A realization is shown for added risks alone."""
    return (change_type == "added") & F.coalesce(is_realized, F.lit(False))


def synthesis_counts(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """material, worse, eased and neutral counts of each filing's section."""
    d = F.col("direction")
    return verdicts.where("is_material").groupBy(*keys).agg(F.count("*").alias("material_count"), F.count_if(d == "worse").alias("worse_count"), F.count_if(d == "eased").alias("eased_count"), F.count_if(~d.isin("worse", "eased")).alias("neutral_count"))


def stable(changes: DataFrame, verdicts: DataFrame, filings: DataFrame, keys: list[str]) -> DataFrame:
    """Filings all of whose changes are judged and none of which is material: direction stable, intensity none."""
    open_ = changes.join(verdicts.select(*CHANGE), CHANGE, "left_anti").select(*keys).distinct()
    material = verdicts.where("is_material").select(*keys).distinct()
    return filings.join(open_, keys, "left_anti").join(material, keys, "left_anti").withColumns({"headline_direction": F.lit("stable"), "headline_intensity": F.lit("none")})


def themes(rows: DataFrame, theme: str, position: str) -> DataFrame:
    """Themes by count, ties in the order in which they first occur."""
    return rows.groupBy(theme).agg(F.count("*").alias("n"), F.min(position).alias("first_at")).orderBy(F.desc("n"), "first_at")
