"""What a company's page shows of its disclosure changes: material changes with all that is known of them, by filing and bucket, with the filing's synthesis; and filings that stand as they were.

The latest rows of each kind are taken first and put together then. A page's limit counts per company, so groups are bounded by it. What decides the limit is known before it, what is only
shown (headings, excerpts, dates) is looked up after it, if it is shown at all, and cut before it is shuffled: of a block's text no more than its excerpt.

Rows stay where their filing is: tables of changes are grouped by change in one union, and what a filing has once (comparisons, blocks) meets them as a list. Companies get a row a filing, with what is shown of its changes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import excerpt
from tidemark.operators import radar
from tidemark.operators.current import latest_one

CHANGE = radar.CHANGE
BUCKETS = ("specific", "eased", "common_mode", "unclassified")
_SHOWN = ("section", "model_id", "change_seq", "change_type", "direction", "similarity", "heading", "excerpt", "category", "explanation", "confidence", "needs_review", "matched_theme", "realized", "realizing_accession", "realizing_event_type", "realizing_date", "realization_evidence")


class Tables(NamedTuple):
    """filings: accession_number, cik, period_of_report. diffs: accession_number, section, model_id, prior_accession_number. changes: the change's keys, change_type, current_block_index,
    prior_block_index, similarity. verdicts, specificity, realizations: the change's keys, their records and times. blocks: accession_number, section, block_index, heading, block_text.
    events: accession_number, filing_date of the filings in which risks come true. syntheses: accession_number, section, model_id, headline_direction, thesis, top_effects, synthesized_at."""

    filings: DataFrame
    diffs: DataFrame
    changes: DataFrame
    verdicts: DataFrame
    specificity: DataFrame
    realizations: DataFrame
    blocks: DataFrame
    events: DataFrame
    syntheses: DataFrame


def periods(t: Tables) -> DataFrame:
    """accession_number, section, model_id, cik, period and prior_period of every comparison; a prior filing that isn't known has no period."""
    own = t.filings.select("accession_number", "cik", F.col("period_of_report").alias("period"))
    prior = t.filings.select(F.col("accession_number").alias("prior_accession_number"), F.col("period_of_report").alias("prior_period"))
    return t.diffs.select("accession_number", "section", "model_id", "prior_accession_number").join(prior, "prior_accession_number", "left").join(own, "accession_number")


def listed(rows: DataFrame, name: str) -> DataFrame:
    """A row a filing with its rows as a list of structs."""
    rows = rows.where("accession_number is not null")
    return rows.groupBy("accession_number").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "accession_number"])).alias(name))


def compared(rows: DataFrame, t: Tables, *fields: str) -> DataFrame:
    """Rows with these fields of each comparison of their filing's section, and whether there is one (_found); fields are null without."""
    rows = rows.join(listed(periods(t), "_p"), "accession_number", "left")
    rows = rows.withColumn("_p", F.explode_outer(F.filter("_p", lambda p: (p["section"] == F.col("section")) & (p["model_id"] == F.col("model_id")))))
    return rows.select("*", F.col("_p").isNotNull().alias("_found"), *[F.col("_p")[f].alias(f) for f in fields]).drop("_p")


def together(*tables: tuple[DataFrame, str | None, bool]) -> DataFrame:
    """Inner joins (true) or left joins of tables of changes by the change's keys, of each its newest rows by a time, if it has one: as one grouping of all rows, which stay where they are if they lie by filing. Joins would move each table."""
    each = [t.dropna(subset=[*CHANGE, at] if at else CHANGE).select(*CHANGE, F.struct(*[c for c in t.columns if c not in CHANGE]).alias(f"_t{i}")) for i, (t, at, _) in enumerate(tables)]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), each).groupBy(*CHANGE)
    rows = rows.agg(*[F.collect_list(f"_t{i}").alias(f"_t{i}") for i in range(len(each))], *[F.max(f"_t{i}.{at}").alias(f"_at{i}") for i, (_, at, _) in enumerate(tables) if at])
    out = []
    for i, (t, at, needed) in enumerate(tables):
        last = F.filter(f"_t{i}", lambda x: x[at] == F.col(f"_at{i}")) if at else F.col(f"_t{i}")  # noqa: B023  used within the turn
        rows = rows.withColumn(f"_t{i}", (F.explode if needed else F.explode_outer)(last))
        out += [F.col(f"_t{i}")[c].alias(c) for c in t.columns if c not in (*CHANGE, at)]
    return rows.select(*CHANGE, *out)


def newest(rows: DataFrame, at: str, keys: Sequence[str] = CHANGE) -> DataFrame:
    """All rows of a key (a change) whose ``at`` is the key's largest, by a window: a key has few rows, which are moved once and not at all where they lie by filing."""
    last = F.max(at).over(Window.partitionBy(*keys))
    return rows.dropna(subset=[*keys, at]).withColumn("_last", last).where(F.col(at) == F.col("_last")).drop("_last")


def evidence(t: Tables, most: int, fields: Sequence[str] = _SHOWN, more: DataFrame | None = None) -> DataFrame:
    """The first ``most`` material changes of each company, by falling period, then filing, falling confidence and number: cik, accession_number, period, prior_period, bucket, place (from 1), the fields, all of
    _SHOWN or some, and columns of ``more``, a row a filing. A field that isn't asked for isn't looked up.

    A change counts by its latest verdict. Latest rows that share their time all count, as rows of their own. A realization shows for added risks alone.
    """
    v = t.verdicts.select(*CHANGE, "judged_at", "is_material", "direction", "category", "explanation", "confidence", "needs_review")
    s = t.specificity.select(*CHANGE, "classified_at", "is_specific", "matched_theme")
    r = t.realizations.select(*CHANGE, "judged_at", "is_realized", F.col("realizing_accession").alias("_ra"), F.col("realizing_event_type").alias("_rt"), F.col("evidence").alias("_re"))
    c = t.changes.select(*CHANGE, "change_type", "current_block_index", "prior_block_index", "similarity")
    rows = together((v, "judged_at", True), (c, None, True), (s, "classified_at", False), (r, "judged_at", False)).where("is_material")
    rows = compared(rows, t, "prior_accession_number", "cik", "period", "prior_period").where("_found")
    real = radar.realized(F.col("change_type"), F.col("is_realized"))
    rows = rows.withColumns({"realized": real, "realizing_accession": F.when(real, F.col("_ra")), "realizing_event_type": F.when(real, F.col("_rt")), "realization_evidence": F.when(real, F.col("_re"))})
    rows = rows.withColumn("bucket", radar.bucket(F.col("is_specific"), F.col("direction"), F.col("change_type")))

    texts = "heading" in fields or "excerpt" in fields
    keys = ["section", "prior_accession_number", "current_block_index", "prior_block_index"] * texts + ["realizing_accession"] * ("realizing_date" in fields)
    own = list(dict.fromkeys(["prior_period", "bucket", *keys, *[f for f in fields if f not in ("heading", "excerpt", "realizing_date")]]))
    sure = F.col("confidence")  # falling, NaN first and null last
    order = F.struct(sure.isNull().alias("o0"), (~F.isnan(sure)).alias("o1"), (-sure).alias("o2"), "change_seq", "section", "model_id", "is_specific", "matched_theme", "_ra")
    cut = lambda x: F.struct(*[x[f].alias(f) for f in own])
    groups = rows.groupBy("accession_number", "cik", "period").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("_o"), *own))), cut).alias("_c"))
    groups = groups if more is None else groups.join(more, "accession_number", "left")
    before = F.sum(F.size("_c")).over(Window.partitionBy("cik").orderBy(F.desc_nulls_last("period"), "accession_number").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("_n", F.coalesce(before, F.lit(0)).cast("int")).where(F.col("_n") < most).withColumn("_c", F.slice("_c", F.lit(1), F.lit(most) - F.col("_n")))
    shown = groups.select("*", F.posexplode("_c").alias("_i", "_x")).select("*", (F.col("_n") + F.col("_i") + 1).alias("place"), "_x.*").drop("_c", "_n", "_i", "_x")

    if "realizing_date" in fields:
        shown = shown.join(t.events.select(F.col("accession_number").alias("realizing_accession"), F.col("filing_date").alias("realizing_date")), "realizing_accession", "left")
    if "heading" in fields or "excerpt" in fields:
        blocks = listed(t.blocks.select("accession_number", "section", "block_index", "heading", excerpt(F.col("block_text")).alias("excerpt")), "_b")
        for side, filing in (("current", "accession_number"), ("prior", "prior_accession_number")):
            own = lambda b: (b["section"] == F.col("section")) & (b["block_index"] == F.col(f"{side}_block_index"))  # noqa: B023, E731  used within the turn
            shown = shown.join(blocks.withColumnRenamed("accession_number", filing), filing, "left").withColumn(f"_{side}", F.explode_outer(F.filter("_b", own))).drop("_b")
        shown = shown.withColumns({c: F.coalesce(F.col("_current")[c], F.col("_prior")[c]) for c in ("heading", "excerpt")})
    return shown.select("cik", "accession_number", "period", "prior_period", "place", "bucket", *fields, *[c for c in (more.columns if more is not None else []) if c != "accession_number"])


def tallied(themes: Column) -> Column:
    """(theme, count) of a list of themes, falling, equals as they first come; empty ones are ``other``."""
    own = F.transform(themes, lambda t: F.coalesce(F.nullif(t, F.lit("")), F.lit("other")))
    count = lambda t, i: F.struct((-F.size(F.filter(own, lambda x: x == t))).alias("less"), i.alias("at"), t.alias("theme"))
    return F.transform(F.array_sort(F.transform(F.array_distinct(own), count)), lambda s: F.struct(s["theme"].alias("theme"), (-s["less"]).alias("count")))


def by_filing(rows: DataFrame, *more: str) -> DataFrame:
    """``evidence`` and columns of its ``more`` with a row a filing: a list of changes for each bucket, in their order, and common_mode_themes."""
    fields = [c for c in rows.columns if c in _SHOWN]
    rows = rows.groupBy("cik", "accession_number").agg(F.first("period").alias("period"), F.first("prior_period").alias("prior_period"), F.array_sort(F.collect_list(F.struct("place", "bucket", *fields))).alias("_c"), *[F.first(c).alias(c) for c in more])
    of = lambda bucket: F.filter("_c", lambda x: x["bucket"] == bucket)
    return rows.withColumns({b: of(b) for b in BUCKETS}).withColumn("common_mode_themes", tallied(F.transform("common_mode", lambda x: x["matched_theme"]))).drop("_c")


def last_synthesis(syntheses: DataFrame) -> DataFrame:
    """accession_number and the latest synthesis of the filing, of several sections the last, as a struct _s."""
    last = latest_one(syntheses.where("synthesized_at is not null"), ["accession_number"], "synthesized_at", "section", "model_id")
    return last.select("accession_number", F.struct("headline_direction", "thesis", "top_effects").alias("_s"))


def standing(t: Tables) -> DataFrame:
    """cik, accession_number, period, prior_period, thesis and top_effects of sections whose latest synthesis calls them stable; without a comparison they have no prior period."""
    own = t.filings.select("accession_number", "cik", F.col("period_of_report").alias("period"))
    quiet = newest(t.syntheses, "synthesized_at", ["accession_number", "section"]).where("headline_direction = 'stable'").join(own, "accession_number")
    return compared(quiet, t, "prior_period").select("cik", "accession_number", "section", "period", "prior_period", "headline_direction", "thesis", "top_effects")


def disclosures(t: Tables, most: int = 200, fields: Sequence[str] = _SHOWN) -> DataFrame:
    """The page's groups of every company: filings with their changes (the fields of ``evidence``; themes need matched_theme) and syntheses, and stable filings that have no changes shown, with empty lists; position (from 1) is that in the
    company, by falling period, changed ones before stable ones of the same period. Companies without either have no rows."""
    shown = by_filing(evidence(t, most, fields, last_synthesis(t.syntheses)), "_s")
    shown = shown.select("*", F.col("_s").isNotNull().alias("has_synthesis"), "_s.*").drop("_s")
    quiet = standing(t).withColumn("has_synthesis", F.lit(True)).withColumns({c: F.array().cast(shown.schema[c].dataType) for c in (*BUCKETS, "common_mode_themes")}).repartition("cik")  # as the others lie
    both = shown.withColumn("_quiet", F.lit(0)).withColumn("section", F.lit(None).cast("string")).unionByName(quiet.withColumn("_quiet", F.lit(1)))
    # by windows that share an exchange by company, so that the changes aren't looked for a second time
    both = both.withColumn("_changed", F.min("_quiet").over(Window.partitionBy("cik", "accession_number")) == 0).where("_quiet = 0 or not _changed")
    order = F.desc_nulls_last("period"), F.col("_quiet"), F.col("accession_number"), F.col("section")
    return both.withColumn("position", F.row_number().over(Window.partitionBy("cik").orderBy(*order))).drop("_quiet", "_changed", "section")
