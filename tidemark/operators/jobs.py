"""The stages of the pipeline as jobs: what has no output at a version yet goes through a judge or an embedder, and new rows come out.

Judges and embedders are given by the caller: a ``calls.Caller``, which asks for each row once and keeps the answers in a log, or a function from a text column to a column
(of JSON text for a judge, null where a call failed; of numbers for an embedder), which is evaluated once a row whenever the result is read. A row whose call failed
gives no output, so it is in the gap of the next run. Jobs read and return tables; appending what they return and running them again gives nothing new. ``limit`` is how
much one run takes on, the smallest keys first: work is put off, not lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import gap, periods, radar, records, reduce, taxonomy, vectors
from tidemark.operators.calls import Caller, Judge, answered
from tidemark.operators.current import first_n, latest_all, latest_one, latest_run

BLOCK = ["accession_number", "section", "block_index"]
CHANGE = radar.CHANGE


def first_rows(rows: DataFrame, limit: int | None, *order) -> DataFrame:
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def embed_gap(blocks: DataFrame, embeddings: DataFrame, model_id: str, embed: Judge, asof: str, limit: int | None = None) -> DataFrame:
    """Vectors of blocks that have none of the model."""
    todo = first_rows(gap.gap(blocks, embeddings, BLOCK, model_id=model_id), limit, *BLOCK)
    out = answered(todo.select(*BLOCK, F.lit(model_id).alias("model_id"), F.col("block_text").alias("text")), BLOCK, embed, "embed", model_id)
    vector = F.from_json("raw", "array<double>") if isinstance(embed, Caller) else F.col("raw")  # a log holds texts
    return out.withColumn("embedding", vector).select(*BLOCK, "model_id", F.size("embedding").alias("dim"), "embedding", F.lit(asof).cast("timestamp").alias("embedded_at"))


def embedded(filings: DataFrame, blocks: DataFrame, embeddings: DataFrame, model_id: str) -> DataFrame:
    """Filings with blocks all of which have a vector of the model."""
    missing = gap.gap(blocks, embeddings, BLOCK, model_id=model_id).select("accession_number").distinct()
    return filings.where("block_count > 0").join(missing, "accession_number", "left_anti")


def pairs_to_diff(filings: DataFrame, blocks: DataFrame, embeddings: DataFrame, diffs: DataFrame, model_id: str) -> DataFrame:
    """accession_number and prior of filings not yet compared, both with all their vectors. The prior is that of the latest earlier period with blocks; where it
    lacks vectors the pair waits, and no earlier one takes its place."""
    paired = periods.with_prior(filings, ["cik", "form"], "period_of_report", "accession_number", F.col("block_count") > 0).where("prior is not null")
    ready = embedded(filings, blocks, embeddings, model_id).select("accession_number")
    own = gap.gap(paired, diffs, ["accession_number"], model_id=model_id).join(ready, "accession_number", "left_semi")
    return own.join(ready.withColumnRenamed("accession_number", "prior"), "prior", "left_semi").select("accession_number", "prior", "period_of_report")


def diff_gap(filings: DataFrame, blocks: DataFrame, embeddings: DataFrame, diffs: DataFrame, model_id: str, limit: int | None = None) -> DataFrame:
    """Changes (pair: the filing's accession; change_type, block indices, similarity, prior_accession_number) of the filings to compare, carried blocks among them."""
    todo = first_rows(pairs_to_diff(filings, blocks, embeddings, diffs, model_id), limit, "period_of_report", "accession_number")
    own = embeddings.where(F.col("model_id") == model_id).select("accession_number", "block_index", "embedding")
    current = todo.select(F.col("accession_number").alias("pair")).join(own.withColumnRenamed("accession_number", "pair"), "pair")
    prior = todo.select(F.col("accession_number").alias("pair"), F.col("prior").alias("accession_number")).join(own, "accession_number").drop("accession_number")
    found = vectors.changes(current, prior, "pair")
    return found.join(todo.select(F.col("accession_number").alias("pair"), F.col("prior").alias("prior_accession_number")), "pair")


def changes_to_judge(changes: DataFrame, blocks: DataFrame, verdicts: DataFrame, judge_version: str) -> DataFrame:
    """Changes without a verdict of the version, with the texts of their blocks (null on the side that a change lacks).

    Blocks are merged, as Spark takes exploded ones for as few as their filings and would broadcast all of them, once for each side, to every task.
    """
    text = lambda side: blocks.select(F.col("accession_number").alias(f"_{side}"), F.col("section").alias(f"_{side}s"), F.col("block_index").alias(f"_{side}i"), F.col("block_text").alias(f"{side}_text")).hint("merge")
    todo = gap.gap(changes, verdicts, CHANGE, judge_version=judge_version)
    todo = todo.join(text("current"), (F.col("accession_number") == F.col("_current")) & (F.col("section") == F.col("_currents")) & (F.col("current_block_index") == F.col("_currenti")), "left")
    todo = todo.join(text("prior"), (F.col("prior_accession_number") == F.col("_prior")) & (F.col("section") == F.col("_priors")) & (F.col("prior_block_index") == F.col("_priori")), "left")
    return todo.select(*changes.columns, "current_text", "prior_text")


def judge_gap(changes: DataFrame, blocks: DataFrame, verdicts: DataFrame, judge_version: str, judge: Judge, categories: tuple[str, ...], asof: str, limit: int | None = None) -> DataFrame:
    """Verdicts of changes that have none of the version."""
    todo = first_rows(changes_to_judge(changes, blocks, verdicts, judge_version), limit, *CHANGE)
    texts = todo.select(*CHANGE, records.change_text(F.col("change_type"), F.col("current_text"), F.col("prior_text")).alias("text"))
    raw = answered(texts, CHANGE, judge, "judge", judge_version)
    return raw.select(*CHANGE, F.lit(judge_version).alias("judge_version"), records.verdict(F.col("raw"), categories).alias("v"), F.lit(asof).cast("timestamp").alias("judged_at")).select(*CHANGE, "judge_version", "v.*", "judged_at")


FILING = ["accession_number", "section", "model_id"]


def synthesis_gap(verdicts: DataFrame, syntheses: DataFrame, judge_version: str, synthesis_version: str, write: Judge, asof: str, limit: int | None = None) -> DataFrame:
    """Syntheses of filings with material verdicts and none of the version: counts from the verdicts, words from the reducer, which reads them by falling confidence."""
    material = verdicts.where((F.col("judge_version") == judge_version) & F.col("is_material"))
    todo = gap.gap(material, syntheses, FILING, synthesis_version=synthesis_version)
    keys = first_rows(todo.select(*FILING).distinct(), limit, *FILING)
    own = todo.join(keys, FILING, "left_semi")
    line = records.finding(F.col("category"), F.col("direction"), F.col("explanation"))
    texts = records.lines(own.withColumn("_sure", -F.col("confidence")), FILING, line, "_sure", "change_seq")
    rows = answered(texts.join(radar.synthesis_counts(own, FILING), FILING), FILING, write, "synthesis", synthesis_version)
    rows = rows.withColumn("s", records.synthesis(F.col("raw"))).drop("text", "raw")
    return _synthesis_rows(rows.select("*", "s.*").drop("s"), judge_version, synthesis_version, asof)


def _synthesis_rows(rows: DataFrame, judge_version: str, version: str, asof: str) -> DataFrame:
    counts = [F.col(c).cast("long").alias(c) for c in ("material_count", "worse_count", "eased_count", "neutral_count")]
    return rows.select(*FILING, F.lit(judge_version).alias("judge_version"), F.lit(version).alias("synthesis_version"), "headline_direction", "headline_intensity", *counts, "thesis", "top_effects", F.lit(asof).cast("timestamp").alias("synthesized_at"))


def stable_gap(diffs: DataFrame, changes: DataFrame, verdicts: DataFrame, blocks: DataFrame, syntheses: DataFrame, judge_version: str, version: str, write: Judge, asof: str, most_chars: int = 60_000, limit: int | None = None) -> DataFrame:
    """Summaries of what stands in filings that were compared, judged whole, and have no material change: stable, intensity none, all counts zero."""
    own = verdicts.where(F.col("judge_version") == judge_version)
    quiet = radar.stable(changes, own, diffs.select(*FILING).distinct(), FILING)
    todo = first_rows(gap.gap(quiet, syntheses, FILING, synthesis_version=version).select(*FILING), limit, *FILING)
    texts = reduce.joined_text(todo.join(blocks, ["accession_number", "section"]).withColumn("_k", F.struct(*FILING)), "_k", "block_index", "block_text", most_chars)
    said = answered(texts.select("_k.*", "text"), FILING, write, "standing", version)
    rows = said.select(*FILING, records.standing(F.col("raw")).alias("s")).select(*FILING, "s.*")
    return _synthesis_rows(rows.withColumns({c: F.lit(0) for c in ("material_count", "worse_count", "eased_count", "neutral_count")}), judge_version, version, asof)


def digest(verdicts: DataFrame, filings: DataFrame, judge_version: str) -> DataFrame:
    """A line for each material verdict of the version, ``COMPANY | theme | explanation``, with the columns that order them."""
    own = verdicts.where((F.col("judge_version") == judge_version) & F.col("is_material")).join(filings.select("accession_number", "company_name"), "accession_number")
    return own.select("company_name", *CHANGE, F.concat_ws(" | ", "company_name", "category", "explanation").alias("line"))


def cut_catalog(raw: DataFrame, versions: DataFrame, extractor: str, asof: str) -> tuple[DataFrame, DataFrame]:
    """The version row and the themes to append of a reducer's answer (one row, column raw); nothing without themes, or if the same content was cut before.

    A catalog is a few dozen themes, which the driver hashes.
    """
    spark = raw.sparkSession
    found = raw.select(F.posexplode(records.catalog(F.col("raw"))).alias("pos", "t")).select("pos", "t.*")
    themes = reduce.canonical(found, F.col("theme_slug"), "pos").select(F.col("slug").alias("theme_slug"), "archetype", "prevalence").collect()
    pairs = [(t["theme_slug"], t["archetype"]) for t in themes]
    version = records.catalog_version(extractor, pairs)
    if not themes or not versions.where(F.col("catalog_version") == version).isEmpty():
        themes, rows = [], []
    else:
        rows = [(version, records.content_hash(pairs), len(themes), asof)]
    cut = spark.createDataFrame(rows, "catalog_version string, content_hash string, theme_count int, cut_at string").withColumn("cut_at", F.col("cut_at").cast("timestamp"))
    return cut, spark.createDataFrame([(version, *t) for t in themes], "catalog_version string, theme_slug string, archetype string, prevalence int")


def current_catalog(versions: DataFrame, themes: DataFrame) -> DataFrame:
    """The themes of the version cut last, by slug."""
    last = versions.agg(F.max_by("catalog_version", F.struct("cut_at", "catalog_version")).alias("catalog_version"))
    return themes.join(last, "catalog_version", "left_semi").orderBy("theme_slug")


def specificity_gap(verdicts: DataFrame, done: DataFrame, themes: DataFrame, judge_version: str, version: str, judge: Judge, asof: str, limit: int | None = None) -> DataFrame:
    """Which material changes are a company's own: a filing's changes go to the judge together, numbered from 1; verdicts out of range and further ones for a number are
    dropped, themes that the catalog lacks become null. Nothing without a catalog; a change without a verdict stays in the gap."""
    slugs = themes.where("catalog_version is not null").select("catalog_version", "theme_slug").distinct().groupBy("catalog_version").agg(F.collect_list("theme_slug").alias("_slugs"))
    catalog = slugs.agg(F.max("catalog_version").alias("catalog_version"), F.max_by("_slugs", "catalog_version").alias("_slugs")).where("catalog_version is not null")  # one row; give the themes of current_catalog
    material = verdicts.where((F.col("judge_version") == judge_version) & F.col("is_material")).join(F.broadcast(catalog.select("catalog_version")))
    todo = material.join(done.where(F.col("specificity_version") == version).select(*CHANGE, "catalog_version"), [*CHANGE, "catalog_version"], "left_anti")
    if limit is not None:
        todo = todo.join(first_rows(todo.select(*FILING).distinct(), limit, *FILING), FILING, "left_semi")
    # a filing's changes stay in the row that the judge reads, so that its answers find them without a join
    own = todo.groupBy(*FILING, "catalog_version").agg(F.array_sort(F.collect_list(F.struct("change_seq", "category", "explanation"))).alias("_own"))
    lines = F.transform("_own", lambda x, i: records.numbered(i + 1, x["category"], x["explanation"]))
    said = answered(own.withColumn("text", F.array_join(lines, "\n")), [*FILING, "catalog_version"], judge, "specificity", version)
    answers = F.array_sort(F.transform(records.specificity(F.col("raw")), lambda v, i: F.struct(v["change_index"].alias("position"), i.alias("pos"), v.dropFields("change_index").alias("v"))))
    said = said.select(*FILING, "catalog_version", "_own", F.explode(F.array(answers)).alias("_said"))
    first = F.filter("_said", lambda x, i: x["position"].between(1, F.size("_own")) & ((i == 0) | (F.get("_said", i - 1)["position"] != x["position"])))
    rows = said.select(*FILING, "catalog_version", F.explode(F.transform(first, lambda x: F.struct(F.get("_own", x["position"] - 1)["change_seq"].alias("change_seq"), x["v"].alias("v")))).alias("r"))
    rows = rows.select(*FILING, "catalog_version", "r.change_seq", "r.v.*").join(F.broadcast(catalog), "catalog_version").withColumn("matched_theme", F.when(F.array_contains("_slugs", F.col("matched_theme")), F.col("matched_theme")))
    return rows.select(*CHANGE, F.lit(judge_version).alias("judge_version"), "catalog_version", F.lit(version).alias("specificity_version"), "is_specific", "matched_theme", "confidence", "explanation", F.lit(asof).cast("timestamp").alias("classified_at"))


def realization_gap(risks: DataFrame, events: DataFrame, done: DataFrame, judge_version: str, version: str, judge: Judge, asof: str, most_events: int = 20, limit: int | None = None) -> DataFrame:
    """Whether flagged risks (change key, cik, filed_at, risk_text, explanation) came true in later material events (cik, accession_number, filing_date, event_type, item, summary, source_text).

    A risk is judged if it has a later event and no verdict of the version, or one that says no and an event after what it had checked. The judge reads the risk and its
    first ``most_events`` later events, oldest first; a quote that the cited event doesn't hold makes the answer a no. checked_through is the last event's date.
    """
    last = latest_all(done.where(F.col("realization_version") == version), CHANGE, "judged_at").select(*CHANGE, F.col("is_realized").alias("_was"), F.col("checked_through").alias("_through"))
    newest = events.groupBy("cik").agg(F.max("filing_date").alias("_newest"))
    todo = risks.join(newest, "cik").where(F.col("_newest") > F.col("filed_at")).join(last, CHANGE, "left").where(F.col("_was").isNull() | (~F.col("_was") & (F.col("_newest") > F.col("_through"))))
    todo = first_rows(todo, limit, *CHANGE)
    e = events.select("cik", F.col("accession_number").alias("e_accession"), "filing_date", "event_type", "item", "summary", "source_text")
    met = first_n(todo.join(e, "cik").where(F.col("filing_date") > F.col("filed_at")), CHANGE, most_events, F.col("filing_date"), F.col("e_accession"), F.col("item"), rank="position")
    cols = ("position", "e_accession", "filing_date", "event_type", "item", "summary", "source_text")
    rows = met.groupBy(*CHANGE).agg(F.first("risk_text").alias("risk_text"), F.first("explanation").alias("explanation"), F.array_sort(F.collect_list(F.struct(*cols))).alias("events"))
    block = lambda x: records.event_block(x["position"], x["filing_date"], x["event_type"], x["item"], x["summary"], x["source_text"])
    risk = F.coalesce(F.nullif(F.trim(F.coalesce("risk_text", F.lit(""))), F.lit("")), F.lit("(text unavailable)"))
    text = F.concat(F.lit("Risk factor: "), risk, F.lit("\nWhat changed this year: "), F.coalesce("explanation", F.lit("")), F.lit("\n\n"), F.array_join(F.transform("events", block), "\n"))
    said = answered(rows.withColumn("text", text), CHANGE, judge, "realization", version).withColumn("v", records.realization(F.col("raw")))
    real = F.col("v.is_realized") & records.is_grounded(F.col("v"), F.col("events"))
    hit = F.when(real, F.get("events", F.col("v.event_index") - 1))
    return said.select(
        *CHANGE, F.lit(judge_version).alias("judge_version"), F.lit(version).alias("realization_version"), real.alias("is_realized"), hit["e_accession"].alias("realizing_accession"), hit["event_type"].alias("realizing_event_type"),
        F.nullif(hit["item"], F.lit("")).alias("realizing_item"), F.when(real, F.col("v.evidence")).otherwise("").alias("evidence"), F.col("v.confidence").alias("confidence"), F.array_max(F.transform("events", lambda x: x["filing_date"])).alias("checked_through"), F.lit(asof).cast("timestamp").alias("judged_at"),
    )


def classify_gap(filings: DataFrame, classifications: DataFrame, version: str, judge: Judge, leaves: tuple[str, ...], asof: str, limit: int | None = None) -> DataFrame:
    """Classifications of the sections of filings (accession_number, form, company_name, cik, ticker, filing_date, body_text, sections, exhibits) that have none of the version.

    A filing's rows come together: one of whose sections a call failed, or gave no event type, gives none yet and is in the gap of the next run. With a Caller the sections that
    were answered aren't asked again then.
    """
    todo = first_rows(gap.gap(filings, classifications, ["accession_number"], classifier_version=version), limit, "accession_number")
    sections = reduce.sections_of(todo, {"8-K": 12_000, "6-K": 20_000})
    rows = sections.join(todo.select("accession_number", "company_name", "cik", "ticker", "filing_date"), "accession_number")
    item = F.when(F.col("unit") != "__whole_filing__", F.col("unit"))
    text = records.section_message(F.col("form"), F.col("company_name"), F.col("cik"), F.col("ticker"), F.col("filing_date"), item, F.lit(None).cast("string"), F.col("text"), F.lit(""))
    asked = rows.select("accession_number", "form", "unit", item.alias("item_number"), text.alias("text"))
    asked = asked.withColumn("_sections", F.count("*").over(Window.partitionBy("accession_number")))
    said = answered(asked, ["accession_number", "unit"], judge, "classify", version).withColumn("c", records.classification(F.col("raw"), leaves))
    whole = F.count_if(F.col("c.event_type").isNotNull()).over(Window.partitionBy("accession_number"))  # a filing's sections are few
    said = said.withColumn("_good", whole).where("_good = _sections")
    return said.select("accession_number", "form", "item_number", "c.*", taxonomy.domain_of(F.col("c.event_type")).alias("event_domain"), F.lit(version).alias("classifier_version"), F.lit(asof).cast("timestamp").alias("classified_at"))


def reduce_filings(classified: DataFrame, judge: Judge, run_id: int) -> DataFrame:
    """Events of filings from their sections' classifications (accession_number, form, item_number, event_type, is_material, confidence, reasoning).

    Sections of periodic reports don't count. No item: the whole filing's classification is the event; one: it passes through; more: the judge merges them, and its events are
    brought back to items that there are, without those whose items another event has all of.
    """
    own = taxonomy.event_sections(classified)
    items = own.where("item_number is not null")
    n = items.groupBy("accession_number").agg(F.count("*").alias("_n"))
    counted = own.join(n, "accession_number", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    alone = counted.where(((F.col("_n") == 0) & F.col("item_number").isNull()) | ((F.col("_n") == 1) & F.col("item_number").isNotNull()))
    none = F.array().cast("array<string>")
    simple = alone.select("accession_number", "event_type", "is_material", "confidence", F.col("reasoning").alias("summary"), F.col("item_number").alias("anchor_item_number"), F.when(F.col("item_number").isNull(), none).otherwise(F.array("item_number")).alias("items"))
    many = counted.where((F.col("_n") > 1) & F.col("item_number").isNotNull())
    line = records.reduce_line(F.col("form"), F.col("item_number"), F.lit(None).cast("string"), F.col("event_type"), F.col("is_material"), F.col("confidence"), F.col("reasoning"))
    texts = records.lines(many, ["accession_number"], line, "item_number").join(many.groupBy("accession_number").agg(F.collect_set("item_number").alias("known")), "accession_number")
    said = answered(texts, ["accession_number"], judge, "reduce", str(run_id)).select("accession_number", "known", F.posexplode(records.reduced_events(F.col("raw"))).alias("pos", "e"))
    anchor, kept = reduce.grounded(F.col("e.anchor_item_number"), F.col("e.contributing_item_numbers"), F.col("known"))
    real = said.select("accession_number", "pos", "e.event_type", "e.is_material", "e.confidence", "e.summary", anchor.alias("anchor_item_number"), kept.alias("items")).where("anchor_item_number is not null")
    merged = reduce.maximal(real, "accession_number", "pos", "items").drop("pos")
    return simple.unionByName(merged).withColumns({"event_domain": taxonomy.domain_of(F.col("event_type")), "run_id": F.lit(run_id).cast("long")})


def with_links(events: DataFrame, classifications: DataFrame) -> DataFrame:
    """accession_number, anchor_item_number and the id of the latest classification of each item that an event holds."""
    latest = latest_one(classifications, ["accession_number", "item_number"], "classified_at", "id").select("accession_number", "item_number", F.col("id").alias("classification_id"))
    each = events.select("accession_number", "anchor_item_number", F.explode("items").alias("item_number"))
    return each.join(latest, ["accession_number", "item_number"])


def orphans(filings: DataFrame, classifications: DataFrame, asof: str, grace_minutes: int = 5, abandon: int = 3) -> DataFrame:
    """Filings fetched before the grace time, without any classification, whose attempts haven't reached the limit."""
    old = F.col("fetched_at") < F.lit(asof).cast("timestamp") - F.expr(f"interval {grace_minutes} minutes")
    return filings.where(old & (F.coalesce("classify_attempts", F.lit(0)) < abandon)).join(classifications.select("accession_number"), "accession_number", "left_anti")


def healed(filings: DataFrame, failed: DataFrame) -> DataFrame:
    """Filings with an attempt more for each that failed for good (accession_number)."""
    f = failed.select("accession_number").distinct().withColumn("_failed", F.lit(1))
    return filings.join(f, "accession_number", "left").withColumn("classify_attempts", F.coalesce("classify_attempts", F.lit(0)) + F.coalesce("_failed", F.lit(0))).select(filings.columns)


def backlog_alert(waiting: int, most: int = 50) -> str | None:
    """A warning if more than ``most`` filings wait."""
    return f"{waiting} filings wait for classification" if waiting > most else None


def failure_cause(message: Column, kind: Column) -> Column:
    """What a failed call means for those who run it: credit, access, an outage that passes, or something else. ``kind`` is bad_request, auth, permission, retryable or other."""
    return F.when((kind == "bad_request") & F.contains(F.lower(message), F.lit("credit balance")), "credit_exhausted").when(kind.isin("auth", "permission"), "auth_failed").when(kind == "retryable", "upstream_outage").otherwise("unexpected_error")


def all_newest_first(classifications: DataFrame) -> DataFrame:
    return classifications.orderBy("accession_number", F.desc("classified_at"), F.desc("id"))


def current_events(events: DataFrame) -> DataFrame:
    """Events of each filing's newest run."""
    return latest_run(events, "accession_number")


def with_body(filings: DataFrame) -> DataFrame:
    """Filings whose text is there."""
    return filings.where("body_text is not null")


def exhibit_bearing(filings: DataFrame) -> DataFrame:
    return filings.where(F.size("exhibits") > 0).select("accession_number")


def classified_accessions(classifications: DataFrame, filings: DataFrame) -> DataFrame:
    """Each classified filing once, newest first."""
    once = classifications.select("accession_number").distinct().join(filings.select("accession_number", "filing_date"), "accession_number")
    return once.orderBy(F.desc("filing_date"), "accession_number")


def specific_counts(changes: DataFrame, specificity: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys with the number of specific changes of the latest verdicts, 0 without any."""
    n = radar.latest_specificity(specificity).where("is_specific").groupBy(*keys).agg(F.count("*").alias("specific_count"))
    return changes.join(n, keys, "left").withColumn("specific_count", F.coalesce("specific_count", F.lit(0)))


def call_row(model: str, stage: str, usage: dict | None, prices=None) -> dict:
    """What one call cost, as a row to append: counts that weren't reported are zero; an unknown model has the highest rates and is flagged."""
    from tidemark.operators.ops import CACHE_READ, CACHE_WRITE, PRICES

    table, u = prices or PRICES, usage or {}
    tokens = {k: int(u.get(k) or 0) for k in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")}
    i, o = table.get(model) or (max(p[0] for p in table.values()), max(p[1] for p in table.values()))
    plain = max(0, tokens["input_tokens"] - tokens["cache_read_tokens"] - tokens["cache_creation_tokens"])
    usd = (plain * i + tokens["cache_creation_tokens"] * i * CACHE_WRITE + tokens["cache_read_tokens"] * i * CACHE_READ + tokens["output_tokens"] * o) / 1e6
    return {"model": model, "stage": stage, **tokens, "estimated_cost_usd": usd, "unknown_model": model not in table}
