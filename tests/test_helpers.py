"""Small functions that no query reaches."""

import datetime as dt

from pyspark.sql import functions as F
from tidemark.functions import dates, net, text
from tidemark.operators import gap, jobs, ops, records, reduce

DAY = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_days_and_their_index(spark):
    day = F.lit("2024-05-09").cast("date")
    assert one(spark, dates.index_path(day)) == "2024/QTR2/master.20240509.idx"
    assert dates.dates_to_scan(DAY(2024, 2, 28), DAY(2024, 3, 1)) == [DAY(2024, 2, 28), DAY(2024, 2, 29), DAY(2024, 3, 1)]
    assert dates.dates_to_scan(None, DAY(2024, 3, 1)) == dates.dates_to_scan(DAY(2024, 3, 2), DAY(2024, 3, 1)) == [DAY(2024, 3, 1)]


def test_spending(spark):
    assert [ops.over_budget(x) for x in (3.99, 4.0, 4.99, 5.0)] == ["ok", "warn", "warn", "stop"]
    rows = spark.createDataFrame([("2024-01-03 10:00:00",), ("2024-01-02 23:00:00",), (None,)], "at string").withColumn("at", F.col("at").cast("timestamp"))
    assert ops.first_day(rows, "at").first()[0] == DAY(2024, 1, 2) and ops.first_day(rows.limit(0), "at").first()[0] is None
    caveat = lambda start: one(spark, ops.spend_caveat(F.lit(start).cast("date"), F.lit("2024-01-31").cast("date"), 30))
    assert [caveat(x) for x in ("2024-01-01", "2024-01-02", None)] == [False, True, False]
    cursor = spark.createDataFrame([("20240128",), ("2024-01-30",), (None,)], "last_filed_at string")
    assert [tuple(r) for r in ops.cursor_freshness(cursor, "2024-01-31").collect()] == [(DAY(2024, 1, 28), 3), (DAY(2024, 1, 30), 1), (None, None)]
    many = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, at int")
    assert sorted(tuple(r) for r in ops.collapsed(many, ["k"], "at").collect()) == [("a", 1, 3, 2), ("b", 2, 2, 1)]


def test_pages_sentences_and_amounts(spark):
    tracked = lambda p: one(spark, net.is_tracked(F.lit(p).cast("string")))
    assert [tracked(p) for p in ("/", "/radar", "/companies/12", "/radar/x", "/ops/", None)] == [True, True, True, False, False, False]
    assert one(spark, text.first_sentence(F.lit("One here. Two!"))) == "One here." and one(spark, text.first_sentence(F.lit("no end"))) == ""
    assert [one(spark, text.compact_usd(F.lit(x))) for x in (1.25e9, 2.5e6, 3400.0, 56.0, -2.5e6)] == ["$1.2B", "$2.5M", "$3.4K", "$56", "$-2.5M"]


def test_attempts_and_causes(spark):
    filings = spark.createDataFrame([("a", None), ("b", 1), ("c", 2)], "accession_number string, classify_attempts int")
    failed = spark.createDataFrame([("a",), ("a",), ("b",)], "accession_number string")
    assert sorted(tuple(r) for r in jobs.healed(filings, failed).collect()) == [("a", 1), ("b", 2), ("c", 2)]
    assert jobs.backlog_alert(50) is None and "51" in jobs.backlog_alert(51)
    cause = lambda m, k: one(spark, jobs.failure_cause(F.lit(m), F.lit(k)))
    assert [cause("Your credit balance is low", "bad_request"), cause("x", "bad_request"), cause("x", "auth"), cause("x", "retryable")] == ["credit_exhausted", "unexpected_error", "auth_failed", "upstream_outage"]
    known = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r["k"] for r in gap.unseen(spark.createDataFrame([("a",), ("b",)], "k string"), known, "k").collect()] == ["b"]


def test_arms_are_summed_up(spark):
    rows = spark.createDataFrame(
        [("f1", "both", "x", "x", True, True, False, 0.1), ("f1", "both", "other_material", "x", True, False, True, 0.2), ("f2", "a", "x", None, True, None, False, None)],
        "filing string, present_in string, label_a string, label_b string, material_a boolean, material_b boolean, changed boolean, delta double",
    )
    got = reduce.compared_summary(rows, "filing").first()
    assert (got["filings"], got["comparable_units"], got["label_changed"], got["label_changed_pct"], got["material_changed"], got["mean_delta"]) == (2, 2, 1, 50.0, 1, 0.15)


def test_small_views(spark):
    t = lambda day: f"2024-01-0{day} 00:00:00"
    c = spark.createDataFrame([("a", 1, t(1)), ("a", 2, t(1)), ("b", 3, t(2)), ("a", 4, t(3))], "accession_number string, id int, classified_at string")
    assert [r["id"] for r in jobs.all_newest_first(c).collect()] == [4, 2, 1, 3]
    filings = spark.createDataFrame([("a", "2024-01-01", "x", ["EX-99.1"]), ("b", "2024-01-02", "", []), ("c", "2024-01-03", None, None)], "accession_number string, filing_date string, body_text string, exhibits array<string>")
    assert [r[0] for r in jobs.classified_accessions(c, filings).collect()] == ["b", "a"]
    assert sorted(r[0] for r in jobs.with_body(filings).select("accession_number").collect()) == ["a", "b"] and [r[0] for r in jobs.exhibit_bearing(filings).collect()] == ["a"]
    events = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "too"), ("b", 1, "own")], "accession_number string, run_id int, name string")
    assert sorted(r["name"] for r in jobs.current_events(events).collect()) == ["new", "own", "too"]
    keys = "accession_number string, section string, model_id string, change_seq int"
    said = spark.createDataFrame([("a", "s", "m", 1, False, t(1)), ("a", "s", "m", 1, True, t(2)), ("a", "s", "m", 2, True, t(1)), ("b", "s", "m", 1, True, t(1)), ("b", "s", "m", 1, False, t(2))], f"{keys}, is_specific boolean, classified_at string")
    counts = jobs.specific_counts(filings.select("accession_number"), said, ["accession_number"])
    assert sorted(tuple(r) for r in counts.collect()) == [("a", 2), ("b", 0), ("c", 0)]
    assert one(spark, records.theme_line(F.lit("trade"), F.lit("tariffs rise"))) == "- trade: tariffs rise"
