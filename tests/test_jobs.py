"""Records, the menu, the console and the stage jobs, with judges that are plain columns."""

import pytest
from pyspark.sql import functions as F
from tidemark.functions import net, text
from tidemark.operators import console, jobs, ops, periods, records, taxonomy

ASOF = "2024-02-01 00:00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_records_bring_every_field_into_its_range(spark):
    v = one(spark, records.verdict(F.lit('{"is_material": true, "confidence": "2", "category": "Cyber ", "direction": "up", "explanation": "e"}'), ("cyber", "other")))
    assert tuple(v) == (True, 1.0, "cyber", "neutral", "e", False)
    assert tuple(one(spark, records.verdict(F.lit("not json"), ("a",)))) == (False, 0.5, "other", "neutral", "", True)
    s = one(spark, records.synthesis(F.lit('{"headline_direction": "Easing", "headline_intensity": "huge", "thesis": "t", "top_effects": "<item>- a</item><item>b <x></item>"}')))
    assert tuple(s) == ("easing", "moderate", "t", ["a", "b"])
    assert one(spark, records.effects(F.lit('{"top_effects": ["a ", "", "b"]}'))) == ["a", "b"] and one(spark, records.effects(F.lit('{"top_effects": "* x\\n- y; z"}'))) == ["x", "y", "z"] and one(spark, records.effects(F.lit("{}"))) == []
    c = one(spark, records.catalog(F.lit('{"themes": [{"theme_slug": "Tariffs / Trade", "archetype": "a", "prevalence": "-3"}, {"theme_slug": "x", "archetype": "b", "prevalence": "4.7"}]}')))
    assert [tuple(x) for x in c] == [("tariffs_trade", "a", 0), ("x", "b", 4)] and one(spark, records.catalog(F.lit('{"themes": "none"}'))) == []
    sp = one(spark, records.specificity(F.lit('{"verdicts": [{"change_index": true, "is_specific": true, "matched_theme": "", "confidence": -1}, {"change_index": "2.0", "is_specific": false, "matched_theme": "A b", "confidence": "x"}]}')))
    assert [tuple(x)[:4] for x in sp] == [(0, True, None, 0.0), (2, False, "a_b", 0.5)]
    assert tuple(one(spark, records.realization(F.lit('{"is_realized": true, "event_index": "none", "confidence": true}'))))[:2] == (True, None)
    assert records.content_hash([("b", "2"), ("a", "1"), ("b", "3"), ("", "z")]) == records.content_hash([("a", "1"), ("b", "2")]) != records.content_hash([("a", "1"), ("b", "3")])


def test_change_texts_and_lines(spark):
    df = spark.createDataFrame([("changed", "c", "p"), ("added", "c", None), ("dropped", None, "p")], "t string, c string, p string")
    got = [r[0] for r in df.select(records.change_text(F.col("t"), F.col("c"), F.col("p"))).collect()]
    assert got == ["PRIOR YEAR:\np\n\nTHIS YEAR:\nc", "NEWLY ADDED:\nc", "REMOVED (prior year):\np"]
    with pytest.raises(Exception, match="unknown change_type"):
        one(spark, records.change_text(F.lit("carried"), F.lit("a"), F.lit("b")))


def test_menu(spark):
    menu = taxonomy.menu(spark)
    assert menu.count() == 29 and menu.select("domain").distinct().count() == 7 and taxonomy.offered(menu, "8-K").count() == 25 and taxonomy.offered(menu, "6-K").count() == 29
    none = spark.createDataFrame([], "taxonomy_version string, major int, minor int, content_hash string, cut_at timestamp")
    row, cut = taxonomy.snapshot(none, menu, "v1.3", ASOF)
    assert row.first()["minor"] == 3 and taxonomy.leaves_of(cut, "v1.3").count() == 29
    again, none_cut = taxonomy.snapshot(row, menu.orderBy(F.rand(1)), "v1.3", ASOF)
    assert again.count() == none_cut.count() == 0
    with pytest.raises(ValueError):
        taxonomy.snapshot(row, menu.limit(5), "v1.3", ASOF)


def test_console(spark):
    spark.range(600).createOrReplaceTempView("numbers")
    a = console.read(spark, " select id, cast(null as string) as n from numbers order by id; ")
    assert a.columns == ["id", "n"] and len(a.rows) == 500 and a.truncated and a.rows[1] == ["1", ""] and not console.read(spark, "with x as (select 1) select * from x").truncated
    for bad in ("", "select 1; select 2", "show tables", "select 'UPDATE' as x", "with x as (select 1) delete from x"):
        with pytest.raises(ValueError):
            console.checked(bad)
    assert [console.page_of(x, 20, 100) for x in ("5", "0", "x", None, "500")] == [5, 20, 20, 20, 100] and [console.hours_of(x) for x in ("3", "7", "24")] == [3, 1, 24]
    assert console.shown_range(50, 50, 120, 50) == {"first": 51, "last": 100, "previous": 0, "next": 100}


def test_clients_visitors_and_phrases(spark):
    kinds = [("", False, "automated"), (None, True, "automated"), ("Mozilla/5.0 Crawl", True, "crawler"), ("HeadlessChrome Mozilla", False, "automated"), ("Mozilla/5.0", True, "automated"), ("Mozilla/5.0", False, "human"), ("own thing", None, "automated")]
    df = spark.createDataFrame(kinds, "a string, d boolean, want string")
    assert all(r[0] == r[1] for r in df.select(net.client_kind(F.col("a"), F.col("d")), "want").collect())
    assert one(spark, net.visitor_day(F.lit(""), F.lit("x"), F.lit("2024-01-01").cast("date"), "s")) == "" and len(one(spark, net.visitor_day(F.lit("1.2.3.4"), F.lit(None).cast("string"), F.lit("2024-01-01").cast("date"), "s"))) == 16
    assert one(spark, net.client_address(F.lit(" 1.1.1.1 , 2.2.2.2"), F.lit("9.9.9.9:1"))) == "1.1.1.1" and one(spark, net.client_address(F.lit(""), F.lit("9.9.9.9:80"))) == "9.9.9.9" and one(spark, net.referrer_host(F.lit("https://A.b:8/x?y"))) == "A.b:8"
    assert one(spark, text.terms_in(F.lit("An Event of Default, not a default; FRAUD"))) == ["event of default", "fraud"]
    assert one(spark, text.excerpt(F.lit("é" * 99 + " tail " + "x" * 50))) == "é" * 99 + "…" and one(spark, text.excerpt(F.lit("short"))) == "short"
    docs = spark.createDataFrame([(1, "The Quick  brown fox 12 Table of Contents jumps over"), (2, "nothing here")], "k int, text string")
    quotes = spark.createDataFrame([(1, "ick brown FOX jumps"), (2, "too short"), (3, "not in any of them")], "q int, text string")
    assert [tuple(r) for r in text.grounded_quotes(docs, "k", quotes, "q").collect()] == [(1, 1)]
    assert jobs.call_row("claude-haiku-4-5-20251001", "s", None)["estimated_cost_usd"] == 0.0 and jobs.call_row("?", "s", {"input_tokens": 1_000_000})["estimated_cost_usd"] == 15.0 and set(ops.PRICES.values()) == {(1.0, 5.0), (3.0, 15.0), (15.0, 75.0)}


def filings(spark):
    return spark.createDataFrame([("a1", "c", "10-K", "2022-12-31", 2), ("a0", "c", "10-K", "2023-06-30", 0), ("a2", "c", "10-K", "2023-12-31", 2), ("a3", "c", "10-K", "2024-12-31", 0)], "accession_number string, cik string, form string, period_of_report string, block_count int")


def test_prior_among_candidates(spark):
    got = periods.with_prior(filings(spark), ["cik", "form"], "period_of_report", "accession_number", F.col("block_count") > 0)
    assert {r["accession_number"]: r["prior"] for r in got.collect()} == {"a1": None, "a0": "a1", "a2": "a1", "a3": "a2"}


def test_stages_run_once_and_wait_for_what_is_missing(spark):
    f = filings(spark)
    blocks = spark.createDataFrame([(a, "rf", i, f"{a} block {i}") for a in ("a1", "a2") for i in range(2)], "accession_number string, section string, block_index int, block_text string")
    none = spark.createDataFrame([], "accession_number string, section string, block_index int, model_id string, dim int, embedding array<double>, embedded_at timestamp")
    embed = lambda c: F.when(c.endswith("0"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.when(c.startswith("a1"), 0.0).otherwise(-1.0), F.lit(1.0)))
    some = jobs.embed_gap(blocks, none, "m", embed, ASOF, limit=3)
    diffs = spark.createDataFrame([], "accession_number string, model_id string")
    assert some.count() == 3 and jobs.pairs_to_diff(f, blocks, some, diffs, "m").count() == 0
    vectors = some.unionByName(jobs.embed_gap(blocks, some, "m", embed, ASOF))
    assert vectors.count() == 4 and jobs.embed_gap(blocks, vectors, "m", embed, ASOF).count() == 0
    changes = jobs.diff_gap(f, blocks, vectors, diffs, "m")
    assert sorted((r["pair"], r["change_type"], r["prior_accession_number"]) for r in changes.collect()) == [("a2", "carried", "a1"), ("a2", "changed", "a1")]
    assert jobs.pairs_to_diff(f, blocks, vectors, spark.createDataFrame([("a2", "m")], "accession_number string, model_id string"), "m").count() == 0

    rows = spark.createDataFrame([("a2", "rf", "m", 1, "changed", 1, 1, "a1"), ("a2", "rf", "m", 2, "added", 0, None, "a1")], "accession_number string, section string, model_id string, change_seq int, change_type string, current_block_index int, prior_block_index int, prior_accession_number string")
    judged = spark.createDataFrame([], "accession_number string, section string, model_id string, change_seq int, judge_version string")
    judge = lambda t: F.when(F.contains(t, F.lit("PRIOR YEAR:\na1 block 1")), '{"is_material": true, "confidence": 0.9, "category": "cyber", "direction": "worse", "explanation": "e1"}')
    verdicts = jobs.judge_gap(rows, blocks, judged, "j", judge, ("cyber",), ASOF)
    assert [(r["change_seq"], r["category"], r["needs_review"]) for r in verdicts.collect()] == [(1, "cyber", False)]
    assert [r["change_seq"] for r in jobs.changes_to_judge(rows, blocks, verdicts, "j").collect()] == [2]

    empty = spark.createDataFrame([], "accession_number string, section string, model_id string, synthesis_version string")
    words = jobs.synthesis_gap(verdicts, empty, "j", "s", lambda t: F.to_json(F.struct(F.lit("worsening").alias("headline_direction"), t.alias("thesis"))), ASOF)
    s = words.first()
    assert (s["headline_direction"], s["material_count"], s["worse_count"], s["thesis"]) == ("worsening", 1, 1, "- [cyber | worse] e1") and jobs.synthesis_gap(verdicts, words, "j", "s", lambda t: t, ASOF).count() == 0

    versions = spark.createDataFrame([], "catalog_version string, content_hash string, theme_count int, cut_at timestamp")
    raw = spark.createDataFrame([('{"themes": [{"theme_slug": "B b", "archetype": "x"}, {"theme_slug": "a", "archetype": "y"}]}',)], "raw string")
    cut, themes = jobs.cut_catalog(raw, versions, "e", ASOF)
    assert [r["theme_slug"] for r in jobs.current_catalog(cut, themes).collect()] == ["a", "b_b"] and jobs.cut_catalog(raw, cut, "e", ASOF)[0].count() == 0
    done = spark.createDataFrame([], "accession_number string, section string, model_id string, change_seq int, catalog_version string, specificity_version string")
    said = lambda t: F.lit('{"verdicts": [{"change_index": 1, "is_specific": false, "matched_theme": "unknown", "confidence": 1}, {"change_index": 1, "is_specific": true}, {"change_index": 9}]}')
    sp = jobs.specificity_gap(verdicts, done, themes, "j", "v", said, ASOF)
    assert [(r["is_specific"], r["matched_theme"], r["confidence"]) for r in sp.collect()] == [(False, None, 1.0)] and jobs.specificity_gap(verdicts, sp, themes, "j", "v", said, ASOF).count() == 0
    assert jobs.specificity_gap(verdicts, done, themes.limit(0), "j", "v", said, ASOF).count() == 0


def test_realizations_need_a_quote_and_open_again(spark):
    key = "accession_number string, section string, model_id string, change_seq int"
    risks = spark.createDataFrame([("a", "rf", "m", 1, "c", "2024-01-01", "risk text", "why"), ("b", "rf", "m", 1, "d", "2024-01-01", "", "why")], f"{key}, cik string, filed_at string, risk_text string, explanation string")
    event = "cik string, accession_number string, filing_date string, event_type string, item string, summary string, source_text string"
    events = spark.createDataFrame([("c", "e0", "2023-12-01", "t", "", "before", ""), ("c", "e1", "2024-01-05", "t", "2.02", "sum", "The company lost its main customer.")], event)
    done = spark.createDataFrame([], f"{key}, realization_version string, is_realized boolean, checked_through string, judged_at timestamp")
    quoting = lambda q: lambda t: F.to_json(F.struct(F.lit(True).alias("is_realized"), F.lit(1).alias("event_index"), F.lit(q).alias("quote"), F.lit("ev").alias("evidence"), F.lit(0.9).alias("confidence")))
    no = jobs.realization_gap(risks, events, done, "j", "r", quoting("a quote that is nowhere"), ASOF)
    assert [(r["accession_number"], r["is_realized"], r["realizing_accession"], r["evidence"], r["checked_through"]) for r in no.collect()] == [("a", False, None, "", "2024-01-05")]
    assert jobs.realization_gap(risks, events, no, "j", "r", quoting("x"), ASOF).count() == 0
    later = events.unionByName(spark.createDataFrame([("c", "e2", "2024-01-09", "t", None, "more", None)], event))
    yes = jobs.realization_gap(risks, later, no, "j", "r", quoting("lost its MAIN  customer"), ASOF).collect()
    assert [(r["is_realized"], r["realizing_accession"], r["realizing_item"], r["checked_through"]) for r in yes] == [(True, "e1", "2.02", "2024-01-09")]


def test_classified_sections_become_events(spark):
    c = [("f0", None, "going_concern", "w"), ("f1", "2.02", "earnings_release", "x"), ("f2", "EX-99.1", "periodic_annual", "p"), ("f3", "1.01", "ma_activity", "y"), ("f3", "5.02", "exec_departure", "z")]
    rows = spark.createDataFrame([(a, "8-K", i, t, True, 0.9, r) for a, i, t, r in c], "accession_number string, form string, item_number string, event_type string, is_material boolean, confidence double, reasoning string")
    merged = '{"events": [{"event_type": "ma_activity", "is_material": true, "confidence": 1, "summary": "s", "anchor_item_number": "9.99", "contributing_item_numbers": "[\\"1.01\\", \\"5.02\\", \\"7.77\\"]"}, {"event_type": "exec_departure", "anchor_item_number": "5.02", "contributing_item_numbers": "[\\"5.02\\"]"}]}'
    got = jobs.reduce_filings(rows, lambda t: F.lit(merged), 7).collect()
    assert sorted((r["accession_number"], r["anchor_item_number"] or "", r["items"], r["event_domain"], r["run_id"]) for r in got) == [("f0", "", [], "terminal", 7), ("f1", "2.02", ["2.02"], "financial", 7), ("f3", "1.01", ["1.01", "5.02"], "operational", 7)]


def test_blocks_of_changes_are_merged_not_broadcast(spark):
    """Exploded blocks look as few as their filings to Spark; broadcast, all of them would be in the memory of every task."""
    blocks = spark.range(3).select(F.col("id").cast("string").alias("accession_number"), F.lit("rf").alias("section"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("block_index")).withColumn("block_text", F.concat_ws("/", "accession_number", "block_index"))
    changes = spark.createDataFrame([("1", "rf", "m", 1, "changed", 4, 0, "0"), ("1", "rf", "m", 2, "added", 3, None, "0"), ("2", "rf", "m", 1, "dropped", None, 9, "1")], "accession_number string, section string, model_id string, change_seq int, change_type string, current_block_index int, prior_block_index int, prior_accession_number string")
    judged = spark.createDataFrame([], "accession_number string, section string, model_id string, change_seq int, judge_version string")
    out = jobs.changes_to_judge(changes, blocks, judged, "j")
    assert sorted((r["accession_number"], r["change_seq"], r["current_text"], r["prior_text"]) for r in out.collect()) == [("1", 1, "1/4", "0/0"), ("1", 2, "1/3", None), ("2", 1, None, None)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("LeftOuter") == 2 and "Broadcast" not in plan


def test_changes_meet_their_answers_without_a_join(spark):
    """A filing's changes are read, judged and given out in one row; the gap is found once, and a field is taken out of an answer once."""
    verdicts = spark.createDataFrame([(a, "rf", "m", n, "j", n != 40, "c", f"e{n}") for a, ns in (("a", (30, 10, 20, 40, 50)), ("b", (7,))) for n in ns], "accession_number string, section string, model_id string, change_seq int, judge_version string, is_material boolean, category string, explanation string")
    done = spark.createDataFrame([("a", "rf", "m", 50, "c2", "v"), ("b", "rf", "m", 7, "c1", "v")], "accession_number string, section string, model_id string, change_seq int, catalog_version string, specificity_version string")
    themes = spark.createDataFrame([("c1", "old"), ("c2", "new"), ("c2", "new"), ("c2", None)], "catalog_version string, theme_slug string")
    answer = '{"verdicts": [{"change_index": 3, "is_specific": true, "matched_theme": "New"}, {"change_index": -1}, {"change_index": 3}, {"change_index": 4, "is_specific": true}, {"change_index": "1", "matched_theme": "old", "explanation": "x"}, 5, {"change_index": 0}]}'
    judge = lambda t: F.when(t.isin("1. [c] e10\n2. [c] e20\n3. [c] e30", "1. [c] e7"), answer)
    out = jobs.specificity_gap(verdicts, done, themes, "j", "v", judge, ASOF)
    got = sorted((r["accession_number"], r["change_seq"], r["catalog_version"], r["is_specific"], r["matched_theme"], r["confidence"], r["explanation"]) for r in out.collect())
    assert got == [("a", 10, "c2", False, None, 0.5, "x"), ("a", 30, "c2", True, "new", 0.5, ""), ("b", 7, "c2", False, None, 0.5, "x")]
    assert [r["accession_number"] for r in jobs.specificity_gap(verdicts, done, themes, "j", "v", judge, ASOF, limit=1).select("accession_number").distinct().collect()] == ["a"]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("LeftAnti") == 1 and plan.count("Window") == 0
    assert spark.sql("select '{}' as raw").select(records.specificity(F.col("raw")))._jdf.queryExecution().analyzed().toString().count("change_index,") == 2
