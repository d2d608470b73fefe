"""A company's page: ties, limits, missing parts and empty tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from tidemark.operators import company

DAY = dt.datetime
KEY = "accession_number string, section string, model_id string, change_seq int"


def tables(spark, **rows):
    schemas = {
        "filings": "accession_number string, cik string, period_of_report string",
        "diffs": "accession_number string, section string, model_id string, prior_accession_number string",
        "changes": f"{KEY}, change_type string, current_block_index int, prior_block_index int, similarity double",
        "verdicts": f"{KEY}, is_material boolean, direction string, category string, explanation string, confidence double, needs_review boolean, judged_at timestamp",
        "specificity": f"{KEY}, is_specific boolean, matched_theme string, classified_at timestamp",
        "realizations": f"{KEY}, is_realized boolean, realizing_accession string, realizing_event_type string, evidence string, judged_at timestamp",
        "blocks": "accession_number string, section string, block_index int, heading string, block_text string",
        "events": "accession_number string, filing_date string",
        "syntheses": "accession_number string, section string, model_id string, headline_direction string, thesis string, top_effects array<string>, synthesized_at timestamp",
    }
    return company.Tables(**{name: spark.createDataFrame(rows.get(name, []), s) for name, s in schemas.items()})


def key(seq, filing="a2"):
    return filing, "rf", "m", seq


@pytest.fixture(scope="module")
def page(spark):
    t1, t2 = DAY(2024, 1, 1), DAY(2024, 1, 2)
    said = lambda seq, material, direction, sure, day=t1, filing="a2": (*key(seq, filing), material, direction, "cyber", f"e{seq}", sure, False, day)
    return tables(
        spark,
        filings=[("a1", "c", "2022-12-31"), ("a2", "c", "2023-12-31"), ("a3", "c", "2024-12-31"), ("b1", "d", None)],
        diffs=[("a2", "rf", "m", "a1"), ("a3", "rf", "m", "a2"), ("b1", "rf", "m", "gone")],
        changes=[(*key(1), "added", 0, None, None), (*key(2), "dropped", None, 0, None), (*key(3), "changed", 1, 1, 0.8), (*key(4), "changed", 9, 1, 0.8), (*key(5), "added", 0, None, None), (*key(1, "b1"), "added", 0, None, None)],
        verdicts=[said(1, True, "worse", 0.5), said(2, True, "eased", 0.9), said(3, True, "worse", 0.9), said(4, True, "neutral", 0.4), said(5, True, "worse", 1.0), said(5, False, "worse", 1.0, t2), said(1, True, "worse", 0.5, t1, "b1")],
        specificity=[(*key(1), True, None, t1), (*key(2), True, "x", t1), (*key(3), True, "x", t1), (*key(3), False, "", t2)],
        realizations=[(*key(1), True, "8k", "ma_activity", "it came", t1), (*key(3), True, "8k", "ma_activity", "not shown", t1)],
        blocks=[("a2", "rf", 0, "new", "word " * 60), ("a2", "rf", 1, None, "current"), ("a1", "rf", 0, "old", "prior 0"), ("a1", "rf", 1, "prior head", "prior 1")],
        events=[("8k", "2024-02-02")],
        syntheses=[("a2", "rf", "m", "worsening", "t1", ["x"], t1), ("a2", "rf", "m", "mixed", "t2", ["y"], t2), ("a3", "rf", "m", "stable", "stands", [], t1), ("a1", "rf", "m", "stable", "was", [], t1), ("a1", "rf", "m", "worsening", "is", [], t2)],
    )


def test_page_of_a_company(spark, page):
    got = {r["accession_number"]: r for r in company.disclosures(page).collect()}
    assert set(got) == {"a2", "a3", "b1"}  # a1's latest synthesis isn't stable any more
    a = got["a2"]
    assert (a["period"], a["prior_period"], a["position"], a["has_synthesis"], a["headline_direction"], a["thesis"], a["top_effects"]) == ("2023-12-31", "2022-12-31", 2, True, "mixed", "t2", ["y"])
    assert {b: [x["change_seq"] for x in a[b]] for b in company.BUCKETS} == {"specific": [1], "eased": [2], "common_mode": [3], "unclassified": [4]}  # 5: the later verdict counts
    new, gone, edited, lost = a["specific"][0], a["eased"][0], a["common_mode"][0], a["unclassified"][0]
    assert (new["realized"], new["realizing_accession"], new["realizing_date"], new["realization_evidence"]) == (True, "8k", "2024-02-02", "it came")
    assert (edited["realized"], edited["realizing_accession"], edited["realization_evidence"]) == (False, None, None)  # shown for added risks alone
    assert new["heading"] == "new" and new["excerpt"].endswith("word…") and len(new["excerpt"]) <= 200 and (gone["heading"], gone["excerpt"]) == ("old", "prior 0")
    assert (edited["heading"], edited["excerpt"]) == ("prior head", "current") and (lost["heading"], lost["excerpt"]) == ("prior head", "prior 1")
    assert [tuple(x) for x in a["common_mode_themes"]] == [("other", 1)]
    s = got["a3"]
    assert (s["position"], s["prior_period"], s["headline_direction"], s["thesis"], s["specific"], s["common_mode_themes"]) == (1, "2023-12-31", "stable", "stands", [], [])
    b = got["b1"]
    assert (b["cik"], b["period"], b["prior_period"], b["position"], b["has_synthesis"], b["thesis"]) == ("d", None, None, 1, False, None)


def test_limit_counts_by_company_and_makes_room_for_stable(spark, page):
    rows = company.evidence(page, 2).collect()
    assert sorted((r["cik"], r["place"], r["change_seq"]) for r in rows) == [("c", 1, 2), ("c", 2, 3), ("d", 1, 1)]
    tied = page._replace(specificity=page.specificity.unionByName(page.specificity.where("change_seq = 2").withColumn("is_specific", F.lit(False))))
    assert sorted(r["change_seq"] for r in company.evidence(tied, 10).where("cik = 'c'").collect()) == [1, 2, 2, 3, 4]  # latest rows of one time all count


def test_empty_tables_and_tallies(spark):
    none = tables(spark)
    assert company.disclosures(none).count() == company.evidence(none, 5).count() == company.standing(none).count() == 0
    got = spark.range(1).select(company.tallied(F.array(*[F.lit(x) for x in ("b", None, "a", "", "a", "c")])).alias("t")).first()["t"]
    assert [tuple(x) for x in got] == [("other", 2), ("a", 2), ("b", 1), ("c", 1)]


def test_newest_rows_are_moved_once(spark):
    """Ties at the newest time stay, null keys and times go, and one exchange is enough."""
    at = lambda day: f"2024-01-0{day} 00:00:00"
    rows = [("a", "rf", "m", 1, at(1), 0), ("a", "rf", "m", 1, at(2), 1), ("a", "rf", "m", 1, at(2), 2), ("a", "rf", "m", 2, at(1), 3), (None, "rf", "m", 1, at(3), 4), ("b", "rf", "m", 1, None, 5)]
    df = spark.createDataFrame(rows, "accession_number string, section string, model_id string, change_seq int, judged_at string, k int").withColumn("judged_at", F.col("judged_at").cast("timestamp"))
    new = company.newest(df, "judged_at")
    assert sorted(r["k"] for r in new.collect()) == [1, 2, 3]
    assert new._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_versions_of_lines_read_the_lines_once(spark):
    from against_sql import DATA
    from tidemark.plans.company import _tables

    t = _tables(spark, DATA)
    for rows in (t.verdicts, t.specificity):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Union" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_changes_are_moved_once_by_filing_and_once_by_company(spark):
    """Tables of changes are put together where their filings lie, and companies get one exchange: nothing of a page is moved again for its order."""
    from against_sql import DATA
    from tidemark.plans.company import company_disclosures, disclosure_evidence

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [q(spark, DATA)._jdf.queryExecution().executedPlan().toString() for q in (company_disclosures, disclosure_evidence)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by = [re.findall(r"Exchange hashpartitioning\((\w+)#\d+[^)]*\)", p) for p in plans]
    assert [x.count("cik") for x in by] == [2, 1]  # of stable filings, too
    assert all("change_seq" not in x for p in plans for x in re.findall(r"Exchange hashpartitioning\(.*", p))


def test_limit_within_a_filing(spark, page):
    """Places go on from filing to filing; NaN counts most and null least; a company without a number is one."""
    at, nan = DAY(2024, 1, 1), float("nan")
    filings = [("a", None, "2023"), ("b", None, "2024"), ("c", None, None), ("d", "x", "2024")]
    sure = {"a": [0.5, 0.7, 0.7], "b": [None, 0.2, nan, 0.9], "c": [0.9], "d": [0.1]}
    keys = [(*key(i, f), c) for f, of in sure.items() for i, c in enumerate(of)]
    t = tables(
        spark,
        filings=filings,
        diffs=[(f, "rf", "m", "none") for f in sure],
        changes=[(*k[:4], "added", None, None, None) for k in keys],
        verdicts=[(*k[:4], True, "worse", "", "", k[4], False, at) for k in keys],
    )
    want = [("b", 2), ("b", 3), ("b", 1), ("b", 0), ("a", 1), ("a", 2), ("a", 0), ("c", 0)]
    for most in (1, 4, 6, 9):
        got = sorted((r["place"], r["accession_number"], r["change_seq"]) for r in company.evidence(t, most).where("cik is null").collect())
        assert got == [(i, *x) for i, x in enumerate(want[:most], 1)]
