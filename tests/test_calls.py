"""Calls outside Spark: each row once, failures alone again, batches in order, waits; and jobs that lose nothing."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tidemark.operators import calls, jobs
from tidemark.operators.calls import Caller, Passing, attempted

ASOF = "2024-02-01 00:00:00"


def counting(folder, answer, fails=()):
    """A call that notes each text it is asked in a file, as it runs in other processes."""
    Path(folder).mkdir(exist_ok=True)

    def call(texts):
        import uuid

        Path(folder, uuid.uuid4().hex).write_text(json.dumps(texts))
        for i, t in reversed(list(enumerate(texts))):  # answers come in any order
            if not any(f in t for f in fails):
                yield i, answer(t)

    return call


def asked(folder):
    return sorted(t for f in Path(folder).iterdir() for t in json.loads(f.read_text()))


def test_answers_are_put_in_order_and_errors_waited_out():
    waits, n = [], []

    def call(texts):
        n.append(1)
        if len(n) < 3:
            raise Passing("busy")
        yield from [(2, "c"), (0, "a"), (9, "nobody's")]

    assert attempted(call, ["x", "y", "z"], 4, 0.5, sleep=waits.append) == (["a", None, "c"], [None, "no answer", None], 3) and waits == [0.5, 1.0]
    assert attempted(lambda t: 1 / 0, ["x"], 4, 0.5, sleep=waits.append) == ([None], ["ZeroDivisionError: division by zero"], 1) and len(waits) == 2

    def never(texts):
        raise Passing("down")

    assert attempted(never, ["x"], 2, 1, sleep=lambda s: None) == ([None], ["Passing: down"], 2)
    assert attempted(lambda t: [(0, "bad")], ["x"], 2, 1, accept=lambda a: a != "bad") == ([None], ["not acceptable"], 1)


def test_each_row_is_asked_once_and_failed_ones_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(40, None)], "id long, text string")
    caller = Caller(spark, str(tmp_path / "log"), counting(tmp_path / "n", str.upper, fails=("3",)), batch=7)
    got = caller.ask(rows, ["id"], "s", "v1")
    want = sorted(f"TEXT {i}" for i in range(40) if "3" not in str(i))
    assert sorted(r["raw"] for r in got.collect()) == want and got.count() == len(want)  # read twice, asked once
    assert asked(tmp_path / "n") == sorted(f"text {i}" for i in range(40))
    failed = caller.failed("s", "v1").collect()
    assert {r["error"] for r in failed} == {"no answer"} and len(failed) == 40 - len(want)
    caller.call = counting(tmp_path / "again", str.upper)
    assert caller.ask(rows, ["id"], "s", "v1").count() == 40 and asked(tmp_path / "again") == sorted(f"text {i}" for i in range(40) if "3" in str(i))
    caller.call = counting(tmp_path / "third", str.upper)
    assert caller.ask(rows.withColumn("text", F.when(F.col("id") == 5, "another question").otherwise(F.col("text"))), ["id"], "s", "v1").count() == 40
    assert asked(tmp_path / "third") == ["another question"] and caller.ask(rows, ["id"], "s", "v2").count() == 40 and len(asked(tmp_path / "third")) == 41


def test_given_up_after_so_many_failures(spark, tmp_path):
    rows = spark.createDataFrame([(1, "bad"), (2, "good")], "id long, text string")
    caller = Caller(spark, str(tmp_path / "log"), counting(tmp_path / "n", str.upper, fails=("bad",)), most_failures=2)
    for _ in range(4):
        assert [r["id"] for r in caller.ask(rows, ["id"], "s", "v").collect()] == [2]
    assert asked(tmp_path / "n") == ["bad", "bad", "good"] and caller.failed("s", "v").first()["failures"] == 2


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_column_judges_are_evaluated_once(spark, tmp_path):
    """No filter copies the judge: a counting function sees each row once, and the plan has it once."""
    folder = str(tmp_path / "n")
    Path(folder).mkdir()

    @F.pandas_udf("string")
    def judge(t):
        import uuid

        Path(folder, uuid.uuid4().hex).write_text(json.dumps(t.tolist()))
        return t.map(lambda x: None if "3" in x else '{"is_material": true, "category": "cyber"}')

    changes = spark.createDataFrame([("a", "rf", "m", i, "added", i, None, "p") for i in range(10)], "accession_number string, section string, model_id string, change_seq int, change_type string, current_block_index int, prior_block_index int, prior_accession_number string")
    blocks = spark.createDataFrame([("a", "rf", i, f"block {i}") for i in range(10)], "accession_number string, section string, block_index int, block_text string")
    none = spark.createDataFrame([], "accession_number string, section string, model_id string, change_seq int, judge_version string")
    out = jobs.judge_gap(changes, blocks, none, "j", judge, ("cyber",), ASOF)
    assert out.count() == 9 and len(asked(folder)) == 10 and plan_of(out).count("ArrowEvalPython") == 1

    @F.pandas_udf("array<double>")
    def embed(t):
        import uuid

        Path(folder, uuid.uuid4().hex).write_text(json.dumps(t.tolist()))
        return t.map(lambda x: [1.0, 2.0])

    vectors = spark.createDataFrame([], "accession_number string, section string, block_index int, model_id string")
    assert jobs.embed_gap(blocks, vectors, "m", embed, ASOF).where("dim = 2").count() == 10 and len(asked(folder)) == 20


@pytest.fixture
def filings(spark):
    section = "array<struct<number:string,text:string>>"
    rows = [("f1", "8-K", "Co", "1", "T", "2024-01-05", "body", [("1.01", "deal text"), ("5.02", "officer text"), ("9.01", "exhibits")], None), ("f2", "8-K", "Co", "1", None, "2024-01-06", "whole body", None, None)]
    return spark.createDataFrame(rows, f"accession_number string, form string, company_name string, cik string, ticker string, filing_date string, body_text string, sections {section}, exhibits array<struct<exhibit_type:string,text:string>>")


def test_a_failed_section_comes_back(spark, tmp_path, filings):
    none = spark.createDataFrame([], "accession_number string, classifier_version string")
    answer = lambda t: json.dumps({"event_type": "ma_activity", "is_material": True, "confidence": 0.9, "reasoning": "r"})
    caller = Caller(spark, str(tmp_path / "log"), counting(tmp_path / "n", answer, fails=("officer",)), batch=2)
    leaves = ("ma_activity", "other_material")
    first = jobs.classify_gap(filings, none, "v", caller, leaves, ASOF)
    rows = [(r["accession_number"], r["item_number"]) for r in first.collect()]
    assert rows == [("f2", None)] and len(asked(tmp_path / "n")) == 3
    stored = first.select("accession_number", "classifier_version")
    caller.call = counting(tmp_path / "again", answer)
    second = jobs.classify_gap(filings, stored, "v", caller, leaves, ASOF)
    assert sorted((r["accession_number"], r["item_number"]) for r in second.collect()) == [("f1", "1.01"), ("f1", "5.02")]
    assert len(asked(tmp_path / "again")) == 1 and "officer" in asked(tmp_path / "again")[0]
    third = jobs.classify_gap(filings, stored.unionByName(second.select("accession_number", "classifier_version")), "v", caller, leaves, ASOF)
    assert third.count() == 0 and len(asked(tmp_path / "again")) == 1
    column = lambda t: F.when(~F.contains(t, F.lit("officer")), F.lit(answer("")))
    assert [r["accession_number"] for r in jobs.classify_gap(filings, none, "v", column, leaves, ASOF).collect()] == ["f2"]


def test_embeddings_through_a_log(spark, tmp_path):
    blocks = spark.createDataFrame([("a", "rf", i, f"block {i}") for i in range(5)], "accession_number string, section string, block_index int, block_text string")
    none = spark.createDataFrame([], "accession_number string, section string, block_index int, model_id string")
    caller = Caller(spark, str(tmp_path / "log"), counting(tmp_path / "n", lambda t: json.dumps([float(t[-1]), 1.0])), batch=2)
    out = jobs.embed_gap(blocks, none, "m", caller, ASOF)
    assert sorted((r["block_index"], r["dim"], list(r["embedding"])) for r in out.collect()) == [(i, 2, [float(i), 1.0]) for i in range(5)] and len(asked(tmp_path / "n")) == 5
    assert calls.OUTCOMES.kind == "all"
