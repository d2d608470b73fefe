"""The chain from listing to events: killed after each step and run again it gives one clean run's tables, and asks nothing twice."""

import json
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from tidemark.operators.calls import Caller
from tidemark.streaming import chain
from tidemark.streaming.store import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this file
ASOF, LATER, VERSION, LEAVES = "2024-02-01 00:00:00", "2024-02-01 01:00:00", "v1", ("ma_activity", "exec_departure", "other_material")
ENTRY = "accession_number string, form string, company_name string, cik string, ticker string, filing_date string, url string"
ENTRIES = [("f1", "8-K", "One", "1", "T", "2024-01-05", "u1"), ("f2", "8-K", "Two", "2", None, "2024-01-06", "u2"), ("f3", "8-K", "Three", "3", None, "2024-01-07", "u3"), ("f4", "8-K", "Four", "4", None, "2024-01-08", "gone")]


def page(url):
    if url == "u1":
        return json.dumps({"body_text": "b", "sections": [{"number": "1.01", "text": "deal"}, {"number": "5.02", "text": "officer"}]})
    return json.dumps({"body_text": f"body of {url}"})


def label(text):
    return json.dumps({"event_type": "exec_departure" if "officer" in text else "ma_activity", "is_material": True, "confidence": 0.9, "reasoning": "r"})


def merged(text):
    return json.dumps({"events": [{"event_type": "ma_activity", "is_material": True, "confidence": 1, "summary": "s", "anchor_item_number": "1.01", "contributing_item_numbers": ["1.01", "5.02"]}]})


class World:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, Path(folder)
        self.folder.mkdir()
        self.db = chain.store(spark, f"{folder}/db")
        self.broken = self.folder / "broken"
        self.broken.write_text("gone")
        self.outside = chain.Outside(*(Caller(spark, f"{folder}/log-{n}", self.noted(n, f), batch=2) for n, f in (("fetch", page), ("classify", label), ("reduce", merged))))

    def noted(self, name, answer):
        at, broken = str(self.folder / name), str(self.broken)
        Path(at).mkdir()

        def call(texts):
            import uuid

            down = Path(broken).read_text().split(",")
            good = [(i, t) for i, t in enumerate(texts) if not any(w and w in t for w in down)]
            Path(at, uuid.uuid4().hex).write_text(json.dumps([t for _, t in good]))
            return [(i, answer(t)) for i, t in good]

        return call

    def answered(self, name):
        return sorted(t for f in (self.folder / name).iterdir() for t in json.loads(f.read_text()))

    def process(self, rows, batch):
        return chain.process(self.db, self.spark.createDataFrame(rows, ENTRY), batch, self.outside, VERSION, LEAVES, ASOF)

    def tables(self):
        plain = lambda r: json.dumps(r.asDict(True), default=str, sort_keys=True)
        return {n: sorted(plain(r) for r in self.db.read(n).collect()) for n in chain.TABLES}


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    world = World(spark, tmp_path_factory.mktemp("chain") / "clean")
    world.process(ENTRIES, 0)
    return world


def test_a_clean_run(clean):
    t = clean.tables()
    assert [len(t[n]) for n in ("filings", "classifications", "events", "attempts")] == [4, 4, 3, 1] and "not fetched" in t["attempts"][0]
    assert clean.answered("fetch") == ["u1", "u2", "u3"] and len(clean.answered("classify")) == 4 and len(clean.answered("reduce")) == 1
    assert clean.process(ENTRIES, 0) is None and clean.tables() == t
    assert sorted((r["accession_number"], r["event_type"]) for r in chain.current_events(clean.db).collect()) == [("f1", "ma_activity"), ("f2", "ma_activity"), ("f3", "ma_activity")]


@pytest.mark.parametrize("step", ["classified", "before the commit"])
def test_killed_after_a_step_and_run_again(spark, tmp_path, monkeypatch, clean, step):
    world = World(spark, tmp_path / "own")

    def killed(*a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        if step == "classified":
            real = world.outside.classify.ask
            m.setattr(world.outside.classify, "ask", lambda *a: (real(*a), killed()))
        else:  # fetched, classified, reduced and written
            m.setattr(world.db, "_put", killed)
        world.process(ENTRIES, 0)
    assert world.db.state()["number"] == 0  # nothing of the batch shows
    assert world.process(ENTRIES, 0) == 1 and world.tables() == clean.tables()
    assert [world.answered(n) for n in ("fetch", "classify", "reduce")] == [clean.answered(n) for n in ("fetch", "classify", "reduce")]


def test_orphans_heal_or_are_given_up(spark, tmp_path):
    world = World(spark, tmp_path / "own")
    world.broken.write_text("body of u2,body of u3,gone")
    world.process(ENTRIES, 0)
    heal = lambda n: chain.heal(world.db, n, world.outside, VERSION, LEAVES, LATER)
    waiting = lambda: sorted(r["accession_number"] for r in chain.orphans(world.db, LATER).collect())
    assert waiting() == ["f2", "f3"] and chain.orphans(world.db, ASOF).count() == 0  # too young
    world.broken.write_text("body of u3,gone")
    heal(0)
    assert waiting() == ["f3"] and sorted(r["accession_number"] for r in chain.current_events(world.db).collect()) == ["f1", "f2"]
    assert heal(0) is None
    heal(1)
    assert waiting() == []  # three attempts


def test_a_stream_of_listings(spark, tmp_path, clean):
    world = World(spark, tmp_path / "own")
    for i, rows in enumerate((ENTRIES[:1], ENTRIES)):
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(ENTRY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = chain.run(world.db, stream, f"{tmp_path}/checkpoint", world.outside, VERSION, LEAVES, ASOF)
    q.awaitTermination()
    assert q.exception() is None and world.db.state()["writers"] == {"chain": 1}
    assert world.tables()["classifications"] == clean.tables()["classifications"] and world.answered("fetch") == ["u1", "u2", "u3"]
