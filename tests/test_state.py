"""Keyed state: first rows, daily budgets, re-opened verdicts, each against a batch version and over a restart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidemark.streaming import state
from tidemark.streaming.store import Store, Table

T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    state.uses_rocksdb(spark)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


class Feed:
    """A folder that lands a file a batch, a query over it, and what it gave."""

    def __init__(self, spark, folder, schema, build):
        self.spark, self.folder, self.schema, self.build, self.n = spark, folder, schema, build, 0

    def land(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.n:03d}")

    def run(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in")
        q = self.build(stream).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        return q

    def out(self):
        return self.spark.read.parquet(f"{self.folder}/out")


def test_first_rows_over_restarts(spark, rocks, tmp_path):
    feed = Feed(spark, str(tmp_path), "k string, v long, at timestamp", lambda s: state.first_seen(s, ["k"], "at", "v", "1 day", 48))
    batches = [[("a", 2, T0), ("a", 1, T0), (None, 7, T0), (None, 6, T0), ("b", 3, T0 + timedelta(hours=1))], [("a", 9, T0), (None, 9, T0), ("c", 4, T0 + timedelta(hours=2))], [("b", 1, T0), ("c", 1, T0), ("d", 5, T0 + timedelta(hours=3))]]
    for rows in batches:  # a restart after each
        feed.land(rows)
        feed.run()
    assert sorted(((r["k"] or "", r["v"]) for r in feed.out().collect())) == [("", 6), ("a", 1), ("b", 3), ("c", 4), ("d", 5)]


def test_keys_are_forgotten_and_late_rows_dropped(spark, rocks, tmp_path):
    feed = Feed(spark, str(tmp_path), "k string, v long, at timestamp", lambda s: state.first_seen(s, ["k"], "at", "v", "1 hour", 24))
    for rows in ([("a", 1, T0)], [("x", 2, T0 + timedelta(days=3))], [("late", 3, T0)], [("a", 4, T0 + timedelta(days=3, minutes=1))]):
        feed.land(rows)
        q = feed.run()
    assert sorted((r["k"], r["v"]) for r in feed.out().collect()) == [("a", 1), ("a", 4), ("x", 2)]
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4  # two keys and their timers


def test_a_batch_costs_what_it_holds_itself(spark, rocks, tmp_path):
    """The store compares a batch of new keys with other writers' folders alone, whatever the stream has stored before."""
    db = Store(spark, str(tmp_path / "db"), {"e": Table("k string, v long, at timestamp", ("k",), "once", "at")})
    read = []

    def sink(batch, number):
        real = db.rows_of
        db.rows_of = lambda name, folders: read.append(len(folders)) or real(name, folders)
        db.commit({"e": batch}, "stream", number, known_new=True)
        db.rows_of = real

    schema = "k string, v long, at timestamp"
    for i in range(4):
        spark.createDataFrame([(f"{i}-{j}", j, T0) for j in range(5)] + [("same", i, T0)], schema).write.parquet(f"{tmp_path}/in/{i}")
        stream = state.first_seen(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), ["k"], "at", "v", "1 day", 48)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        db.commit({"e": spark.createDataFrame([(f"{i}-0", 9, T0), ("rescan", 9, T0)], schema)}, "rescan", i)
    assert db.read("e").count() == 22 and db.read("e").select("k").distinct().count() == 22 and max(read) <= 4


def decided(rows, warn, cap):
    """The same in plain code: rows (id, at, cost) in batches."""
    out, waiting, day, spent, warned = [], [], None, 0.0, False

    def go(own):
        nonlocal spent, warned, waiting
        held = []
        for r in [*waiting, *own]:
            if spent >= cap:
                held.append(r)
                continue
            spent += r[2]
            crossed = spent >= warn and not warned
            warned = warned or crossed
            out.append((r[0], day, round(spent, 6), "warn" if crossed else "go"))
        waiting = held

    for batch in rows:
        for d in sorted({r[1].date() for r in batch}):
            if day is None or d > day:
                day, spent, warned = d, 0.0, False
            go(sorted((r for r in batch if r[1].date() == d), key=lambda r: (r[1], r[0])))
    return out, waiting


def test_budget_stops_and_goes_on_next_day(spark, rocks, tmp_path):
    hour = timedelta(hours=1)
    batches = [[(i, T0 + i * hour, 1.5) for i in range(3)], [(i, T0 + i * hour, 0.7) for i in range(3, 8)], [(20, T0 + timedelta(days=1, hours=1), 0.5)], [(21, T0 + timedelta(days=1, hours=2), 9.0), (22, T0 + timedelta(days=1, hours=3), 1.0)], [(30, T0 + timedelta(days=3), 1.0)]]
    feed = Feed(spark, str(tmp_path), "id long, at timestamp, usd double, gate string", lambda s: state.within_daily_budget(s, "gate", "at", "usd"))
    for rows in batches:  # a restart after each keeps the sum
        feed.land([(*r, "g") for r in rows])
        feed.run()
    got = [(r["id"], r["spent_day"].date(), round(r["spent"], 6), r["decision"]) for r in feed.out().orderBy("spent_day", "spent", "id").collect()]
    day1 = [g for g in got if g[1] == T0.date()]
    assert [g[0] for g in day1] == [0, 1, 2, 3] and [g[3] for g in day1] == ["go", "go", "warn", "go"] and day1[-1][2] == 5.2
    assert sorted(g[0] for g in got) == [0, 1, 2, 3, 4, 5, 6, 7, 20, 21, 22, 30]  # nothing is lost
    want, waiting = decided(batches, 4.0, 5.0)
    assert not waiting and sorted(g[0] for g in got) == sorted(w[0] for w in want)
    assert {g[0]: g[1] for g in got} == {w[0]: w[1] for w in want}


def test_verdicts_open_again_as_in_a_batch(spark, tmp_path):
    day = timedelta(days=1)
    verdicts = [[("r1", "c", T0), ("r2", "d", T0), ("r3", None, T0)], [("r4", "c", T0 + 2 * day)], [("r5", "z", T0 + 40 * day)]]
    events = [[("c", T0 - day, "before")], [("c", T0 + day, "e1"), ("d", T0 + 20 * day, "too late"), (None, T0 + day, "none")], [("c", T0 + 3 * day, "e2"), ("z", T0 + 40 * day, "same time")]]
    vs, es = "risk_id string, cik string, checked_at timestamp", "cik string, filed_at timestamp, event_id string"
    for i, (v, e) in enumerate(zip(verdicts, events)):
        spark.createDataFrame(v, vs).write.parquet(f"{tmp_path}/v/{i}")
        spark.createDataFrame(e, es).write.parquet(f"{tmp_path}/e/{i}")
        read = lambda part, schema: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{part}")
        q = state.reopened(read("v", vs), read("e", es), "1 day", "10 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r["risk_id"], r["event_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    all_v, all_e = [x for b in verdicts for x in b], [x for b in events for x in b]
    opened = {(r, e) for r, c, at in all_v for k, t, e in all_e if c is not None and c == k and at < t <= at + 10 * day}
    assert {g for g in got if g[1]} == opened == {("r1", "e1"), ("r1", "e2"), ("r4", "e2")}
    assert {g[0] for g in got if not g[1]} == {"r2", "r3"}  # closed for good: no event of theirs can come any more
    assert sum(s["numRowsTotal"] for s in q.recentProgress[-1]["stateOperators"]) <= 4  # what is older is gone
