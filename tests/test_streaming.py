"""Streams over landed files, with restarts."""

import datetime
import time

from pyspark.sql import functions as F
from tidemark.sources import listings
from tidemark.streaming import ingest

SCHEMA = "accession_number string, company_name string, updated_at string"


def land(folder, name, *entries):
    body = "".join(f'<entry><title>8-K - {c} (0000000042) (Filer)</title><id>accession-number=0000000042-24-{n:06d}</id><updated>{u}</updated></entry>' for n, c, u in entries)
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(f"<feed>{body}</feed>")


def run(spark, tmp_path, per_trigger=None):
    parsed = listings.feed(ingest.landed(spark, str(tmp_path / "in"), per_trigger)).select("accession_number", "company_name", "updated_at")
    q = ingest.ingest(parsed, str(tmp_path / "out"), SCHEMA, ["accession_number"], "updated_at", str(tmp_path / "ckpt"))
    q.awaitTermination()
    assert q.exception() is None
    return sorted((r["accession_number"][-1], r["company_name"]) for r in ingest.stored(spark, str(tmp_path / "out"), SCHEMA).collect())


def test_each_key_is_stored_once_over_restarts(spark, tmp_path):
    """Entries that come again in other files, in any order, within a batch and after a restart, and a re-scan by hand, twice."""
    assert ingest.stored(spark, str(tmp_path / "out"), SCHEMA).count() == 0
    land(tmp_path / "in", "a.xml", (1, "A", "2024-01-01T00:00:02Z"), (2, "B", "2024-01-01T00:00:03Z"), (1, "A0", "2024-01-01T00:00:01Z"))
    assert run(spark, tmp_path) == [("1", "A0"), ("2", "B")]
    assert run(spark, tmp_path) == [("1", "A0"), ("2", "B")]
    land(tmp_path / "in", "b.xml", (2, "B again", "2024-01-02T00:00:00Z"), (3, "C", "2024-01-02T00:00:00Z"))
    land(tmp_path / "in", "c.xml", (3, "C again", "2024-01-03T00:00:00Z"), (4, "D", "2024-01-03T00:00:00Z"))
    assert [k for k, _ in run(spark, tmp_path, per_trigger=1)] == ["1", "2", "3", "4"]
    listing = spark.createDataFrame([(f"0000000042-24-{n:06d}", "late", "2024-01-04") for n in (4, 5, 5)], SCHEMA)
    for _ in range(2):
        ingest.rescan(listing, str(tmp_path / "out"), SCHEMA, ["accession_number"], "updated_at", "day-4")
    assert [k for k, _ in run(spark, tmp_path)] == ["1", "2", "3", "4", "5"]


def test_a_batch_that_comes_again_is_written_anew(spark, tmp_path):
    store = ingest.append_once(str(tmp_path / "o"), SCHEMA, ["accession_number"], "updated_at")
    rows = spark.createDataFrame([("a", "x", "1"), ("b", "y", "1")], SCHEMA)
    for _ in range(2):
        store(rows, 0)
    store(rows.unionByName(spark.createDataFrame([("c", "z", "1")], SCHEMA)), 1)
    assert sorted(r[0] for r in ingest.stored(spark, str(tmp_path / "o"), SCHEMA).collect()) == ["a", "b", "c"]


def test_back_pressure_takes_all_in_turns(spark):
    entries = spark.createDataFrame([(f"k{i}", 9 - i) for i in range(10)], "id string, at int")
    done = entries.limit(0)
    seen = []
    for _ in range(4):
        batch = ingest.next_batch(entries, done, "id", 4, "at").collect()
        seen.append([r["at"] for r in batch])
        done = done.unionByName(spark.createDataFrame(batch, "id string, at int")) if batch else done
    assert [sorted(x) for x in seen] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], []]


def test_windows_and_late_rows_of_a_stream(spark, tmp_path):
    """Tumbling windows close behind the watermark; rows later than that are left out, others count."""
    (tmp_path / "e").mkdir()
    schema = "ts timestamp, value double"

    def write(name, *rows):
        (tmp_path / "e" / name).write_text("".join(f'{{"ts": "{t}", "value": {v}}}\n' for t, v in rows))

    def go():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "e"))
        q = ingest.bucketed(stream, "ts", "1 hour", "30 minutes", F.sum("value").alias("total")).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "w"))
        q.awaitTermination()
        return sorted((r["start"].hour, r["calls"], r["total"]) for r in spark.read.parquet(str(tmp_path / "w")).collect())

    write("1.json", ("2024-01-01T10:05:00", 1), ("2024-01-01T10:50:00", 2), ("2024-01-01T11:20:00", 4))
    go()
    time.sleep(0.1)
    write("2.json", ("2024-01-01T10:55:00", 8), ("2024-01-01T13:10:00", 1))
    got = go()
    write("3.json", ("2024-01-01T10:59:00", 99), ("2024-01-01T15:10:00", 1))
    got = go()
    assert got[0] == (10, 3, 11.0) and got[1] == (11, 1, 4.0)


def test_once_within_a_watermark(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.json").write_text('{"k": "a", "ts": "2024-01-01T10:00:00"}\n{"k": "a", "ts": "2024-01-01T10:01:00"}\n{"k": "b", "ts": "2024-01-01T10:00:00"}\n')
    stream = spark.readStream.schema("k string, ts timestamp").json(str(tmp_path / "e"))
    q = ingest.once_within(stream, "k", "ts", "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "w"))
    q.awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "w")).collect()) == ["a", "b"]


def test_polls_windows_and_cursors(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 10, 0, s // 1000, s % 1000 * 1000)
    rows = spark.createDataFrame([(1, at(1000)), (2, at(1500)), (3, at(2000)), (4, None)], "id int, at timestamp")
    assert [r["id"] for r in ingest.since(rows, "at", "2024-01-01 10:00:01").collect()] == [3]
    assert [r["id"] for r in ingest.since(rows, "at", "2024-01-01 09:00:00", most=2).collect()] == [3, 2]
    assert sorted(r["id"] for r in ingest.window_of(rows, "at", "2024-01-01 10:00:01.6", 1).collect()) == [1, 2]
    cursor = spark.createDataFrame([(1, None, None)], "id int, last_accession_number string, last_filed_at string")
    done = spark.createDataFrame([("a2", "20240102"), ("a1", "20240103"), ("a3", "20240103")], "accession_number string, filed_at string")
    moved = ingest.advanced(cursor, done)
    assert tuple(moved.first()) == (1, "a3", "20240103") == tuple(ingest.advanced(moved, done.where("filed_at = '20240102'")).first()) == tuple(ingest.advanced(moved, done.limit(0)).first())
    days = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "day int, complete boolean")
    assert ingest.ingested_through(days).first()[0] == 2 and ingest.ingested_through(days.where("complete")).first()[0] == 4 and ingest.ingested_through(days.where("not complete")).first()[0] is None


def test_draining_alerts(spark):
    """Stale info, an old warning, a key delivered within and before the window, two of a key in one pass, an unknown route, a sender that fails."""
    t = lambda m: datetime.datetime(2024, 1, 1, 12, 0) - datetime.timedelta(minutes=m)
    rows = [
        (1, "info", "k1", t(31), None, 0, None), (2, "warning", "k2", t(500), None, 0, None), (3, "critical", "k3", t(5), None, 0, None), (4, "critical", "k3", t(300), t(100), 1, None), (5, "warning", "k4", t(5), None, 0, None),
        (6, "warning", "k4", t(900), t(300), 1, None), (7, "warning", "k5", t(4), None, 0, None), (8, "warning", "k5", t(3), None, 0, None), (9, "warning", None, t(2), None, 0, None), (10, "critical", "bad", t(1), None, 2, "old"), (11, "other", "x", t(1), None, 0, None),
    ]
    outbox = spark.createDataFrame([(*r, "title", "body") for r in rows], "id long, severity string, dedup_key string, created_at timestamp, delivered_at timestamp, attempts int, last_error string, title string, body string")
    sent = []

    def send(alert):
        if alert["dedup_key"] == "bad":
            raise RuntimeError("no route to host")
        sent.append(alert["id"])

    after = {r["id"]: r for r in ingest.drained(outbox, "2024-01-01 12:00:00", send).collect()}
    assert sorted(sent) == [2, 5, 7, 9] and {i for i, r in after.items() if r["delivered_at"] is None} == {10, 11}
    assert (after[10]["attempts"], after[10]["last_error"], after[11]["attempts"], after[4]["delivered_at"]) == (3, "no route to host", 0, t(100))
    again = ingest.drained(spark.createDataFrame(list(after.values()), outbox.schema), "2024-01-01 12:01:00", send)
    assert sorted(sent) == [2, 5, 7, 9] and again.where("delivered_at is null").count() == 2


def test_null_keys_are_stored_once_and_state_spares_history(spark, tmp_path):
    """With a time the stream's keys are kept as state; a null key is one key, in whatever batch and from a re-scan."""
    from tidemark.streaming import state

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    state.uses_rocksdb(spark)
    schema = "k string, v string, at timestamp"
    at = datetime.datetime(2024, 1, 1)
    try:
        for i in range(2):
            spark.createDataFrame([(None, str(i), at), (f"k{i}", str(i), at)], schema).write.parquet(f"{tmp_path}/in/{i}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            q = ingest.ingest(stream, f"{tmp_path}/out", schema, ["k"], "v", f"{tmp_path}/c", at="at")
            q.awaitTermination()
            assert q.exception() is None
            ingest.rescan(spark.createDataFrame([(None, "9", at), ("k0", "9", at), ("r", "9", at)], schema), f"{tmp_path}/out", schema, ["k"], "v")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    assert sorted((r["k"] or "", r["v"]) for r in ingest.stored(spark, f"{tmp_path}/out", schema).collect()) == [("", "0"), ("k0", "0"), ("k1", "1"), ("r", "9")]
