"""Commits: whole or not at all, each batch once, writers at once, compaction."""

import threading

import pytest
from pyspark.sql import functions as F
from tidemark.streaming import store
from tidemark.streaming.store import Conflict, Store, Table

TABLES = {"entries": Table("k string, v long", ("k",), "once", "v"), "facts": Table("k string, v long", ("k",), "last", "v"), "log": Table("k string, v long")}


@pytest.fixture
def db(spark, tmp_path):
    return Store(spark, str(tmp_path / "db"), TABLES)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v long")


def got(db, name):
    return sorted(((r["k"] is None, r["k"] or "", r["v"]) for r in db.read(name).collect()))


def test_nothing_before_the_first_commit(db):
    assert [db.read(n).count() for n in TABLES] == [0, 0, 0] and db.state()["number"] == 0 and db.compact("log") is None


def test_each_kind(spark, db):
    db.commit({n: rows(spark, ("a", 2), ("a", 1), (None, 5), (None, 4)) for n in TABLES}, "w", 0)
    db.commit({n: rows(spark, ("a", 9), ("b", 7), (None, 8)) for n in TABLES}, "w", 1)
    assert got(db, "entries") == [(False, "a", 1), (False, "b", 7), (True, "", 4)]
    assert got(db, "facts") == [(False, "a", 9), (False, "b", 7), (True, "", 8)]
    assert db.read("log").count() == 7
    before = {n: got(db, n) for n in TABLES}
    assert all(db.compact(n) for n in TABLES) and {n: got(db, n) for n in TABLES} == before and db.compact("facts") is None
    assert len(db.state()["folders"]["log"]) == 1 and len(db.unnamed("log")) == 2


def test_a_batch_that_comes_again_changes_nothing(spark, db):
    assert db.commit({"log": rows(spark, ("a", 1))}, "w", 3) == 1
    assert db.commit({"log": rows(spark, ("a", 1))}, "w", 3) is None is db.commit({"log": rows(spark, ("a", 1))}, "w", 2)
    assert db.read("log").count() == 1


def test_a_writer_that_dies_leaves_nothing_to_see(spark, db, monkeypatch):
    db.commit({n: rows(spark, ("a", 1)) for n in TABLES}, "w", 0)
    for at in (1, 2, 3):  # after the first, the second, the third table
        wrote = []

        def dies(self, name, data, real=Store._write, wrote=wrote, at=at):
            wrote.append(real(self, name, data))
            if len(wrote) == at:
                raise RuntimeError("killed")
            return wrote[-1]

        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(Store, "_write", dies)
            db.commit({n: rows(spark, ("b", 2)) for n in TABLES}, "w", 1)
        assert [db.read(n).count() for n in TABLES] == [1, 1, 1]
    assert db.commit({n: rows(spark, ("b", 2)) for n in TABLES}, "w", 1) == 2 and [db.read(n).count() for n in TABLES] == [2, 2, 2]


def test_writers_at_once_store_each_key_once(spark, db):
    """A stream and re-scans write the same keys in their own order: every number goes to one of them, the others look again."""
    errors = []

    def write(writer):
        try:
            for b in range(3):
                db.commit({"entries": spark.range(b * 5, b * 5 + 20).select(F.col("id").cast("string").alias("k"), F.lit(b).cast("long").alias("v"))}, writer, b)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in ("stream", "rescan", "rescan2")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and db.numbers() == list(range(1, 10))
    keys = [r["k"] for r in db.read("entries").collect()]
    assert sorted(keys) == sorted(str(i) for i in range(30))


def test_numbers_are_put_once(db):
    db._put({"number": 1, "writers": {}, "folders": {}})
    with pytest.raises(Conflict):
        db._put({"number": 1, "writers": {"x": 1}, "folders": {}})
    assert db.state()["writers"] == {}


def test_by_rename_where_links_are_missing(spark, tmp_path):
    """The other way of putting a file, as for stores that aren't a local disk."""
    db = Store(spark, str(tmp_path / "db"), TABLES)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    db.files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(db._path(f"file://{tmp_path}").toUri(), conf)
    db.path = f"file://{tmp_path}/db"
    assert db.commit({"log": rows(spark, ("a", 1))}, "w", 0) == 1 and db.read("log").count() == 1
    with pytest.raises(store.Conflict):
        db._put({"number": 1, "writers": {}, "folders": {}})


def test_known_new_reads_only_others(spark, db, monkeypatch):
    db.commit({"entries": rows(spark, ("a", 1))}, "stream", 0)
    db.commit({"entries": rows(spark, ("b", 1))}, "rescan", 0)
    seen = []
    real = Store.without
    monkeypatch.setattr(Store, "without", lambda self, name, data, folders: seen.append([f["w"] for f in folders]) or real(self, name, data, folders))
    db.commit({"entries": rows(spark, ("b", 2), ("c", 2))}, "stream", 1, known_new=True)
    assert seen == [["rescan"]] and got(db, "entries") == [(False, "a", 1), (False, "b", 1), (False, "c", 2)]
    db.commit({"entries": rows(spark, ("d", 2))}, "stream", 2, known_new=True)
    db.compact("entries")
    assert sorted(f["w"] for f in db.state()["folders"]["entries"]) == ["rescan", "stream"]
