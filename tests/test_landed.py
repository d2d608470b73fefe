"""Landed days: cursor, gaps, restarts, parts of files, re-scans."""

import pytest
from tidemark.sources import landed


@pytest.fixture
def feed(spark, tmp_path):
    spark.dataSource.register(landed.LandedDays)

    class Feed:
        path = str(tmp_path / "days")

        def land(self, day, complete=True, **files):
            at = tmp_path / "days" / day
            at.mkdir(parents=True, exist_ok=True)
            for name, text in files.items():
                (at / name).write_bytes(text)
            if complete:
                (at / "_COMPLETE").touch()

        def run(self):
            rows = spark.readStream.format("landed_days").option("path", self.path).option("partBytes", 7).load()
            q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
            return landed.cursor_of(q.lastProgress) if q.lastProgress and q.lastProgress["sources"][0]["endOffset"] else None

        def out(self):
            return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return Feed()


def test_cursor_waits_for_the_first_gap(spark, feed):
    feed.land("2024-01-02", a=b"one\ntwo, a longer line\n\nlast without end", b=b"x\r\ny\n")
    feed.land("2024-01-03", complete=False, a=b"not yet\n")
    feed.land("2024-01-04", a=b"behind the gap\n")
    assert feed.run() == "2024-01-02"
    day = [("2024-01-02", "a", x) for x in ("", "last without end", "one", "two, a longer line")] + [("2024-01-02", "b", "x"), ("2024-01-02", "b", "y")]
    assert feed.out() == sorted(day)
    feed.land("2024-01-03")
    assert feed.run() == "2024-01-04"  # the restart goes on at the cursor
    assert feed.out() == sorted(day + [("2024-01-03", "a", "not yet"), ("2024-01-04", "a", "behind the gap")])


def test_lines_belong_to_one_part_each(tmp_path):
    text = b"".join(b"%d%s\n" % (i, b"x" * (i % 13)) for i in range(200))
    (tmp_path / "2024-01-01").mkdir()
    (tmp_path / "2024-01-01" / "f").write_bytes(text)
    (tmp_path / "2024-01-01" / "_COMPLETE").touch()
    for size in (1, 5, 64, 10_000):
        folder = landed._Folder({"path": str(tmp_path), "partbytes": size})
        lines = [x[2] for p in folder.parts("", folder.through()) for x in folder.read(p)]
        assert lines == text.decode().splitlines()


def test_rescan_of_given_days_and_nothing(spark, feed):
    read = lambda **o: sorted(r["line"] for r in spark.read.format("landed_days").option("path", feed.path).options(**o).load().collect())
    assert read() == []
    feed.land("2024-01-01", a=b"1\n")
    feed.land("2024-01-02", complete=False, a=b"2\n")
    feed.land("2024-01-03", a=b"3\n")
    assert read() == ["1"] and read(startDay="2024-01-02", throughDay="2024-01-03") == ["2", "3"]
