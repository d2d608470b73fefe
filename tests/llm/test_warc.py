import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from tidemark.llm import warc
from tidemark.llm.common import shared_dir


def test_payloads_come_back(spark):
    rows = [(i, f"http://h/{i}", "" if i == 3 else "<html>" + "ä" * (i * 37 % 400)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.read_records(warc.read_index(warc.write_archives(warc.with_revisits(pages)))).collect()
    assert len(got) == 60
    payload = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    for r in got:
        whole = payload[r["refers_to"] if r["record_type"] == "revisit" else r["page_id"]]
        assert whole.decode() == rows[r["page_id"]][2]


def test_small_packages_ranges_and_long_payloads(spark):
    """A partition's pages over several packages, an index read in small chunks, repeated rows, a payload of a megabyte."""
    rows = [(i, None, "x" * (1 << 20) if i == 7 else f"page {i} " * 40) for i in range(50)] + [(3, None, "page 3 " * 40)]
    pages = warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string"))
    paths = warc.write_archives(pages.coalesce(2), package_bytes=700)
    assert paths.count() > 4
    index = warc.read_index(paths)
    assert index.count() == 51 and warc.by_ranges(index, 256).rdd.getNumPartitions() > 8
    got = warc.read_records(warc.by_ranges(index, 256)).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == sorted((i, len(t)) for i, _, t in rows)
    assert all(r["record_type"] == "response" for r in got)

    class Text:
        def __init__(self, raw):
            self.raw = raw

        def read_at(self, n, at):
            return self.raw[at : at + n]

    raw = b"head" + b"\n".join(b"line %d" % i for i in range(99))
    assert list(warc.member_lines(Text(raw), 4, len(raw) - 4, 7)) == raw[4:].split(b"\n")


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_zip64_directory(spark):
    """The standard library writes ZIP64 extras when forced to; the reader finds names, places and sizes."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
            f.write(b"first")
        z.writestr("b", b"second")
        for i in range(70_000):  # more members than the short end record can count
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
    f = pa.BufferReader(raw.getvalue())
    members = warc.directory(f, f.size())
    assert len(members) == 70_002
    at = {name: (warc.member_range(f, offset), size) for name, _, offset, size in members[:2]}
    assert f.read_at(5, at["a"][0]) == b"first" and f.read_at(6, at["b"][0]) == b"second" and at["b"][1] == 6


def test_shared_folder_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
