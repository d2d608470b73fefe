import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tidemark.llm import packing
from tidemark.llm.queries import tokenizer_path
from tokenizers import Tokenizer

SPECIAL = ["<|endoftext|> hi", "a<|startoftext|>b <|ENDOFTEXT|>", "<|endoftext|>", "x <| endoftext |> y"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check(tokenizer, spark, rows):
    """Every row's ids lie once in gapless sequences. Rows may repeat, so pieces are counted by (doc_id, start)."""
    want, seen, places = defaultdict(int), defaultdict(int), defaultdict(list)
    for i, t in rows:
        ids = ids_of(tokenizer, t)
        want[i] += len(ids)
    by_id = {i: ids_of(tokenizer, t) for i, t in rows}
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3), tokenizer_path()).collect():
        if r["doc_id"] is not None:
            ids = by_id[r["doc_id"]]
            assert len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == want
    for seq, parts in places.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or seq == max(places)


def test_pieces_hold_every_id_once(spark, tokenizer, docs, odd):
    """Real texts, odd and long ones, null ids, repeated rows, spellings of special tokens as the tokenizer takes them."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(None if r["doc_id"] is None else r["doc_id"] + 100_000, r["text"]) for r in odd.collect()]
    rows += [(200_000 + i, t) for i, t in enumerate([*SPECIAL, "ÀÉ naïve İstanbul ﬁ 12 3.4 it's", "word " * 9000, "y" * 3000])]
    check(tokenizer, spark, rows)
    assert ids_of(tokenizer, SPECIAL[0]).tolist() != [*packing.CachedTokenizer(tokenizer_path()).ids([b"hi"])[0].tolist(), 2]


def test_sequences_are_the_pieces_put_together(spark, tokenizer):
    rows = [(i, f"text {i} " * (i * 40)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["sequence_id"]: r["input_ids"] for r in packing.sequences(docs, tokenizer_path(), window=512).collect()}
    flat = [x for k in sorted(got) for x in got[k]]
    assert flat == [x for _, t in rows for x in ids_of(tokenizer, t).tolist()] and all(len(x) == 512 for k, x in got.items() if k < max(got))


def test_no_rows(spark, none):
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_order_of_files_and_rows(spark, tokenizer, tmp_path):
    """Files that are read in many splits, several to a task and not in order: the stream is that of the files' paths and rows."""
    rows = [(i, f"row {i} {i * 7919}" * (i % 40), i % 3) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file int").repartition(3, "file").sortWithinPartitions("doc_id").drop("file")
    docs.write.option("parquet.block.size", 20_000).option("parquet.page.size", 2_000).parquet(str(tmp_path / "docs"))
    files = sorted((tmp_path / "docs").glob("*.parquet"))
    assert len(files) > 1
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        read = spark.read.parquet(str(tmp_path / "docs"))
        assert read.rdd.getNumPartitions() > len(files)
        got = packing.pack(read, tokenizer_path(), window=512, by_file=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = [i for f in files for i in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0] == want
    ends = [512 * r["sequence_id"] + r["offset"] + r["length"] for r in got]
    texts = {i: t for i, t, _ in rows}
    assert max(ends) == sum(r["length"] for r in got) == sum(len(ids_of(tokenizer, texts[i])) for i in want)
