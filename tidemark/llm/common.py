"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors and the driver share: ``spark.checkpoint.dir``, or a temporary one where it is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_of(rows: DataFrame, keys: list[str], n: int, rank: str, *order: Column) -> DataFrame:
    """The first n rows of each key; Spark limits each key before the exchange."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the column's text, mod n; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """While it lasts, Arrow batches of the session hold n rows at most: for rows of megabytes, of which the usual ten thousand would be held at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Give memory that this Python worker has freed back to the system, as far as its C library can: workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() breaks at exactly these six bytes."""
    return text.split()


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(texts: list[bytes], limit: int = 1 << 20):
    """Group texts into lists of (index, bytes, continued) of about ``limit`` bytes; longer texts are cut at white space.

    Nothing is dropped: a text without any white space stays whole.
    """
    group, total = [], 0
    for i, text in enumerate(texts):
        start, cont = 0, False
        while True:
            end = len(text)
            if end - start > limit:
                cut = _GAP.search(text, start + limit)
                end = cut.start() if cut else end
            if total and total + end - start > limit:
                yield group
                group, total = [], 0
            group.append((i, text[start:end], cont))
            total += end - start
            start, cont = end, True
            if end >= len(text):
                break
    if group:
        yield group


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)


def hashed_words(group: list[tuple[int, bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the group's texts and the position in the group of its text, vectorised over bytes."""
    sizes = np.array([len(t) for _, t, _ in group], np.int64)
    data = np.frombuffer(b"".join(t for _, t, _ in group), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    ends = np.cumsum(sizes)
    heads = (ends - sizes)[sizes > 0]
    first[heads] = inside[heads]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = np.searchsorted(at, starts)
    lengths = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE, np.uint64))
    h = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers[place], head)
    return mix(h ^ lengths.astype(np.uint64)), np.searchsorted(ends, starts, side="right")


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, label) per node, label being the smallest node reachable.

    Each round hooks every label to its smallest neighbouring label and then follows the hooks to their
    end, so rounds grow with the logarithm of the components' width. All state stays in tables of the shared folder;
    joins have an exchange on both sides, so that adaptive execution can split a label that holds many rows.
    Null ends are ignored; loops give a component of one; no edges give no rows.
    """
    edges = materialize(edges.where("a is not null and b is not null").distinct())
    labels = materialize(edges.selectExpr("stack(2, a, b) as node").distinct().selectExpr("node", "node as label"))
    while True:
        left = labels.selectExpr("node as a", "label as la")
        right = labels.selectExpr("node as b", "label as lb")
        pairs = edges.join(left, "a").join(right, "b").where("la <> lb").selectExpr("least(la, lb) as lo", "greatest(la, lb) as hi")
        hooks = materialize(pairs.groupBy(F.col("hi").alias("label")).agg(F.min("lo").alias("to")))
        if hooks.isEmpty():
            return labels
        while True:
            jump = hooks.selectExpr("label as to", "to as further")
            after = materialize(hooks.join(jump, "to", "left").selectExpr("label", "coalesce(further, to) as to", "further is not null as moved"))
            hooks = after.select("label", "to")
            if after.where("moved").isEmpty():
                break
        labels = materialize(labels.join(hooks, "label", "left").selectExpr("node", "coalesce(to, label) as label"))
