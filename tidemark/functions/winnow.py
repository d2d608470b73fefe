"""An index for quotes: winnowed fingerprints of texts, in time linear in their bytes.

A gram is eight bytes, hashed by a bijection. Of every window of consecutive grams the smallest (the last of equals) is a fingerprint. A quote of at least ``least`` bytes fills a window, and
a text that holds the quote has the same window, so that the two share each fingerprint of the quote: none is missed, whatever the word borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 8
#: Bytes hashed at once; the largest filter of wanted fingerprints, in bits.
AT_ONCE, MOST_BITS = 1 << 22, 1 << 28


def hashed(values: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, a bijection (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def fingerprints(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and their fingerprints, each place once."""
    width = least - GRAM + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = b"".join(texts) + bytes(2 * GRAM + width)
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.empty((n + width + GRAM - 1) // GRAM * GRAM, np.uint64)
    for k in range(GRAM):
        grams[k::GRAM] = np.frombuffer(data, "<u8", len(grams) // GRAM, k)
    grams = hashed(grams)
    begins = np.arange(n) + least <= np.repeat(ends, sizes)  # windows inside one text
    best, at = grams[:n].copy(), np.arange(n)
    for k in range(1, width):
        now = grams[k : n + k]
        smaller = now <= best
        best, at = np.where(smaller, now, best), np.where(smaller, np.arange(k, n + k), at)
    at = np.unique(at[begins])
    return np.searchsorted(ends, at, side="right"), grams[at]


def parts(texts: list[bytes], least: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in groups of about AT_ONCE bytes; longer ones in parts that overlap by all but one byte of a window."""
    rows, group, size = [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - least + 1), AT_ONCE):
            piece = text[start : start + AT_ONCE + least - 1]
            if size and size + len(piece) > AT_ONCE:
                yield rows, group
                rows, group, size = [], [], 0
            rows.append(i)
            group.append(piece)
            size += len(piece)
    if rows:
        yield rows, group


def indexed(rows: DataFrame, key: str, text: str, least: int, wanted: np.ndarray | None = None) -> DataFrame:
    """key and fingerprint (g) of each row's text, those alone that the filter ``wanted`` may hold; a fingerprint may come more than once."""
    kind, shared = dict(rows.dtypes)[key], None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    def index(batches):
        for b in batches:
            own = [x or b"" for x in b["_t"].to_pylist()]
            for numbers, group in parts(own, least):
                row, g = fingerprints(group, least)
                if shared is not None:
                    bits = shared.value
                    at = g & np.uint64(len(bits) * 8 - 1)
                    keep = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    row, g = row[keep], g[keep]
                yield pa.RecordBatch.from_arrays([b[key].take(pa.array(np.array(numbers, np.int64)[row])), pa.array(g.view(np.int64))], names=[key, "g"])

    return rows.select(key, F.col(text).cast("binary").alias("_t")).mapInArrow(index, f"`{key}` {kind}, g long")


def filter_of(wanted: DataFrame) -> np.ndarray:
    """Bits of the wanted fingerprints (column g), 64 a fingerprint up to MOST_BITS in all: a wrong yes costs a row, a no is never wrong."""
    n = wanted.count()
    size = min(MOST_BITS, max(1 << 16, 1 << (max(1, 64 * n) - 1).bit_length()))
    at = F.col("g").bitwiseAND(F.lit(size - 1))
    words = wanted.select(F.shiftright(at, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # size / 64 rows at most
    out = np.zeros(size // 64, np.uint64)
    out[found["word"].to_numpy(int)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out.view(np.uint8)
