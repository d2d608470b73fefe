"""Phrase collocations by compressed position bitmaps, in the way of SPAM.

Texts are cut into shards of about a quarter of a million words of one language where they are read. In a shard every word has a bitmap of its positions; positions of different pieces
don't touch. A bitmap is kept as its non-empty blocks of 32 positions. A phrase is extended by shifting its bitmap by one and taking the AND with the bitmaps of all words in the
same blocks; the popcounts are the counts of the longer phrases. Extension is depth-first over batches of first words, and counts of a phrase are summed over shards.

Words are counted before pairs, and pairs by a 64-bit key before the phrases themselves: an extension needs all its parts to be frequent, which Bloom filters of bounded size tell
the tasks. Tasks make a filter's parts and write them into the shared folder, from where executors fetch them, so that the driver holds their names alone. A wrong yes of a filter, or of two pairs with one key, costs a row and changes nothing, as the sums over shards decide. In the tables between, words are named by a 64-bit hash, under a seed for which no two words of a language share one (looked up).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import parquet
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, materialize, mix, trim

#: Words in a shard, about; positions in a block; entries that a step of the extension unfolds at once; words whose pairs are summed in one group; the largest Bloom filter, and a part of one, in bits.
SHARD, BITS, AT_ONCE, RANGE, MOST_BLOOM, PART = 1 << 18, 32, 1 << 18, 1 << 18, 1 << 28, 1 << 20
_BREAK = b"\xff"  # a byte that no UTF-8 text holds
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z alone), with a mark between pieces."""
    return text.lower().translate(_PIECES).replace(_BREAK, b" \xff ").split(b" ")


class Shard:
    """Words of one language by number, and their sequence; 0 is the mark between pieces."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[_BREAK], self.parts, self.size = 0, [], 0

    def add(self, text: bytes) -> None:
        found = np.fromiter(map(self.ids.__getitem__, filter(None, tokens(text))), np.int32)
        self.parts += [found, np.zeros(1, np.int32)]
        self.size += len(found)

    def row(self, lang: str) -> tuple[str, list[str], list[int], bytes]:
        seq = np.concatenate(self.parts)
        n = np.bincount(seq, minlength=len(self.ids))
        return lang, [w.decode() for w in list(self.ids)[1:]], n[1:].tolist(), seq.astype("<i4").tobytes()


def shards(docs: DataFrame) -> DataFrame:
    """lang, words, counts and sequence of each shard, written once. Long texts are cut at marks between pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "words", "counts", "seq"]
        flat = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()))], names=names)
        open_: dict[str, Shard] = {}
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for i, lang in enumerate(batch["lang"].to_pylist()):
                for part in parts_of(texts[i].as_py()):
                    shard = open_.setdefault(lang, Shard())
                    shard.add(part)
                    if shard.size >= SHARD:
                        yield flat([open_.pop(lang).row(lang)])
                        trim()
        while open_:
            lang, shard = open_.popitem()
            yield flat([shard.row(lang)])
        trim()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    with arrow_rows(docs.sparkSession, 1000):
        return materialize(rows.mapInArrow(cut, "lang string, words array<string>, counts array<long>, seq binary"))


def parts_of(text: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts of about limit bytes, cut at ends of pieces; a text without any stays whole."""
    start = 0
    while len(text) - start > limit:
        ends = [e for e in (text.find(c, start + limit) for c in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r")) if e >= 0]
        if not ends:
            break
        yield text[start : min(ends) + 1]
        start = min(ends) + 1
    yield text[start:]


class Filter(NamedTuple):
    """A Bloom filter of ``size`` bits, in parts of ``part`` bits, in files that executors have by these names."""

    size: int
    part: int
    files: list[str]

    def bits(self) -> np.ndarray:
        out = np.zeros((self.size // self.part, self.part // 8), np.uint8)  # a part without keys has no row
        for name in self.files:
            for batch in parquet.ParquetFile(SparkFiles.get(name)).iter_batches(16):
                for k, own in zip(batch["part"].to_pylist(), batch["bits"]):
                    out[k] = np.frombuffer(own.as_buffer(), np.uint8)
        return out.reshape(-1)


class Bloom:
    """A filter of 64-bit keys: no for what isn't there, yes for all that is and for few others."""

    def __init__(self, bits: Filter | np.ndarray) -> None:
        self.bits = bits.bits() if isinstance(bits, Filter) else bits
        self.mask = np.uint64(len(self.bits) * 8 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for k in range(2):
            at = mix(keys + np.uint64(k)) & self.mask
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def key_of(*hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key of a phrase's word hashes; different phrases may share one, which a filter may."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h.astype(np.uint64))
    return out


def slices(x: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of x from each place to the next."""
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((np.append(begin, len(x)) * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


def bloom(keys: DataFrame) -> Filter:
    """A filter of 64-bit keys (column key): 16 bits a key up to MOST_BLOOM in all. Its parts are made by tasks, and executors fetch them from the shared folder: nothing of them passes the driver."""
    n = keys.count()
    size = min(MOST_BLOOM, max(1 << 16, 1 << (max(1, 16 * n) - 1).bit_length()))
    own = min(size, PART)

    def place(batches):
        for b in batches:
            key = b["key"].to_numpy().view(np.uint64)
            at = np.sort(np.concatenate([mix(key + np.uint64(k)) & np.uint64(size - 1) for k in range(2)]))
            part, begin = np.unique(at // np.uint64(own), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), slices((at % np.uint64(own)).astype("<u4"), begin)], names=["part", "at"])

    def join(t: pa.Table) -> pa.Table:
        bits = np.zeros(own, np.uint8)
        for at in t["at"]:
            bits[np.frombuffer(at.as_buffer(), "<u4")] = 1
        return pa.table({"part": t["part"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    parts = materialize(keys.mapInArrow(place, "part int, at binary").groupBy("part").applyInArrow(join, "part int, bits binary").coalesce(8))  # few files
    files = parts.inputFiles()
    for f in files:
        keys.sparkSession.sparkContext.addFile(f)
    return Filter(size, own, [f.rsplit("/", 1)[-1] for f in files])


class Bitmaps:
    """Position bitmaps of a shard's words: blocks ordered by place, for the AND, and by word, for first words."""

    def __init__(self, seq: np.ndarray, kept: np.ndarray) -> None:
        """kept: whether a word can be part of a phrase."""
        at = np.flatnonzero(kept[seq]).astype(np.int32)
        word = seq[at]
        block = at // BITS
        order = np.lexsort((word, block))
        word, block, bit = word[order], block[order], np.uint32(1) << (at[order] % BITS).astype(np.uint32)
        new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (block[1:] != block[:-1]))) if len(word) else np.zeros(0, int)
        self.word, self.block, self.bits = word[new], block[new], np.bitwise_or.reduceat(bit, new) if len(new) else bit
        self.start = np.searchsorted(self.block, np.arange(len(seq) // BITS + 3))
        self.by_word = np.argsort(self.word, kind="stable")

    def extended(self, ids: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of bitmaps (number of the phrase, block, bits): numbers, next words, blocks and bits of all extensions by one word that occur."""
        carry = bits >> np.uint32(BITS - 1)
        over = carry > 0
        ids, block, bits = np.concatenate([ids, ids[over]]), np.concatenate([block, block[over] + 1]), np.concatenate([bits << np.uint32(1), carry[over]])
        n = self.start[block + 1] - self.start[block]
        from_ = np.repeat(np.arange(len(ids), dtype=np.int32), n)
        with_ = np.arange(len(from_), dtype=np.int32) + np.repeat((self.start[block] - np.cumsum(n) + n).astype(np.int32), n)
        both = bits[from_] & self.bits[with_]
        hit = np.flatnonzero(both)
        from_, with_ = from_[hit], with_[hit]
        return ids[from_], self.word[with_], block[from_], both[hit]

    def batches(self) -> Iterator[np.ndarray]:
        """Entries of first words, so many at a time that a step unfolds about AT_ONCE; a word's entries stay together."""
        cost = np.cumsum((self.start[self.block + 1] - self.start[self.block])[self.by_word]) // AT_ONCE
        word = self.word[self.by_word]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, int)
        cuts = first[np.flatnonzero(np.append(True, np.diff(cost[first]) > 0))] if len(first) else first
        for a, b in zip(cuts, [*cuts[1:], len(word)]):
            yield self.by_word[a:b]


def summed(ids: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, words and popcounts of the extensions, and for each entry which extension it belongs to."""
    key, inverse = np.unique(ids.astype(np.int64) * (1 << 31) + word, return_inverse=True)
    return key >> 31, key & ((1 << 31) - 1), np.bincount(inverse, np.bitwise_count(bits), len(key)).astype(np.int64), inverse


def each_shard(batches, word_filter: Bloom):
    """lang, hash of lang, hashes of the words (by number) and the bitmaps of each shard, with the words that the filter lets through."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang_hash, seq = batch["lang_hash"][i].as_py(), np.frombuffer(batch["seq"][i].as_buffer(), "<i4")
            h = np.concatenate([np.zeros(1, np.int64), batch["hashes"][i].values.to_numpy()])
            kept = word_filter.has(key_of(np.full(len(h), lang_hash), h))
            kept[0] = False
            yield batch["lang"][i].as_py(), lang_hash, h, Bitmaps(seq, kept)
            trim()


def word_keys(rows: DataFrame) -> DataFrame:
    """Keys of words (lang_hash, h)."""
    give = lambda batches: (pa.RecordBatch.from_arrays([pa.array(key_of(b["lang_hash"].to_numpy(), b["h"].to_numpy()).view(np.int64))], names=["key"]) for b in batches)
    return rows.select("lang_hash", "h").mapInArrow(give, "key long")


def pair_keys(table: DataFrame, words: Filter, n_words: int, least: int) -> DataFrame:
    """Keys of pairs that may come least times, from the sums of all pairs with a key.

    A shard gives its counts as sorted arrays, cut at ranges of keys, a row a range; ranges are so many that each holds about RANGE words' pairs, summed in a task group of its own.
    """
    n_ranges = max(1, -(-n_words // RANGE))

    def count(batches):
        for _, lang_hash, h, maps in each_shard(batches, Bloom(words)):
            keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
            for entries in maps.batches():
                first, word, _, bits = maps.extended(maps.word[entries], maps.block[entries], maps.bits[entries])
                a, b, n, _ = summed(first, word, bits)
                keys.append(key_of(np.full(len(a), lang_hash), h[a], h[b]))
                counts.append(n.astype("<u4"))
            key, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key)
            key, n = key[order], n[order]
            part = ((key >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
            here, begin = np.unique(part, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int64)), slices(key, begin), slices(n, begin)], names=["part", "keys", "counts"])

    def add(t: pa.Table) -> pa.Table:
        join = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t[c]])
        key, inverse = np.unique(join("keys", "<u8"), return_inverse=True)
        n = np.bincount(inverse, join("counts", "<u4"), len(key))
        return pa.table({"key": pa.array(key[n >= least].view(np.int64))})

    return table.mapInArrow(count, "part long, keys binary, counts binary").groupBy("part").applyInArrow(add, "key long")


def phrases(table: DataFrame, words: Filter, pairs: Filter) -> DataFrame:
    """lang, hashes of the words of a phrase (h3 null for a pair) and n, its count in a shard, of phrases all of whose pairs the filter lets through."""

    def count(batches):
        word_filter, pair_filter = Bloom(words), Bloom(pairs)
        for lang, lang_hash, h, maps in each_shard(batches, word_filter):
            go = lambda x, y: pair_filter.has(key_of(np.full(len(x), lang_hash), h[x], h[y]))  # noqa: B023, E731  used within the turn
            for entries in maps.batches():
                first, word, block, bits = maps.extended(maps.word[entries], maps.block[entries], maps.bits[entries])
                a, b, n, which = summed(first, word, bits)
                ok = go(a, b)
                yield batch_of(lang, h[a[ok]], h[b[ok]], None, n[ok])
                own = np.flatnonzero(ok[which])
                pair, word, _, bits = maps.extended(which[own], block[own], bits[own])
                p, c, n, _ = summed(pair, word, bits)
                ok = go(b[p], c)
                yield batch_of(lang, h[a[p[ok]]], h[b[p[ok]]], h[c[ok]], n[ok])

    def batch_of(lang, h1, h2, h3, n):
        third = pa.nulls(len(n), pa.int64()) if h3 is None else pa.array(h3)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(h1), pa.array(h2), third, pa.array(n)], names=["lang", "h1", "h2", "h3", "n"])

    return table.mapInArrow(count, "lang string, h1 long, h2 long, h3 long, n long")


def dictionary(table: DataFrame) -> tuple[DataFrame, int]:
    """lang, word, h and f (count) of all words, and the seed of the hashes h, under which no two words of a language have the same."""
    words = table.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    words, seed = materialize(words), 0
    while True:
        hashed = words.select("lang", "word", F.xxhash64(F.lit(seed), "word").alias("h"), "f")
        if hashed.groupBy("lang", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return hashed, seed
        seed += 1


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts up to 10^15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language with their rank: sorted by ranges, so that a language may fill many tasks; what tasks hold of a language before gives the rank."""
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    rows = materialize(rows)
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    parts = rows.groupBy("lang", "part").agg(F.count("*").alias("own"), F.min("place").alias("begin"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("lang", "part", "begin", before.alias("before")).where(F.col("before") < top)
    return rows.join(parts, ["lang", "part"]).withColumn("rank", F.col("before") + F.col("place") - F.col("begin") + 1).where(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = 10, top: int = 2000, contained: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top phrases of two or three words that occur least times or more.

    Words, pieces and the score are those of the contract of the query. A phrase that lies in a longer one with contained per cent of its occurrences or more is dropped. A
    null lang is ``und``, a null or empty text has no words; repeated rows count again; no rows, and no frequent phrases, give no rows; other columns are ignored.
    """
    table = shards(docs)
    words, seed = dictionary(table)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialize(words.where(F.col("f") >= least))
    lang_hash = F.xxhash64("lang").alias("lang_hash")
    seqs = table.select("lang", lang_hash, F.transform("words", lambda w: F.xxhash64(F.lit(seed), w)).alias("hashes"), "seq")
    known = bloom(materialize(word_keys(words.select(lang_hash, "h"))))  # written first: two steps of Python in a task would take two workers, and these live on
    n_words = total.agg(F.sum("n")).first()[0] or 0
    with arrow_rows(docs.sparkSession, 4):
        keys = materialize(pair_keys(seqs, known, n_words, least))
    pair_filter = bloom(keys)
    with arrow_rows(docs.sparkSession, 4):
        found = phrases(seqs, known, pair_filter).groupBy("lang", "h1", "h2", "h3").agg(F.sum("n").alias("a"))
        found = materialize(found.where(F.col("a") >= least))
    pairs, triples = found.where("h3 is null").drop("h3"), found.where("h3 is not null")

    word = lambda i: words.select("lang", F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"))
    pair = lambda i, j: pairs.select("lang", F.col("h1").alias(f"h{i}"), F.col("h2").alias(f"h{j}"), F.col("a").alias(f"f{i}{j}"))
    inside = triples.select("lang", "a", F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("x"))
    inside = inside.groupBy("lang", F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2")).agg(F.max("a").alias("longer"))
    two = pairs.join(inside, ["lang", "h1", "h2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    two = two.join(word(1), ["lang", "h1"]).join(word(2), ["lang", "h2"]).select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
    two = two.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    three = triples.join(word(1), ["lang", "h1"]).join(word(2), ["lang", "h2"]).join(word(3), ["lang", "h3"]).join(pair(1, 2), ["lang", "h1", "h2"]).join(pair(2, 3), ["lang", "h2", "h3"])
    cut = lambda k, left, right: F.struct(score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    return ranked(two.unionByName(three), top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
q AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM q, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
u AS (SELECT lang, k, phrase, a, w, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM c, (VALUES (1), (2)) t(cut) WHERE cut < k),
s AS (SELECT u.*, x.a AS l, y.a AS r, 1000000::HUGEINT * u.a * u.a // (x.a::HUGEINT * y.a) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.lp JOIN f y ON y.lang = u.lang AND y.phrase = u.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE b.k = 3 OR m.longer IS NULL OR 100 * m.longer < 50 * b.a),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""
