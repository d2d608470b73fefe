"""Concatenate-and-cut packing: a two-pass prefix sum gives every document its place in one token stream, cut into windows."""

from __future__ import annotations

import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, materialize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Where the tokenizer splits lower-cased text, as long as all of its characters beyond ASCII are letters.
_PARTS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")


class CachedTokenizer:
    """Ids of whole texts by a lower-casing tokenizer whose pieces never cross white space, remembering the parts seen before.

    At most about max_parts parts are remembered; then the memory starts anew.
    """

    def __init__(self, path: str, max_parts: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold the spelling of a special token are encoded whole
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a piece
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.max_parts = max_parts
        self.forget()

    def forget(self) -> None:
        """code: a part's number; its ids are pool[starts[code]:starts[code] + lens[code]], none for a part that can't be looked up by itself."""
        self.code, self.pool, self.starts, self.lens, self.used = {}, np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, parts: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        n, m = len(self.code), len(parts)
        while n + m > len(self.lens):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.lens[n : n + m] = lens
        self.starts[n : n + m] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.code.update(zip(parts, range(n, n + m)))

    def _learn(self, parts: list[bytes]) -> None:
        """Encodes new parts in one go. No ids mark a part that the tokenizer may split otherwise: words with it are encoded by themselves."""
        good = [p for p in parts if p.isascii() or p.decode("utf-8", "replace").isalpha()]
        if len(good) < len(parts):
            odd = list(set(parts) - set(good))
            self._add(odd, np.zeros(0, np.uint16), np.zeros(len(odd), np.int64))
        for lo in range(0, len(good), 2000):
            group = good[lo : lo + 2000]
            ids = np.array(self.encode(b" ".join(group).decode()), np.uint16)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                self._add(group, ids, np.diff(ends, prepend=0))
            else:
                for p in group:
                    own = np.array(self.encode(p.decode()), np.uint16)
                    own = own if self.last[own].sum() == 1 else own[:0]
                    self._add([p], own, np.array([len(own)]))

    def _by_words(self, text: bytes) -> np.ndarray:
        out = []
        for word in text.split():
            codes = [self.code[p] for p in _PARTS.findall(word.lower())]
            if all(self.lens[c] for c in codes):
                out += [self.pool[self.starts[c] : self.starts[c] + self.lens[c]] for c in codes]
            else:
                out.append(np.array(self.encode(word.decode()), np.uint16))
        return np.concatenate(out)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """16-bit ids of each whole text."""
        if len(self.code) > self.max_parts:
            self.forget()
        flat, counts, whole = [], [0], []
        for k, t in enumerate(texts):
            low = t.lower()
            if any(x in low for x in self.special):
                whole.append(k)
            else:
                flat += _PARTS.findall(low)
            counts.append(len(flat))
        codes = np.fromiter(map(self.code.get, flat, repeat(-1)), np.int64, len(flat))
        miss = np.flatnonzero(codes < 0).tolist()
        if miss:
            new = [flat[i] for i in miss]
            self._learn(list(dict.fromkeys(new)))
            codes[miss] = np.fromiter(map(self.code.__getitem__, new), np.int64, len(new))
        lens = self.lens[codes]
        ends = np.cumsum(lens)
        ids = self.pool[np.repeat(self.starts[codes] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[counts]
        out = [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
        for k in np.unique(np.searchsorted(counts, np.flatnonzero(lens == 0), side="right") - 1).tolist():
            out[k] = self._by_words(texts[k])
        for k in whole:
            out[k] = np.array(self.encode(texts[k].decode()), np.uint16)
        return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, by_file: bool = False) -> DataFrame:
    """doc_id, file and first (the run of documents it belongs to), local (tokens before the document in its run), n_tokens and ids (binary, 16-bit), written once.

    A run is a partition of the input or, with ``by_file``, rows that follow one another in a Parquet file, known by the file's path and its first row.
    """

    def run(batches):
        tok, file, first, after, local = CachedTokenizer(tokenizer), "", TaskContext.get().partitionId(), None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                b = batch.slice(lo, 400)
                ids = [np.append(x, np.uint16(end_id)).tobytes() for x in tok.ids(byte_texts(b.column(1)))]
                runs = []
                places = zip(b.column(2).to_pylist(), b.column(3).to_pylist()) if by_file else repeat(None)
                for x, place in zip(ids, places):
                    if place is not None:
                        if place != after:
                            (file, first), local = place, 0
                        after = place[0], place[1] + 1
                    runs.append((file, first, local, len(x) // 2))
                    local += len(x) // 2
                f, r, at, n = zip(*runs)
                yield pa.record_batch([b.column(0), pa.array(f, pa.string()), pa.array(r, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "file", "first", "local", "n_tokens", "ids"])

    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")] if by_file else []
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *place)
    return materialize(src.mapInArrow(run, "doc_id long, file string, first long, local long, n_tokens long, ids binary"))


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Second pass: adds ``at``, each document's place in the whole stream. One total per run is summed up, not rows of documents."""
    totals = tokens.groupBy("file", "first").agg(F.sum("n_tokens").alias("n"))
    # Spark's writers number files with five digits, from 100,000 on with more: the number counts, not its text
    number = "coalesce(try_cast(regexp_extract(file, '/part-([0-9]+)[^/]*$', 1) as bigint), -1)"
    base = totals.selectExpr("file", "first", f"sum(n) over (order by {number}, file, first) - n as base")
    return tokens.join(F.broadcast(base), ["file", "first"]).withColumn("at", F.col("base") + F.col("local"))


def cut(tokens: DataFrame, window: int) -> DataFrame:
    """The pieces that windows of the stream cut documents into, with their ids (``piece``, binary, 16-bit)."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, n, ids, at in zip(*(b.column(i).to_pylist() for i in range(4))):
                done = 0
                while done < n:
                    seq, off = divmod(at + done, window)
                    size = min(n - done, window - off)
                    piece = ids[2 * done : 2 * (done + size)]
                    rows.append((doc, done, size, zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes()), n, seq, off, piece))
                    done += size
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece"])

    return tokens.select("doc_id", "n_tokens", "ids", "at").mapInArrow(run, PIECES + ", piece binary")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, by_file: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``window`` tokens; every sequence but the last is full.

    docs: doc_id and text; other columns are ignored. The stream takes documents in the order of the input's parts or, with ``by_file``, for docs just
    read from Parquet, in that of their files' paths and rows, which takes no shuffle. A null or empty text is the end token alone. Repeated rows and null ids are packed
    like others. Long texts are cut over as many sequences as they need. No rows give no rows. Ids must be below 65536.
    """
    return cut(with_offsets(tokenized(docs, tokenizer, end_id, by_file)), window).drop("piece")


def sequences(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """sequence_id and its token ids (array, ``window`` at most), put together from the pieces."""
    pieces = cut(with_offsets(tokenized(docs, tokenizer, end_id)), window)
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("p"))

    def ids(piece: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b"".join(x["piece"] for x in p), "<u2").astype(np.int32) for p in piece.to_pylist()], pa.list_(pa.int32()))

    return parts.select("sequence_id", F.arrow_udf(ids, "array<int>")("p").alias("input_ids"))
