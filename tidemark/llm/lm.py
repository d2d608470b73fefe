"""Language-model scoring: a gated recurrent network in numpy with a class-factored output softmax.

Word counts, classes and the shares of words outside the network's vocabulary come from all training tokens. The network is trained by
truncated backpropagation on every shard's training documents from a common start, and the shards' weights are averaged by tokens. Shards are
ranges of a hash of the documents' ids, as many as the training tokens ask for, so scores don't depend on how the table is laid out in files.
A document's state is carried across windows from its first to its last token, so its score is the log-likelihood of the whole text.
"""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, crc_mod, materialize

#: Most words that every task looks up itself (their counts are broadcast); others are joined. Words that the network knows one by one.
HEAD, KNOWN, CLASSES, HIDDEN = 1 << 17, 1024, 32, 16
#: Most documents that the common start is trained on, before all partitions train on all of theirs.
WARM_DOCS = 1500
SEGMENT = 1024
#: Documents that training runs side by side.
LANES = 512
#: Training tokens of a shard, about.
SHARD_TOKENS = 2_000_000
END = b""


def count_words(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """word (binary) and c over whole texts; the empty word stands for the end of a document."""

    def run(batches):
        seen, n = Counter(), 0

        def out():
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for t in byte_texts(b.column(0)):
                seen.update(t.lower().split())
                n += 1
                if len(seen) > flush:
                    yield out()
                    seen.clear()
        seen[END] += n
        yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, ``most`` or fewer, and their counts, by falling count and then by word.

    Counts fall into 64 bins to a power of two; a first pass counts each bin's words, so that only words of the bins that fit come to the driver. Words of a
    bin that doesn't fit whole are left out.
    """
    bin_of = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    sizes = sorted((r["bin"], r["n"]) for r in counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect())
    lowest, n = None, 0
    for b, size in reversed(sizes):
        n += size
        if n > most:
            break
        lowest = b
    if lowest is None:
        return [], np.zeros(0)
    found = sorted(((r["c"], bytes(r["word"])) for r in counts.where(bin_of >= lowest).collect()), key=lambda x: (-x[0], x[1]))
    return [w for _, w in found], np.array([c for c, _ in found], float)


class Vocabulary:
    """Ids of the most frequent words by falling count; the first KNOWN of them have classes of about equal mass."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int):
        self.ids = {w: i for i, w in enumerate(words)}
        self.n_words, self.total, self.distinct = len(words), total, distinct
        self.known = min(KNOWN, len(words))
        self.log_count = np.log10(np.append(counts + 0.5, 1.0))  # the last: words that are joined
        self.end = self.ids.get(END, self.n_words)
        mass = np.cumsum(counts[: self.known]) if self.known else np.zeros(0)
        self.word_class = np.minimum((mass - counts[: self.known]) * CLASSES // max(1, mass[-1] if len(mass) else 1), CLASSES - 1).astype(np.int64)
        self.word_class = np.unique(self.word_class, return_inverse=True)[1] if self.known else self.word_class
        self.n_classes = int(self.word_class.max()) + 1 if self.known else 0
        self.bounds = np.searchsorted(self.word_class, np.arange(self.n_classes + 1))
        own = counts[: self.known] + 0.5
        self.rest = total + 0.5 * (distinct + 1) - own.sum()  # of all other words and of one never seen
        self.class_mass = np.append(np.add.reduceat(own, self.bounds[:-1]) if self.known else np.zeros(0), self.rest)
        self.word_mass = own

    def encode(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        tokens = text.lower().split()
        tokens.append(END)
        ids = np.fromiter(map(self.ids.get, tokens, repeat(self.n_words)), np.int32, len(tokens))
        return ids, [tokens[i] for i in np.flatnonzero(ids == self.n_words).tolist()]


NAMES = ("X", "Uzr", "Un", "Wc", "bc", "Ww", "bw")


def start_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; the biases give the words' shares in all training tokens."""
    r, h = np.random.default_rng(7), HIDDEN
    w = {"X": r.normal(0, 0.3, (v.known + 3, 3 * h)), "Uzr": r.normal(0, 0.2, (h, 2 * h)), "Un": r.normal(0, 0.2, (h, h)), "Wc": r.normal(0, 0.05, (h, v.n_classes + 1)), "bc": np.log(v.class_mass / v.class_mass.sum()), "Ww": r.normal(0, 0.05, (h, v.known)), "bw": np.log(v.word_mass / v.class_mass[v.word_class]) if v.known else np.zeros(0)}
    return {k: x.astype(np.float32) for k, x in w.items()}


def lanes(lens: np.ndarray, n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane and first step of each document; the lanes' loads are about equal and fall from the first to the last."""
    heap = [(0, i) for i in range(n_lanes)]
    lane, at, load = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64), np.zeros(n_lanes, np.int64)
    for d in np.argsort(-lens, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        lane[d], at[d] = i, n
        load[i] = n + int(lens[d])
        heapq.heappush(heap, (int(load[i]), i))
    place = np.argsort(np.argsort(-load, kind="stable"), kind="stable")
    return place[lane], at


def width(ids: list[np.ndarray], most: int, steps: int) -> int:
    """Lanes for documents: ``most`` at most, so that about ``steps`` steps or more fill them, and no more than keep the grid within three times the tokens."""
    tokens, longest = sum(map(len, ids)), max(map(len, ids))
    return max(1, min(most, tokens // steps, len(ids), 2 * tokens // longest))


def grid(ids: list[np.ndarray], v: Vocabulary, n_lanes: int) -> tuple[np.ndarray, ...]:
    """Steps by lanes: target ids (-1: none), input words, whether a document starts, its index."""
    lens = np.array([len(x) for x in ids])
    lane, at = lanes(lens, n_lanes)
    flat, doc = np.concatenate(ids), np.repeat(np.arange(len(ids)), lens)
    first = np.cumsum(lens) - lens
    step = np.arange(len(flat)) - np.repeat(first - at, lens)
    known = np.where(flat < v.known, flat, np.where(flat < v.n_words, v.known, v.known + 1))
    before = np.append(v.known + 2, known[:-1])
    before[first] = v.known + 2
    shape = (int((at + lens).max()), n_lanes)
    y, x, s, d = np.full(shape, -1, np.int32), np.full(shape, v.known + 2, np.int32), np.ones(shape, bool), np.zeros(shape, np.int32)
    cells = step, np.repeat(lane, lens)
    y[cells], x[cells], d[cells] = flat, before, doc
    s[:] = False
    s[at, lane] = True
    return y, x, s, d


def _sigmoid(x):
    x = np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def forward(w, x, s, h):
    """States of a window of steps and what the backward pass needs."""
    states, kept, n = np.empty((*x.shape, HIDDEN), np.float32), [], HIDDEN
    for t in range(len(x)):
        a = w["X"][x[t]]
        h = h * ~s[t][:, None]
        zr = _sigmoid(a[:, : 2 * n] + h @ w["Uzr"])
        rh = zr[:, n:] * h
        c = np.tanh(a[:, 2 * n :] + rh @ w["Un"])
        kept.append((h, zr, rh, c))
        h = h + zr[:, :n] * (c - h)
        states[t] = h
    return states, kept, h


def _softmax(x):
    """Rows' shares. States lie within -1 and 1, so the limit against overflow isn't met in practice; row sums are products, which are faster for short rows."""
    e = np.exp(np.minimum(x, 80, out=x), out=x)
    e /= (e @ np.ones(e.shape[1], e.dtype) + np.float32(1e-30))[:, None]
    return e


def outputs(w, v: Vocabulary, states, y, grads=None):
    """log10 probability of each target by class and word within it; words beyond the known ones get their class alone. Adds to grads if given.

    Targets are worked off in the order of their classes, so that each class's are one slice."""
    cls = np.where(y < v.known, v.word_class[np.minimum(y, v.known - 1)] if v.known else 0, v.n_classes)
    order = np.argsort(cls.astype(np.int16), kind="stable")
    states, y, cls = states[order], y[order], cls[order]
    p, rows = _softmax(states @ w["Wc"] + w["bc"]), np.arange(len(y))
    logp = np.log10(np.maximum(p[rows, cls], 1e-30)).astype(np.float64)
    if grads is not None:
        p[rows, cls] -= 1
        grads["Wc"] += states.T @ p
        grads["bc"] += p.sum(0)
        back = p @ w["Wc"].T
    bounds = np.searchsorted(cls, np.arange(v.n_classes + 1)).tolist()
    for c, (i, j) in enumerate(zip(bounds, bounds[1:])):
        lo, hi = v.bounds[c], v.bounds[c + 1]
        if j > i and hi - lo > 1:
            h, words = states[i:j], w["Ww"][:, lo:hi]
            q, target, k = _softmax(h @ words + w["bw"][lo:hi]), y[i:j] - lo, rows[: j - i]
            logp[i:j] += np.log10(np.maximum(q[k, target], 1e-30))
            if grads is not None:
                q[k, target] -= 1
                grads["Ww"][:, lo:hi] += h.T @ q
                grads["bw"][lo:hi] += q.sum(0)
                back[i:j] += q @ words.T
    out = np.empty_like(logp)
    out[order] = logp
    if grads is None:
        return out, None
    d = np.empty_like(back)
    d[order] = back
    return out, d


def backward(w, x, s, kept, d_states, grads):
    """Backpropagation through one window."""
    n, carry = HIDDEN, 0
    d_in = np.empty((*x.shape, 3 * n), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, zr, rh, c = kept[t]
        z, r = zr[:, :n], zr[:, n:]
        d = d_states[t] + carry
        dc = d * z * (1 - c * c)
        drh = dc @ w["Un"].T
        grads["Un"] += rh.T @ dc
        dzr = np.concatenate([d * (c - h), drh * h], 1) * zr * (1 - zr)
        grads["Uzr"] += h.T @ dzr
        carry = (d * (1 - z) + drh * r + dzr @ w["Uzr"].T) * ~s[t][:, None]
        d_in[t, :, : 2 * n], d_in[t, :, 2 * n :] = dzr, dc
    flat, at = d_in.reshape(-1, 3 * n), x.ravel()
    order = np.argsort(at, kind="stable")
    head = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
    grads["X"][at[order][head]] += np.add.reduceat(flat[order], head, axis=0)


def train(w: dict, v: Vocabulary, groups, window: int = 12, rate: float = 0.006) -> tuple[dict, int]:
    """Weights after one pass over groups of documents' ids (Adam steps, one a window), and the tokens seen.

    Training alone starts anew every SEGMENT tokens of a longer document, so that one long document doesn't leave most lanes idle.
    """
    w = {k: x.copy() for k, x in w.items()}
    m, g2, step, seen = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0, 0
    for whole in groups:
        ids = [x[lo : lo + SEGMENT] for x in whole for lo in range(0, len(x), SEGMENT)]
        y, x, s, _ = grid(ids, v, width(ids, LANES, 128))
        h = np.zeros((y.shape[1], HIDDEN), np.float32)
        for lo in range(0, len(y), window):
            live = int((y[lo] >= 0).sum())
            yw, xw, sw = (a[lo : lo + window, :live] for a in (y, x, s))
            states, kept, h = forward(w, xw, sw, h[:live])
            grads = {k: np.zeros_like(a) for k, a in w.items()}
            mask = yw.ravel() >= 0
            _, back = outputs(w, v, states.reshape(-1, HIDDEN)[mask], yw.ravel()[mask], grads)
            d = np.zeros((mask.size, HIDDEN), np.float32)
            d[mask] = back
            backward(w, xw, sw, kept, d.reshape(*yw.shape, HIDDEN), grads)
            step, n = step + 1, int(mask.sum())
            seen += n
            for k in w:
                g = grads[k] / n
                m[k] += 0.1 * (g - m[k])
                g2[k] += 0.01 * (g * g - g2[k])
                w[k] -= rate * min(1.0, n / 500) * (m[k] / (1 - 0.9**step)) / (np.sqrt(g2[k] / (1 - 0.99**step)) + 1e-6)
    return w, seen


def score(w: dict, v: Vocabulary, ids: list[np.ndarray], window: int = 32) -> np.ndarray:
    """log10 likelihood of each document by the network; words beyond the known ones count with their class."""
    y, x, s, d = grid(ids, v, width(ids, 1024, 64))
    h, total = np.zeros((y.shape[1], HIDDEN), np.float32), np.zeros(len(ids))
    for lo in range(0, len(y), window):
        live = int((y[lo] >= 0).sum())
        yw = y[lo : lo + window, :live].ravel()
        states, _, h = forward(w, x[lo : lo + window, :live], s[lo : lo + window, :live], h[:live])
        mask = yw >= 0
        logp, _ = outputs(w, v, states.reshape(-1, HIDDEN)[mask], yw[mask])
        total += np.bincount(d[lo : lo + window, :live].ravel()[mask], logp, len(ids))
    return total


def _groups(batches, column: int, v: Vocabulary, tokens: int = 1_000_000):
    """Lists of ids of about ``tokens`` tokens each, with each document's words that must be joined, and the rows' other columns."""
    ids, tails, rows, n = [], [], [], 0
    for b in batches:
        others, start = [c for k, c in enumerate(b.columns) if k != column], 0
        for at, t in enumerate(byte_texts(b.column(column)), 1):
            i, tail = v.encode(t)
            ids.append(i)
            tails.append(tail)
            n += len(i)
            if n >= tokens:
                yield ids, tails, rows + [[c.slice(start, at - start) for c in others]]
                ids, tails, rows, n, start = [], [], [], 0, at
        rows.append([c.slice(start) for c in others])
    if ids:
        yield ids, tails, rows


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in NAMES])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def fit(docs: DataFrame, v: Vocabulary) -> dict:
    """The network's weights, from all of docs (column text, doc_id)."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(v)
    first = start_weights(v)

    def trained(batches, w, share=1.0):
        new, seen = train(w, vocabulary.value, (g[0] for g in _groups(batches, 0, vocabulary.value)))
        flat = _flat(new).astype(np.float64) * seen
        yield pa.record_batch([pa.array(np.append(np.arange(len(flat)), -1), pa.int32()), pa.array(np.append(flat, float(seen)))], names=["slot", "sum"])

    def mean(rows: DataFrame, before: dict) -> dict:
        got = rows.groupBy("slot").agg(F.sum("sum").alias("sum")).toPandas()
        got = got.set_index("slot")["sum"]
        n = got.pop(-1) if -1 in got.index else 0
        return _shaped(got.sort_index().to_numpy() / n, before) if n else before

    texts = docs.select(F.col("text").cast("string"), "doc_id")
    sample = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_DOCS)
    some = texts.join(F.broadcast(sample), "doc_id", "left_semi").select("text").repartition(1).sortWithinPartitions("text")
    warm = mean(some.mapInArrow(lambda b: trained(b, first), "slot int, sum double"), first)
    shared = spark.sparkContext.broadcast(warm)
    shards = -(-v.total // SHARD_TOKENS) or 1
    # rows without an id are told apart by their texts
    key = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text"))
    dealt = texts.withColumn("_shard", F.pmod(key, F.lit(shards))).repartition(shards, "_shard").sortWithinPartitions("_shard", "doc_id", F.xxhash64("text")).select("_shard", "text")

    def by_shard(batches):
        """A model for each shard; a task may hold several, or none."""
        def parts():
            for b in batches:
                own, at = np.array(b.column(0)), 0
                for cut in [*(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]:
                    if cut > at:
                        yield int(own[at]), b.slice(at, cut - at).select(["text"])
                    at = cut

        for _, own in groupby(parts(), key=itemgetter(0)):
            yield from trained((b for _, b in own), shared.value)

    return mean(dealt.mapInArrow(by_shard, "slot int, sum double"), warm)


def lm_scores(docs: DataFrame, holdout: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Null and empty texts are their end token alone. A null id stays null and trains (remainder 0); repeated rows are scored alike and
    count as often as they occur. Texts are scored whole. Without training documents every word is unknown. No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod("doc_id", holdout) == held).alias("held_out"))
    learn = src.where("not held_out")
    counts = materialize(count_words(learn))
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total = total or 0
    v = Vocabulary(*frequent(counts, HEAD), total, distinct)
    w = fit(learn, v)
    vocabulary, weights = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(w)

    def run(batches):
        v, w = vocabulary.value, weights.value
        for ids, tails, rows in _groups(batches, 3, v, 3_000_000):
            n = len(ids)
            flat, doc = np.concatenate(ids), np.repeat(np.arange(n), [len(x) for x in ids])
            logs = v.log_count[flat]
            own, rest = np.bincount(doc, logs, n), np.bincount(doc, np.where(flat >= v.known, logs, 0), n)
            joined, lens = np.array([len(t) for t in tails]), np.array([len(x) for x in ids])
            beyond = np.bincount(doc, flat >= v.known, n)
            part = score(w, v, ids) + rest - beyond * np.log10(v.rest)
            base = own - lens * np.log10(v.total + 0.5 * (v.distinct + 1))
            tail = [Counter(t) for t in tails]
            words = pa.array([list(t) for t in tail], pa.list_(pa.binary()))
            times = pa.array([list(t.values()) for t in tail], pa.list_(pa.int64()))
            yield pa.record_batch([*(pa.concat_arrays(c) for c in zip(*rows)), pa.array(lens), pa.array(lens - joined), pa.array(base), pa.array(part), words, times], names=["uid", "doc_id", "held_out", "n_tokens", "own_known", "base", "part", "words", "times"])

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, own_known long, base double, part double, words array<binary>, times array<long>"
    rows = materialize(src.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(run, schema))
    tail = rows.where(F.size("words") > 0).select("uid", F.explode(F.arrays_zip("words", "times")).alias("t")).select("uid", F.col("t.words").alias("word"), F.col("t.times").alias("n"))
    log_c = tail.join(counts, "word").groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("log_c"), F.sum("n").alias("found"), F.sum(F.col("n") * F.log10(F.lit(0.5))).alias("log_none"))
    out = rows.drop("words", "times").join(log_c, "uid", "left")
    missing = (F.col("n_tokens") - F.col("own_known") - F.coalesce("found", F.lit(0))) * F.log10(F.lit(0.5))
    extra = F.coalesce("log_c", F.lit(0.0)) + missing
    return out.select("doc_id", "held_out", "n_tokens", (F.col("own_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("part") + extra).alias("score"))
