"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are permuted so that a table's masked bits come first and sorted by Gray rank, which puts fingerprints that
share those bits next to each other: the shared bits are an upper node, held once. Below it, runs that share
further bits are nodes of the next level; pairs of nodes whose own bits differ too much are pruned as groups, and what is
left of the budget goes down to the leaves. For a radius of up to 2 the tables (all pairs of 8 bytes left unmasked) find
every link, and an upper node has at most 2**16 leaves. For wider radii of longer fingerprints, random masks
propose a pair with high probability, and nodes that hold many leaves are compared block by block.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, count
from math import acos, comb, pi, prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, components, materialize, mix

_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 (seed 42) of the k-word shingles of the text with A-Z lower-cased, repeats included; fewer words: of all of them."""
    w = text.lower().split()
    if not w:
        return []
    if len(w) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(x), 42) for x in zip(*(w[i:] for i in range(k)))]


def majority(hashes: list[int] | np.ndarray, parts: int) -> bytes:
    """Little-endian fingerprint of 64 * parts bits; a bit is 1 if set in over half the hashes. Part 0 uses the hashes as they are."""
    if not len(hashes):
        return bytes(8 * parts)
    ones, h = np.zeros((parts, 64), np.int64), np.array(hashes, "<u8")
    for lo in range(0, len(h), 1 << 15):
        for p in range(parts):
            x = h[lo : lo + (1 << 15)]
            x = x if p == 0 else mix(x * np.uint64(2 * p + 1) + np.uint64(p))
            ones[p] += np.add.reduce(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), 0, np.uint16)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, k: int, parts: int) -> DataFrame:
    """doc_id and fp (binary, big-endian) of every document, written once."""

    def run(batches):
        for b in batches:
            fps = [majority(shingle_hashes(t, k), parts)[::-1] for t in byte_texts(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp binary"))


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each 64-bit value in Gray-code order; its leading bits depend on the value's leading bits alone."""
    for s in (1, 2, 4, 8, 16, 32):
        v = v ^ (v >> np.uint64(s))
    return v


def from_rank(r: np.ndarray) -> np.ndarray:
    return r ^ (r >> np.uint64(1))


def _bits(x: np.ndarray) -> np.ndarray:
    """Ones of each 64-bit value."""
    return sum(_ONES[(x >> np.uint64(s)) & np.uint64(0xFFFF)] for s in (0, 16, 32, 48)).astype(np.int64)


def leaf_links(low: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct 16-bit leaves of one upper node, as positions: one spanning tree for each linked set of leaves.

    Leaves are grouped by their high byte (the next level's shared bits); a pair of groups is compared only if those differ by at most
    the radius, with what is left of it.
    """
    n = len(low)
    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    high, own = low >> 8, low & 0xFF
    heads = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
    ends = np.append(heads[1:], n)
    left, right = [], []
    for g in range(len(heads)):
        far = _ONES[high[heads[g:]] ^ high[heads[g]]]
        for o in np.flatnonzero(far <= radius):
            a, b = own[heads[g] : ends[g]], own[heads[g + o] : ends[g + o]]
            for i, j in np.argwhere(_ONES[a[:, None] ^ b[None, :]] <= radius - far[o]).tolist():
                x, y = root(heads[g] + i), root(heads[g + o] + j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    left.append(heads[g] + i)
                    right.append(heads[g + o] + j)
    return np.array(left, np.int64), np.array(right, np.int64)


#: The bytes that each table leaves unmasked; two fingerprints that differ in at most 2 bits agree on the masked bytes of some table.
TABLES = list(combinations(range(8), 2))


def permuted(fp: np.ndarray, table: tuple[int, int]) -> np.ndarray:
    """The table's two unmasked bytes moved to the low end, the others in their order before them."""
    order = [b for b in range(8) if b not in table] + list(table)
    return fp.astype(">u8").view(np.uint8).reshape(-1, 8)[:, order].copy().view(">u8").ravel().astype(np.uint64)


def exact_links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct 64-bit fingerprints (longs) that connect all those at ``radius`` (2 at most) or fewer bits."""
    if not 0 <= radius <= 2:
        raise ValueError("the tables cover a radius of 2 at most")

    def entries(batches):
        for b in batches:
            fp = np.array(b.column(0), np.int64).view(np.uint64)
            for t, table in enumerate(TABLES):
                rank = gray_rank(permuted(fp, table))
                yield pa.record_batch([pa.array(np.full(len(fp), t, np.int8)), pa.array((rank >> np.uint64(16)).view(np.int64)), pa.array((rank & np.uint64(0xFFFF)).astype(np.int32)), b.column(0)], names=["t", "upper", "low", "fp"])

    def search(batches):
        """Rows come sorted by table and Gray rank; an upper node ends where the next begins."""
        rest = None
        for b in batches:
            cols = [np.array(b.column(i)) for i in range(4)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            t, upper = cols[0], cols[1]
            new = np.flatnonzero((t[1:] != t[:-1]) | (upper[1:] != upper[:-1])) + 1
            cutoff = int(new[-1]) if len(new) else 0
            rest = [c[cutoff:] for c in cols]
            yield nodes([c[:cutoff] for c in cols])
        if rest is not None:
            yield nodes(rest)

    def nodes(cols):
        t, upper, low, fp = cols
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(t):
            head = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (upper[1:] != upper[:-1])))
            size = np.diff(np.append(head, len(t)))
            for h, n in zip(head[size > 1].tolist(), size[size > 1].tolist()):
                # the leaf's value: the rank's low bits start from the parity of the shared bits above
                rank = (upper[h : h + n].view(np.uint64) << np.uint64(16)) | low[h : h + n].astype(np.uint64)
                leaves = (from_rank(rank) & np.uint64(0xFFFF)).astype(np.int64)
                order = np.argsort(leaves, kind="stable")
                i, j = leaf_links(leaves[order], radius)
                left.append(fp[h : h + n][order[i]])
                right.append(fp[h : h + n][order[j]])
        return pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    index = fps.select("fp").mapInArrow(entries, "t byte, upper long, low int, fp long")
    index = index.repartition("t", "upper").sortWithinPartitions("t", "upper", "low")
    return index.mapInArrow(search, "a long, b long")


def wide_links(reps: DataFrame, bits: int, radius: int, tables: int, mask_bits: int, chunk: int = 2048, most: int | None = None, only: DataFrame | None = None, similarity: float = 0.8) -> DataFrame:
    """All pairs (a, b) of ids, a < b, of fingerprints (columns id, fp, label) of different labels at ``radius`` or fewer bits that agree on a table's
    mask, each from the first such table; the labels are any longs, or null for ids that differ from all others.

    Each table takes mask_bits random bits as the leading bits of the Gray rank, and
    fingerprints that share them are an upper node. A node is cut into blocks of at most ``chunk`` fingerprints, and every two of its blocks meet
    in a task of their own, so a node of any size is compared whole while a task holds two blocks.

    With ``most``, two blocks that have more than ``most`` pairs for each fingerprint give each fingerprint's nearest pair alone, so that a large group of copies
    doesn't give all its pairs; the fingerprints that have any are reported in rows of their own (id as a, null as b, and the node's t and upper, which are null in other rows).

    With ``only`` (t, upper, id) these are compared and no others; reps then have ``parts`` (shares_of), and a pair goes if these show that its similarity can't be ``similarity``.
    """
    least = Fraction(str(similarity))
    masks = [np.random.default_rng(1000 + t).choice(bits, mask_bits, replace=False) for t in range(tables)]
    masked = np.zeros((tables, bits), np.uint8)
    for t, mask in enumerate(masks):
        masked[t, mask] = 1
    masked = np.packbits(masked, axis=1).view(np.uint64)

    def entries(batches):
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, bits // 8)
            one = np.unpackbits(raw, axis=1)
            for t, mask in enumerate(masks):
                v = np.zeros(b.num_rows, np.uint64)
                for i in mask:
                    v = (v << np.uint64(1)) | one[:, i].astype(np.uint64)
                upper = gray_rank(v).view(np.int64)
                yield pa.record_batch([pa.array(np.full(b.num_rows, t, np.int64)), pa.array(upper), *b.columns], names=["t", "upper", "id", "label", "fp"])

    def pairs(t, own, ids, words, label, n, share):
        """Pairs within one block, or of the first n with the others, of another block; whether only the nearest are given."""
        left, right = [], []
        near = np.full(len(ids), radius + 1, np.uint16), np.zeros(len(ids), np.int64)
        total, any_ = 0, np.zeros(len(ids), bool)
        for lo in range(0, n, 256):
            hi, first = min(n, lo + 256), lo if own else n
            d = np.zeros((hi - lo, len(ids) - first), np.uint16)
            for k in range(words.shape[1]):
                d += np.bitwise_count(words[lo:hi, k][:, None] ^ words[first:, k][None, :])
            i, j = np.nonzero(d <= radius)
            new = (i + lo < j + first) & (label[i + lo] != label[j + first])
            i, j = i[new], j[new]
            if t:
                differing, new = words[i + lo] ^ words[j + first], np.ones(len(i), bool)
                for m in masked[:t]:
                    new &= (differing & m).any(1)
                i, j = i[new], j[new]
            if share is not None:
                new = within(share, i + lo, j + first)
                i, j = i[new], j[new]
            far, i, j = d[i, j], i + lo, j + first
            total += len(i)
            any_[i] = any_[j] = True
            order = np.lexsort((far, j))
            head = order[np.flatnonzero(np.append(True, np.diff(j[order]) != 0))] if len(order) else order
            head = head[far[head] < near[0][j[head]]]
            near[0][j[head]], near[1][j[head]] = far[head], i[head]
            if most is None or total <= most * len(ids):
                left.append(i)
                right.append(j)
            else:
                left, right = [], []
        thin = most is not None and total > most * len(ids)
        if thin:
            j = np.flatnonzero(near[0] <= radius)
            left, right = [near[1][j]], [j]
        i, j = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right))
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), ids[any_] if thin else ids[:0]

    def within(share, i, j):
        """Whether the sets' parts, counted by a hash of their shingles, leave room for a similarity of ``least``: sets have no more in common than their parts have."""
        sizes, out, full = share.sum(1, dtype=np.int64), np.zeros(len(i), bool), (share == (1 << 16) - 1).all(1)
        for lo in range(0, len(i), 1 << 16):
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            both = np.minimum(share[a], share[b]).sum(1, dtype=np.int64)
            room = both * (least.numerator + least.denominator) >= least.numerator * (sizes[a] + sizes[b])
            out[lo : lo + (1 << 16)] = room | full[a] | full[b]
        return out

    def nodes(cols):
        key, second, ids, label, fp = cols[:5]
        a, b, t, upper = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(ids):
            words = np.frombuffer(b"".join(fp), np.uint64).reshape(len(ids), -1)
            share = np.frombuffer(b"".join(cols[5]), np.uint16).reshape(len(ids), -1) if len(cols) > 5 else None
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            for h, n in zip(head.tolist(), np.diff(np.append(head, len(ids))).tolist()):
                firsts, own = n - int(second[h : h + n].sum()), slice(h, h + n)
                if n > 1 and firsts:
                    x, y, crowd = pairs(int(key[h, 0]), key[h, 2] == key[h, 3], ids[own], words[own], label[own], firsts, None if share is None else share[own])
                    a += [x, crowd]
                    b += [y, np.full(len(crowd), -1)]
                    t += [np.full(len(x), -1), np.full(len(crowd), key[h, 0])]
                    upper += [np.zeros(len(x), np.int64), np.full(len(crowd), key[h, 1])]
        a, b, t, upper = (np.concatenate(c) for c in (a, b, t, upper))
        return pa.record_batch([pa.array(a), pa.array(b, pa.int64(), mask=t >= 0), pa.array(t, pa.int64(), mask=t < 0), pa.array(upper, pa.int64(), mask=t < 0)], names=["a", "b", "t", "upper"])

    def search(batches):
        rest = None
        for b in batches:
            cols = [np.stack([np.array(b.column(i), np.int64) for i in range(4)], 1), *(np.array(b.column(i)) for i in (4, 5, 6)), *(np.array(b.column(i).to_pylist(), object) for i in range(7, b.num_columns))]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]).any(1)) + 1
            cutoff = int(new[-1]) if len(new) else 0
            rest = [c[cutoff:] for c in cols]
            yield nodes([c[:cutoff] for c in cols])
        if rest is not None:
            yield nodes(rest)

    if only is None:
        more, index = [], reps.select("id", F.coalesce("label", "id").alias("label"), "fp").mapInArrow(entries, "t long, upper long, id long, label long, fp binary")
    else:
        more, index = ["parts"], only.join(reps.select("id", "label", "fp", "parts"), "id").select("t", "upper", "id", "label", "fp", "parts")
    # the blocks of large nodes: few nodes, so their number of blocks is joined to all entries
    sizes = index.groupBy("t", "upper").count().where(F.col("count") > chunk).select("t", "upper", F.ceil(F.col("count") / chunk).cast("int").alias("blocks"))
    index = index.join(materialize(sizes), ["t", "upper"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    index = index.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block k meets itself and all others, the lower number first
    index = index.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    index = index.select("t", "upper", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("byte").alias("second"), "id", "label", "fp", *more)
    index = index.repartition("t", "upper", "i", "j").sortWithinPartitions("t", "upper", "i", "j", "second")
    return index.mapInArrow(search, "a long, b long, t long, upper long")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every document.

    Fingerprints of 64 bits link at ``radius`` or fewer differing bits. Null and empty texts have fingerprint zero,
    linked like any other. Repeated rows keep their rows. A document without an id keeps a null doc_id, still links others,
    and gets the smallest id reachable, or null. No rows give no rows; other columns are ignored. Copies are one class from the start, so
    only different fingerprints enter the index.
    """
    fps = fingerprints(docs, k, 1).select("doc_id", F.conv(F.hex("fp"), 16, 10).cast("decimal(20,0)").alias("u"), F.lower(F.hex("fp")).alias("fingerprint"))
    fps = fps.select("doc_id", "fingerprint", F.expr("cast(if(u >= 9223372036854775808, u - 18446744073709551616, u) as bigint)").alias("fp"))
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = components(exact_links(reps, radius))
    linked = materialize(reps.withColumnRenamed("fp", "node").join(labels, "node"))
    small = materialize(linked.groupBy("label").agg(F.min("rep").alias("component_id")))
    found = linked.select("node", "label").join(small, "label").select(F.col("node").alias("fp"), "component_id")
    classes = materialize(reps.join(found, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")))
    return fps.join(classes, "fp").select("doc_id", "fingerprint", "component_id")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the distinct k-word shingles' hashes (sorted, 8 bytes each) of every document."""

    def run(batches):
        for b in batches:
            sets = [np.unique(np.array(shingle_hashes(t, k), np.uint64)).tobytes() for t in byte_texts(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, shingles binary")


def shares_of(sets: DataFrame, buckets: int = 128) -> DataFrame:
    """id and ``parts``: how many of a set's shingles fall into each bucket (16 bits each). A set too large for these is left to the exact check: its buckets are all full."""

    def run(batches):
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                n = np.bincount((np.frombuffer(raw, np.uint64) >> np.uint64(33)).astype(np.int64) % buckets, minlength=buckets)
                out.append((n if n.max(initial=0) < 1 << 16 else np.full(buckets, (1 << 16) - 1)).astype(np.uint16).tobytes())
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["id", "parts"])

    return sets.select("id", "shingles").mapInArrow(run, "id long, parts binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (sets: id, shingles) have a Jaccard similarity of ``similarity`` or more."""
    least = Fraction(str(similarity))

    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            n, m = len(x) // 8, len(y) // 8
            if min(n, m) < least * max(n, m):
                out.append(False)
                continue
            both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            out.append(both >= least * (n + m - both))
        return pa.array(out, pa.bool_())

    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(F.arrow_udf(near, "boolean")("sa", "sb")).select("a", "b")


def recall(share: float, bits: int, radius: int, tables: int, mask_bits: int) -> float:
    """Probability that fingerprints whose bits differ with probability ``share`` are within the radius and agree on a table's mask."""
    out = 0.0
    for d in range(radius + 1):
        agree = prod((bits - d - i) / (bits - i) for i in range(mask_bits))
        out += comb(bits, d) * share**d * (1 - share) ** (bits - d) * (1 - (1 - agree) ** tables)
    return out


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8, bits: int = 256, radius: int = 62, sure: float = 0.999, node: int = 1024, most: int = 4) -> DataFrame:
    """The documents without near copies of an earlier one: of each group, that with the smallest doc_id stays, with all its columns.

    Near copies have sets of k-word shingles of a Jaccard similarity of ``similarity`` or more, counted exactly; fingerprints of the sets only propose
    pairs. Equal sets are one class from the start. Sets of similarity 0.8 have a cosine of 0.89, whose fingerprints of 256 bits differ in 39 bits on
    average (standard deviation 6). Masks grow with the documents, so that an upper node has about ``node`` fingerprints if bits are even, and there are as
    many tables as propose a pair at the similarity with probability ``sure`` by that model.

    Crowded nodes (more than ``most`` pairs for each fingerprint) propose the nearest pairs first; once those that hold have made groups, all pairs of these
    nodes whose ends are still in different groups follow, but for those that can't be similar by how many shingles they have in each of 128 buckets (an
    upper bound, so it loses none). So no link between groups is lost and a large group doesn't give all its pairs.

    Texts without words are one group. Of rows with the same doc_id one stays; null ids stay as they are. No rows give no rows.
    """

    def run(batches):
        for b in batches:
            sets = [np.unique(np.array(shingle_hashes(t, k), np.uint64)) for t in byte_texts(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([majority(x, bits // 64) for x in sets], pa.binary())], names=["doc_id", "digest", "fp"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    reps = texts.mapInArrow(run, "doc_id long, digest binary, fp binary")
    reps = materialize(reps.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp")).withColumn("label", F.col("id")))
    mask_bits = max(8, (reps.count() // node).bit_length())
    differ = acos(2 * similarity / (1 + similarity)) / pi
    tables = next(t for t in count(1) if recall(differ, bits, radius, t, mask_bits) >= sure)

    found = materialize(wide_links(reps, bits, radius, tables, mask_bits, most=most))
    pairs = found.where("t is null and a <> b").select("a", "b").distinct()
    crowd = materialize(found.where("t is not null").select("t", "upper", F.col("a").alias("id")).distinct())
    # one pass over the texts gives the sets of all that either pass compares
    asked = pairs.selectExpr("stack(2, a, b) as doc_id").unionByName(crowd.select(F.col("id").alias("doc_id"))).distinct()
    sets = materialize(shingle_sets(texts.join(asked, "doc_id", "left_semi"), k).select(F.col("doc_id").alias("id"), "shingles").distinct())
    links = materialize(confirmed(pairs, sets, similarity))
    if not crowd.isEmpty():
        members = crowd.select("id").distinct()
        groups = components(links).select(F.col("node").alias("id"), F.col("label").alias("_group"))
        grouped = reps.join(members, "id", "left_semi").join(groups, "id", "left").join(shares_of(sets.join(members, "id", "left_semi")), "id")
        grouped = materialize(grouped.select("id", "fp", F.coalesce("_group", "id").alias("label"), "parts").distinct())
        further = wide_links(grouped, bits, radius, tables, mask_bits, only=crowd, similarity=similarity).where("a <> b").select("a", "b").distinct()
        links = links.unionByName(confirmed(materialize(further), sets, similarity))
    labels = components(links.distinct())
    stay = reps.select("id").join(labels.where("node <> label").select(F.col("node").alias("id")), "id", "left_anti")
    stay = materialize(stay.withColumnRenamed("id", "doc_id").distinct())
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)
