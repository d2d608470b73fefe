"""Image copies by local descriptors: multiscale corners, orientation-normalised binary tests, Hamming-table joins, geometric consensus.

A media column holds 8-bit grey pixels, row by row, with a width and a height; images are described at their own size. Each image is described once.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Ratio of the pyramid's levels, and their number at most; pixels around a corner that describe it; corners of the first level at most.
STEP, LEVELS, RADIUS, CORNERS = 0.84, 6, 15, 20
#: Bits of a descriptor, of a table's key (tables take bits that no other has), most differing bits of a match, matches that must agree on one placing.
BITS, KEY_BITS, MAX_BITS, VOTES = 256, 28, 24, 6
TABLES = BITS // KEY_BITS


def _tests(n: int = BITS) -> np.ndarray:
    """Ends (x, y) and (x, y) of the binary tests, before turning. Both ends lie about equally far along the direction of the patch, as a patch is
    brighter ahead and the outcome would be known beforehand; so the bits are close to even and keys tell patches apart."""
    t = np.clip(np.random.default_rng(11).normal(0, RADIUS / 2.2, (20_000, 4)), -RADIUS * 0.7, RADIUS * 0.7)
    return t[(abs(t[:, 0] - t[:, 2]) <= 1.7) & (abs(t[:, 1] - t[:, 3]) >= 3)][:n]


_TESTS = _tests()
#: The bits of each table's key: a fixed shuffle, so that a key's tests lie all over the patch.
_KEYS = np.random.default_rng(12).permutation(BITS)[: TABLES * KEY_BITS].reshape(TABLES, KEY_BITS)


def _along(a: np.ndarray, fold, n: int, beyond: float | None = None) -> np.ndarray:
    """Folds each pixel's n neighbours along both axes, one after the other; pixels beyond the border are like those at it, or as given."""
    h = n // 2
    for _ in (0, 1):
        p = np.empty((len(a) + 2 * h, a.shape[1]), a.dtype)
        p[h:-h] = a
        p[:h], p[-h:] = (a[:1], a[-1:]) if beyond is None else (beyond, beyond)
        out = fold(p[: len(a)], p[1 : len(a) + 1])
        for i in range(2, n):
            fold(out, p[i : i + len(a)], out=out)
        a = np.ascontiguousarray(out.T)
    return a


def _blur(a: np.ndarray) -> np.ndarray:
    """Mean of 3 x 3 neighbours."""
    return _along(a, np.add, 3) * np.float32(1 / 9)


def _resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Image of another size by linear interpolation."""
    for axis, n in ((0, height), (1, width)):
        x = np.linspace(0, a.shape[axis] - 1, n)
        i = np.clip(x.astype(int), 0, max(0, a.shape[axis] - 2))
        f = (x - i).astype(np.float32)
        f = f[:, None] if axis == 0 else f
        a = np.take(a, i, axis) * (1 - f) + np.take(a, np.minimum(i + 1, a.shape[axis] - 1), axis) * f
    return a


def corners(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the strongest corners (structure tensor, local maxima) away from the border."""
    gy, gx = np.gradient(a)
    xx, yy, xy = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
    r = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
    ok = (r == _along(r, np.maximum, 5, -np.inf)) & (r > 1e-3 * max(r.max(), 1e-9))
    ok[:RADIUS] = ok[-RADIUS:] = ok[:, :RADIUS] = ok[:, -RADIUS:] = False
    y, x = np.nonzero(ok)
    best = np.argsort(-r[y, x], kind="stable")[:most]
    return y[best], x[best]


_DY, _DX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1].astype(np.float32)
_DISC = _DY**2 + _DX**2 <= RADIUS**2
#: A described corner: place from the image's middle (where an error of the angle moves it least), angle, scale, the image's longer side, descriptor.
FEATURE = np.dtype([("x", "<f4"), ("y", "<f4"), ("angle", "<f4"), ("scale", "<f4"), ("side", "<f4"), ("bits", "<i8", BITS // 64)])


def describe(a: np.ndarray) -> np.ndarray:
    """The corners (FEATURE) of an image (float32) over all levels of its pyramid, in the image's own coordinates. Images of less than 2 * RADIUS + 6 pixels a side have none."""
    out, (height, width) = [np.zeros(0, FEATURE)], a.shape
    for level in range(LEVELS):
        s = STEP**level
        h, w = round(height * s), round(width * s)
        if min(h, w) < 2 * RADIUS + 6:
            break
        b = _blur(_blur(a if level == 0 else _resized(a, h, w)))
        y, x = corners(b, max(4, round(CORNERS * s)))
        if not len(y):
            continue
        patch = b[y[:, None, None] + _DY.astype(int), x[:, None, None] + _DX.astype(int)] * _DISC
        angle = np.arctan2((patch * _DY).sum((1, 2)), (patch * _DX).sum((1, 2))).astype(np.float64)
        c, t = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px, py = _TESTS[:, ::2] * c - _TESTS[:, 1::2] * t, _TESTS[:, ::2] * t + _TESTS[:, 1::2] * c
        v = b[np.rint(y[:, None, None] + py).astype(int), np.rint(x[:, None, None] + px).astype(int)]
        f = np.zeros(len(y), FEATURE)
        f["x"], f["y"] = x * ((width - 1) / (w - 1)) - (width - 1) / 2, y * ((height - 1) / (h - 1)) - (height - 1) / 2
        f["angle"], f["scale"], f["side"] = angle, 1 / s, max(height, width)
        f["bits"] = np.packbits(v[:, :, 0] < v[:, :, 1], axis=1).view("<i8")
        out.append(f)
    return np.concatenate(out)


def described(images: DataFrame) -> DataFrame:
    """image_id, digest of the pixels and size, and feats (FEATURE, binary; null where the pixels are null or don't fit the size) of every image with an id."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids, digests, feats = [], [], []
                for i, raw, w, h in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    good = raw is not None and w is not None and h is not None and min(w, h) > 0 and len(raw) == w * h
                    ids.append(i)
                    digests.append(hashlib.sha256(f"{w} {h} ".encode() + (raw or b"")).digest() if raw is not None else b"none %d" % i)
                    feats.append(describe(np.frombuffer(raw, np.uint8).reshape(h, w).astype(np.float32)).tobytes() if good else None)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(feats, pa.binary())], names=["image_id", "digest", "feats"])

    src = images.where("image_id is not null").select(F.col("image_id").cast("long"), F.col("pixels").cast("binary"), F.col("width").cast("long"), F.col("height").cast("long"))
    return materialize(src.mapInArrow(run, "image_id long, digest binary, feats binary"))


ENTRY = "key long, id long, x float, y float, angle float, scale float, side float, " + ", ".join(f"b{k} long" for k in range(BITS // 64))


def _keys(bits: np.ndarray) -> np.ndarray:
    """Features by tables: the key of each, which begins with the table's number."""
    one = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(bits), -1), axis=1)
    return np.stack([one[:, k].astype(np.int64) @ (1 << np.arange(KEY_BITS)) + (t << KEY_BITS) for t, k in enumerate(_KEYS)], 1)


#: Bits of the filter of the queries' keys, a fixed 2 MB, and to a row of Spark's bitmaps.
FILTER_BITS, _ROW = 1 << 24, 1 << 15


def _place(key):
    """A key's bit in the filter, of a numpy array or of a column alike."""
    low = key % (1 << 20)
    return (low * 40_507 + (key - low) / (1 << 20)) % FILTER_BITS if isinstance(key, Column) else (low * 40_507 + (key >> 20)) % FILTER_BITS


def entries(reps: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """A row (ENTRY) for each corner and table. With ``asked`` (from key_filter), entries whose key no query has mostly stay behind; those that some query has never do."""
    shared = None if asked is None else reps.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [np.frombuffer(x or b"", FEATURE) for x in part.column(1).to_pylist()]
                f, ids = np.concatenate([*found, np.zeros(0, FEATURE)]), np.repeat(np.array(part.column(0), np.int64), [len(x) for x in found])
                keys = _keys(f["bits"]) if len(f) else np.zeros((0, TABLES), np.int64)
                at = _place(keys)
                keep = np.ones(keys.shape, bool) if shared is None else (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                row, table = np.nonzero(keep)
                own = f[row]
                cols = [keys[row, table], ids[row], *(np.ascontiguousarray(own[c]) for c in FEATURE.names[:-1]), *(np.ascontiguousarray(own["bits"][:, k]) for k in range(BITS // 64))]
                yield pa.record_batch([pa.array(c) for c in cols], names=[c.split()[0] for c in ENTRY.split(", ")])

    return reps.select("image_id", "feats").mapInArrow(run, ENTRY)


def key_filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each place of a key. Tasks send at most the filter's own rows; the driver gets FILTER_BITS / _ROW rows of 4 KB."""
    at = _place(F.col("key")).cast("long").alias("at")
    rows = wanted.select(at).groupBy(F.expr(f"at div {_ROW}").alias("row")).agg(F.bitmap_construct_agg((F.col("at") % _ROW).cast("long")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r["row"] * (_ROW // 8) :][: _ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


#: Bins of the turn in a full circle.
TURNS = 9


def consensus(placed: DataFrame) -> DataFrame:
    """q_id, id and votes of the pairs that have VOTES or more matched corners (q_x, q_y) in one bin of turn, grow (log2), tx and ty (shares of the longer side).

    Pairs of fewer matched corners in all go first. Each axis's bins are laid twice, half a bin apart, independently of the other axes' (16 grids); those of
    the turn close at a full circle.
    """
    # two images have a fixed number of corners at most, so these lists have a fixed length at most
    own = placed.groupBy("q_id", "id").agg(F.collect_set(F.struct("q_x", "q_y", "turn", "grow", "tx", "ty")).alias("m"))
    own = own.where(F.size(F.array_distinct(F.transform("m", lambda x: F.struct(x["q_x"], x["q_y"])))) >= VOTES)
    placed = own.select("q_id", "id", F.explode("m").alias("m")).select("q_id", "id", "m.*")
    axes = {"turn": 2 * math.pi / TURNS, "grow": 0.6, "tx": 0.16, "ty": 0.16}
    bins = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(15))))
    for k, (c, step) in enumerate(axes.items()):
        at = F.floor(F.col(c) / step + F.shiftright("o", k).bitwiseAND(F.lit(1)) * 0.5)
        bins = bins.withColumn(f"b_{c}", F.pmod(at, F.lit(TURNS)) if c == "turn" else at)
    votes = bins.groupBy("q_id", "id", "o", *[f"b_{c}" for c in axes]).agg(F.count_distinct("q_x", "q_y").alias("votes"))
    return votes.groupBy("q_id", "id").agg(F.max("votes").alias("votes")).where(F.col("votes") >= VOTES)


def matched(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of corners of different images that share a table's key and differ in MAX_BITS or fewer bits, as the placing they imply; a pair comes once for each shared key."""
    q = wanted.select("key", *[F.col(c).alias(f"q_{c}") for c in wanted.columns if c != "key"])
    differ = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"q_b{k}"))) for k in range(BITS // 64)), F.lit(0))
    near = q.join(found, "key").where((differ <= MAX_BITS) & (F.col("q_id") != F.col("id")))
    turn, grow = F.col("angle") - F.col("q_angle"), F.col("scale") / F.col("q_scale")
    tx = F.col("x") - grow * (F.cos(turn) * F.col("q_x") - F.sin(turn) * F.col("q_y"))
    ty = F.col("y") - grow * (F.sin(turn) * F.col("q_x") + F.cos(turn) * F.col("q_y"))
    return near.select("q_id", "id", "q_x", "q_y", F.pmod(turn, F.lit(2 * math.pi)).alias("turn"), F.log2(grow).alias("grow"), (tx / F.col("side")).alias("tx"), (ty / F.col("side")).alias("ty"))


def find_copies(images: DataFrame, every: int = 100) -> DataFrame:
    """Copies of the query images (ids divisible by ``every``) among all images (image_id, pixels, width, height).

    Rows: kind ``member`` (image_id, other_id: the smallest id with the same pixels and size, its class; votes null) for every image, and kind ``copy``
    (image_id: a class with a query image, other_id: another class, votes: matched corners that agree on one turn, scale and shift). Images of equal
    pixels are one class from the start, so copies are never paired with each other. Null pixels are a class each; those that don't fit their size
    match nothing; null ids are left out; a repeated id with other pixels is in both classes. No rows give no rows; other columns are ignored.
    """
    every_image = described(images)
    classes = materialize(every_image.groupBy("digest").agg(F.min("image_id").alias("id"), F.max(F.col("image_id") % every == 0).alias("query")))
    members = every_image.join(classes, "digest").select(F.lit("member").alias("kind"), "image_id", F.col("id").alias("other_id"), F.lit(None).cast("long").alias("votes"))
    # both tables are written, so that their sizes are known and Spark broadcasts them below its threshold alone
    later = materialize(every_image.select("image_id", "digest").join(classes, "digest").where("image_id <> id").select("image_id", "digest").distinct())
    reps = every_image.where("feats is not null").join(later, ["image_id", "digest"], "left_anti")
    query = materialize(classes.where("query").select(F.col("id").alias("image_id"), "digest"))
    wanted = materialize(entries(reps.join(query, ["image_id", "digest"], "left_semi")))
    votes = consensus(matched(wanted, entries(reps, key_filter(wanted))))
    return members.unionByName(votes.select(F.lit("copy").alias("kind"), F.col("q_id").alias("image_id"), F.col("id").alias("other_id"), "votes"))


#: Width and height of a drawn picture.
SIDE = 128


def drawn(vector: np.ndarray) -> np.ndarray:
    """A picture of SIDE x SIDE grey pixels for a vector: rectangles under smooth noise, all of whose figures come from its values."""
    v = np.resize(np.nan_to_num(np.asarray(vector, float)), 64) if len(vector) else np.zeros(64)
    r = np.random.default_rng(np.frombuffer(v.astype("<f4").tobytes(), np.uint8))
    a = np.full((SIDE, SIDE), 128.0, np.float32)
    for y, x, h, w, grey in np.stack([*r.integers(0, SIDE - 12, (2, 40)), *r.integers(10, 44, (2, 40)), r.integers(0, 256, 40)], 1).tolist():
        a[y : y + h, x : x + w] = grey
    for n, w in ((5, 17.0), (9, 25.0), (17, 35.0), (33, 25.0), (65, 15.0)):
        a += np.float32(w) * _resized(r.normal(0, 1, (n, n)).astype(np.float32), SIDE, SIDE)
    return a.clip(0, 255).astype(np.uint8)


def edited(a: np.ndarray, kind: int) -> np.ndarray:
    """A cropped (0), lighter (1) or quarter-turned (2) copy."""
    if kind == 0:
        return a[9:-12, 14:-7].copy()
    if kind == 1:
        return np.clip(a * 0.8 + 30, 0, 255).astype(np.uint8)
    return np.rot90(a).copy()


#: Added to a vector's id for the id of its edited copy.
EDITED = 1 << 40
MEDIA = "image_id long, pixels binary, width int, height int"


def media(embeddings: DataFrame) -> DataFrame:
    """A media column for a table without one: a picture of every vector, and an edited copy of every twentieth. Null vectors have null pixels."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids, pics = [], []
                for i, v in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    pic = None if v is None else drawn(np.array(v, float))
                    ids.append(i)
                    pics.append(pic)
                    if i is not None and pic is not None and i % 20 == 0:
                        ids.append(i + EDITED)
                        pics.append(edited(pic, i // 20 % 3))
                pixels = pa.array([None if p is None else p.tobytes() for p in pics], pa.binary())
                sizes = [pa.array([None if p is None else p.shape[k] for p in pics], pa.int32()) for k in (1, 0)]
                yield pa.record_batch([pa.array(ids, pa.int64()), pixels, *sizes], names=["image_id", "pixels", "width", "height"])

    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, MEDIA)
