import numpy as np
from tidemark.llm import image_match as m

SCHEMA = m.MEDIA


def row(i, p):
    return i, None if p is None else np.ascontiguousarray(p, np.uint8).tobytes(), None if p is None else p.shape[1], None if p is None else p.shape[0]


def sized(a, f):
    return m._resized(a.astype(np.float32), round(a.shape[0] * f), round(a.shape[1] * f)).astype(np.uint8)


def test_finds_edited_copies_and_no_others(spark):
    pics = [m.drawn(x) for x in np.random.default_rng(3).normal(size=(60, 64))]
    rows = [row(i, p) for i, p in enumerate(pics)]
    rows += [row(1000 + 100 * k + 1, m.edited(pics[20 * k], k % 3)) for k in range(3)] + [row(2001, pics[0])]
    rows += [row(3001, None), (3002, b"short", 128, 128), (None, *row(0, pics[5])[1:]), row(7, pics[7]), (3003, pics[8].tobytes(), 64, 256)]
    got = m.find_copies(spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA + ", digest string"), every=20).collect()
    assert {(r["image_id"], r["other_id"]) for r in got if r["kind"] == "copy"} == {(0, 1001), (20, 1101), (40, 1201)}
    classes = {r["image_id"]: r["other_id"] for r in got if r["kind"] == "member"}
    assert classes[2001] == 0 and classes[3001] == 3001 and classes[3002] == 3002 and classes[3003] == 3003 and None not in classes and sum(r["kind"] == "member" for r in got) == 68


def test_one_colour_small_and_no_rows(spark):
    flat = spark.createDataFrame([row(100, np.zeros((128, 128))), row(200, np.full((128, 128), 7)), row(300, np.zeros((5, 9))), row(400, np.zeros((1, 200)))], SCHEMA)
    assert {r["kind"] for r in m.find_copies(flat).collect()} == {"member"}
    assert m.find_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_media_of_null_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0] * 64, 1), (1, None, 1), (2, [], 1), (None, [float("nan")], 1)], "vec_id long, embedding array<float>, label int")
    got = m.media(rows).collect()
    assert len(got) == 5 and sum(r["pixels"] is None for r in got) == 1


def test_recall_on_pictures_and_edits_not_used_for_the_parameters(spark):
    """Other pictures of other sizes, and edits that media() doesn't make: at least 0.9 are found, and nothing else."""
    r = np.random.default_rng(77)
    pics = [m.drawn(x) for x in r.normal(size=(40, 16))]
    pics = [sized(p, 1.6) if i % 4 == 0 else p for i, p in enumerate(pics)]
    edits = [
        lambda a: a[len(a) // 12 : -len(a) // 5, a.shape[1] // 6 :],
        lambda a: sized(a[len(a) // 10 :, : -a.shape[1] // 10], 1.25),
        lambda a: sized(a, 0.8),
        lambda a: np.clip(a.astype(float) + r.normal(0, 6, a.shape), 0, 255),
        lambda a: 255 * (a / 255.0) ** 1.5,
        lambda a: np.rot90(a, 3)[6:-20, 4:-16],
    ]
    rows = [row(100 * i, p) for i, p in enumerate(pics)] + [row(100 * i + 1 + k, e(p)) for i, p in enumerate(pics) for k, e in enumerate(edits)]
    found = {(x["image_id"], x["other_id"]) for x in m.find_copies(spark.createDataFrame(rows, SCHEMA)).collect() if x["kind"] == "copy"}
    want = {(100 * i, 100 * i + 1 + k) for i in range(40) for k in range(6)}
    assert len(found & want) >= 0.9 * len(want) and not found - want


def test_the_join_finds_what_all_pairs_of_corners_hold(spark):
    """Matched corners are just the pairs of corners within MAX_BITS that agree on a table's key."""
    pics = [m.drawn(x) for x in np.random.default_rng(5).normal(size=(6, 64))]
    pics += [m.edited(p, k % 3) for k, p in enumerate(pics)]
    feats = m.described(spark.createDataFrame([row(i, p) for i, p in enumerate(pics)], SCHEMA))
    wanted = m.entries(feats.where("image_id < 3"))
    got = {(r["q_id"], r["id"], r["q_x"], r["q_y"]) for r in m.matched(wanted, m.entries(feats, m.key_filter(wanted))).collect()}
    f = [m.describe(p.astype(np.float32)) for p in pics]
    want = set()
    for i in range(3):
        for j in range(12):
            d = np.bitwise_count(f[i]["bits"].view(np.uint64)[:, None] ^ f[j]["bits"].view(np.uint64)[None]).sum(2)
            share = (m._keys(f[i]["bits"])[:, None] == m._keys(f[j]["bits"])[None]).any(2)
            want |= {(i, j, float(f[i]["x"][a]), float(f[i]["y"][a])) for a in np.nonzero((d <= m.MAX_BITS) & share & (i != j))[0]}
    assert got == want and len(want) > 100


def test_consensus_of_unturned_copies_with_noise_of_both_signs(spark):
    """Six matches: three on each side of a turn of zero; at the edge of one axis in one grid and of another in the other; and six that disagree."""
    full = 2 * np.pi
    near = [(1, 2, float(k), 0.0, full - 0.05 if k % 2 else 0.05, 0.1, 0.03, 0.03) for k in range(6)]
    edges = [(1, 3, float(k), 0.0, 1.0, 0.1, 0.159 + k % 2 * 0.002, 0.079 + k % 2 * 0.002) for k in range(6)]
    far = [(1, 4, float(k), 0.0, 1.0 + k, 0.1, 0.03, 0.03) for k in range(6)]
    placed = spark.createDataFrame(near + edges + far, "q_id long, id long, q_x double, q_y double, turn double, grow double, tx double, ty double")
    assert {(r["id"], r["votes"]) for r in m.consensus(placed).collect()} == {(2, 6), (3, 6)}
