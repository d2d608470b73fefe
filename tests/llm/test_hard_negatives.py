"""Hard negatives against plain code on odd rows, clusters, hot labels and large numbers; the SQL comparison is in test_sql."""

import math
import random

import pytest
from tidemark.llm import hard_negatives
from tidemark.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<double>, label int, score double, anchor_id string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=50):
    own = []
    for vec_id, v, label, *_ in rows:
        if None in (vec_id, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((vec_id, [math.floor(256 * x) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (a, av, al) in enumerate(own):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), b, j, lb) for j, (b, v, lb) in enumerate(own) if j != i)
        for s, p, _, _ in [x for x in scored if x[3] == al][:5]:
            fit = [x for x in scored if x[3] != al and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _, _) in enumerate(fit, 1)]
    return sorted(out)


def got(spark, rows, **more):
    df = mine(spark.createDataFrame(rows, SCHEMA), **more)
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def drawn(n, seed, dim=6, centres=0, label=lambda i, r: r.randrange(4)):
    r = random.Random(seed)
    own = [[r.gauss(0, 8) for _ in range(dim)] for _ in range(centres)]
    return [(i, [x + r.gauss(0, 0.3) for x in own[i % centres]] if centres else [r.gauss(0, 1) for _ in range(dim)], label(i, r), 0.0, "x") for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "SLICE", 16)


def test_odd_rows(spark, small):
    rows = drawn(150, 1)
    rows += [(200, None, 1, 0.0, ""), (250, [1.0] * 6, None, 0.0, ""), (None, [1.0] * 6, 1, 0.0, ""), (300, [1.0, None], 1, 0.0, ""), (350, [float("nan")] * 6, 1, 0.0, ""), (400, [float("-inf")], 1, 0.0, "")]
    rows += [(450, [], 1, 0.0, ""), (500, [0.0] * 6, 2, 0.0, ""), (550, [1.0, 2.0], 2, 0.0, "short"), (600, [-1.0] * 6, 9, 0.0, "no other of its label")]
    rows += [rows[100], rows[100], rows[50], rows[3]]  # repeated anchors and rows
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 1, 0.0, "")]) == []
    assert got(spark, [(50, [1.0], 1, 0.0, "")]) == []


def test_ties_by_id(spark, small):
    rows = [(i, [1.0, 0.5], i % 3, 0.0, "") for i in range(120)]
    rows += [(1000 + i, [0.8, 0.4], i % 3, 0.0, "") for i in range(40)]
    assert got(spark, rows) == plain(rows) != []


def test_clusters_and_a_hot_label(spark, small):
    rows = drawn(700, 3, centres=12, label=lambda i, r: 1 if r.random() < 0.6 else r.randrange(10))
    assert got(spark, rows, every=10) == plain(rows, 10)


def test_clusters_are_pruned(spark, small):
    """With tight clusters candidates go to few groups; the answer stays whole."""
    rows = drawn(600, 4, centres=10, label=lambda i, r: i % 3)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = hard_negatives.whole_rows(df)
    import numpy as np

    v = np.array([r["v"] for r in whole.collect()])
    most = float((v * v).sum(1).max())
    centres = hard_negatives.pivots_of(hard_negatives.lifted(v, most), 12)
    placed = hard_negatives.placed(whole, centres, most, whole["vec_id"] % 7 == 0)
    asked = placed.where("group is not null").selectExpr("*", "0.9 * square as lo", "cast(null as double) as hi")
    n, groups = hard_negatives.served(placed, asked, centres, most, beyond_home=False).count(), asked.select("group").distinct().count()
    assert groups > 5 and n < 0.5 * groups * len(rows)
    assert got(spark, rows, every=7) == plain(rows, 7)


def test_large_numbers_are_exact(spark, small):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) * 2.0 ** r.choice([3, 17, 18]) for _ in range(4)], r.randrange(3), 0.0, "") for i in range(200)]
    assert got(spark, rows) == plain(rows) != []


def test_beyond_64_bits_does_not_fail(spark, small):
    rows = drawn(120, 6) + [(700, [3e38] * 6, 1, 0.0, ""), (701, [2e38] * 6, 1, 0.0, ""), (702, [1e300] * 6, 1, 0.0, "")]
    assert all(abs(x) < 1 << 63 for row in got(spark, rows) for x in row)
