import numpy as np
from tidemark.operators import vectors


def test_changes_in_parts_of_any_size(spark):
    r = np.random.default_rng(6)
    schema = "pair string, block_index long, embedding array<double>"
    side = lambda n: [("a", i, r.normal(size=8).tolist()) for i in range(n)]
    old = side(90)
    new = [("a", i, (np.array(old[i][2]) + r.normal(size=8) * (i % 3) * 0.3).tolist()) for i in range(50)] + [("a", 50 + i, x[2]) for i, x in enumerate(side(30))]
    new, old = new + [("b", 1, [1.0] * 8), ("d", 1, [0.0] * 8)], old + [("c", 4, [1.0] * 8), ("c", 5, [1.0] * 8), ("d", 2, [1.0] * 8)]
    new += [("e", 1, [1.0, 0.0] * 4)]
    old += [("e", i, [2.0, 0.0] * 4) for i in range(20, 0, -1)]
    frames = spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = []
    for pair in "abcde":
        cs, ps = ([(i, unit(v)) for p, i, v in rows if p == pair] for rows in (new, old))
        for i, c in cs:
            best, at = max(((float(c @ p), -j) for j, p in ps), default=(None, 0))
            kind = "added" if best is None or best < 0.7 else "changed" if best < 0.97 else "carried"
            want.append((pair, kind, i, -at if kind != "added" else None, best if best is None else round(best, 4)))
        for j, p in ps:
            best = max((float(c @ p) for _, c in cs), default=None)
            if best is None or best < 0.7:
                want.append((pair, "dropped", None, j, best if best is None else round(best, 4)))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    for size in (7, 1024):
        got = [tuple(x) for x in vectors.changes(*frames, "pair", size=size).collect()]
        strip = lambda rows: order((*x[:4],) if x[0] != "e" else (*x[:3], None) for x in rows)
        assert strip(got) == strip(want)
        assert np.allclose([x[4] or 0 for x in order(got)], [x[4] or 0 for x in order(want)], atol=2e-4)


def test_nearest_in_parts_of_any_size(spark):
    r = np.random.default_rng(7)
    rows = [(i, i % 3 if i % 17 else None, r.normal(size=6).tolist()) for i in range(120)] + [(200, 1, [0.0] * 6), (201, 1, None)] + [(300 + i, 5, [1.0, 2.0]) for i in range(6)] + [(400, 9, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, g int, embedding array<double>")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = []
    for i, g, v in rows:
        if i % 4 == 0 and g is not None and v is not None:
            near = sorted((-float(unit(v) @ unit(w)), j) for j, h, w in rows if h == g and j != i and w is not None)[:3]
            want += [(i, j, k, round(-s, 6)) for k, (s, j) in enumerate(near, 1)]
    for size in (5, 1024):
        got = sorted((x["query_id"], x["vec_id"], x["position"], round(x["similarity"], 6)) for x in vectors.nearest(df.where("vec_id % 4 = 0"), df, "g", 3, size=size).collect())
        assert [g[:3] for g in got if g[0] < 300] == [w[:3] for w in sorted(want) if w[0] < 300] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])
    assert vectors.nearest(df.limit(0), df, "g", 3).count() == 0
