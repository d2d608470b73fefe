from fractions import Fraction

import pytest
from tidemark.llm import mixing

SCHEMA = "doc_id long, source string"


@pytest.mark.parametrize("sources", [21, 2000])
def test_every_prefix_is_within_a_block_of_the_given_weights(sources):
    weights = {f"s{i}": 0.5 if i == 0 else (0.333 if i == 1 else 0.167 / (sources - 2)) for i in range(sources)}
    part = list(mixing.parts(weights).values())
    slots, total = 20_000, sum(part)
    assert all(Fraction(p, total) == Fraction(w) / sum(map(Fraction, weights.values())) for p, w in zip(part, weights.values()))
    placed = [0] * sources
    for (k, j, release, due, slot), t in zip(mixing.schedule(part, [slots] * sources), range(slots)):
        assert slot == t and j == placed[k] and release <= slot < due
        placed[k] += 1
        assert abs(placed[k] * total - part[k] * (t + 1)) < total
        if t % 500 == 0:
            assert all(abs(n * total - p * (t + 1)) < total for n, p in zip(placed, part))


def test_mix_against_weights_with_sources_that_run_out(spark):
    size = {"a": 400, "b": 90, "c": 30, None: 25}
    rows = [(1000 * i + j, s) for i, (s, n) in enumerate(size.items()) for j in range(n)] + [(None, "a"), (0, "a")]
    weights = {"a": 0.5, "b": 0.333, "c": 0.1, "absent": 5.0}
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights, block=2, other=0.067).collect()
    assert sorted((r["doc_id"] or -1, r["source"] or "") for r in got) == sorted((i or -1, s or "") for i, s in rows)
    assert len({r["place"] for r in got}) == len(rows)
    share = {**{s: Fraction(weights[s]) for s in "abc"}, None: Fraction(0.067)}
    total = sum(share.values())
    for s, w in share.items():
        w = w / total
        slots = {r["block"]: (r["slot"], r["release"], r["deadline"]) for r in got if r["source"] == s}
        assert len(slots) == -(-sum(r["source"] == s for r in got) // 2)
        for j, (slot, release, due) in slots.items():
            assert release == int(j / w) and due == -int(-(j + 1) / w // 1) and release <= slot < due


def test_more_sources_than_a_thousand_and_no_rows(spark):
    rows = [(i, f"s{i % 1500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len(mixing.root_weights(docs)) == len(mixing.equal_weights(docs)) == 1500
    assert mixing.mix(docs, mixing.root_weights(docs)).select("place").distinct().count() == 3000
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none, {}).count() == 0 and mixing.in_mixed_order(none, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s1": 0.0})


def test_sources_too_many_to_broadcast_are_mixed_alike(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"s{i % 40}") for i in range(600)] + [(None, None), (7, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = mixing.root_weights(docs)
    key = lambda r: tuple((x is None, x) for x in r)
    found = lambda: sorted((tuple(r) for r in mixing.mix(docs, weights).select("doc_id", "source", "slot", "place").collect()), key=key)
    near = found()
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert found() == near


def test_ranges_of_slots_give_the_same_schedule():
    """Every start: the state worked out from the weights is that of the schedule from the first slot on, also after sources have run out."""
    import numpy as np

    r = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        for _ in range(6):
            part = list(mixing.parts({i: float(x) for i, x in enumerate(r.choice([0.01, 0.2, 1.0, 3.7], n) * r.uniform(0.5, 1.5, n))}).values())
            blocks = r.integers(0, 120, n).tolist()
            whole = list(mixing.schedule(part, blocks))
            assert len(whole) == sum(blocks) and all(release <= slot < due for _, _, release, due, slot in whole)
            for at in {0, 1, 2, 3, 17, *r.integers(0, 1 + max((x[4] for x in whole), default=0), 12).tolist()}:
                placed = [0] * n
                for k, *_, slot in whole:
                    placed[k] += slot < at
                assert mixing.standing(part, blocks, at) == placed
                assert list(mixing.schedule(part, blocks, at, at + 50)) == [x for x in whole if at <= x[4] < at + 50]


def test_planned_in_ranges(spark):
    part = mixing.parts({"a": 0.7, "b": 0.2, None: 0.1})
    size = {"a": 300, "b": 20, None: 90}
    one, many = ({tuple(r) for r in mixing.planned(spark, part, size, slots).collect()} for slots in (1 << 20, 37))
    assert one == many and len(one) == 410


def test_order_keeps_columns_of_any_name(spark):
    """Columns named like the operator's own, null ids and sources, repeated rows; each comes once, in the order of the mix."""
    rows = [(i if i % 5 else None, f"s{i % 3}" if i % 4 else None, i, -i, f"t{i % 7}", i) for i in range(300)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, _n int, _place int, `a.b` string, place int")
    out = mixing.in_mixed_order(docs, {"s0": 3.0, "s1": 1.0}, block=4)
    got = out.collect()
    assert out.columns == docs.columns and sorted(map(str, got)) == sorted(map(str, docs.collect()))


def test_rows_are_dealt_out_once_to_be_joined_to_their_places(spark):
    """Without broadcasts too, the texts go through two exchanges: by id and by place. Id 0 and no id stay apart."""
    docs = spark.createDataFrame([(0, "a", "zero"), (None, "a", "none"), (1, "b", "one")], "doc_id long, source string, text string")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mixing.in_mixed_order(docs, {"a": 1.0, "b": 1.0})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["text"] for r in out.collect()) == ["none", "one", "zero"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange rangepartitioning") == 1
