"""Containment by rare items against all pairs, with a hot group; ownership documents are parsed once."""

import random

from pyspark.sql import functions as F
from tidemark.operators import reduce
from tidemark.sources import ownership

SCHEMA = "g int, k int, items array<string>"


def inside(rows):
    """(g, k) of sets that are part of another's, by comparing all pairs."""
    out = set()
    for g, k, a in rows:
        for h, j, b in rows:
            if None not in (g, h, k, j) and a is not None and b is not None and g == h and k != j and set(a) <= set(b) and (set(a) < set(b) or j < k):
                out.add((g, k))
    return out


def test_sets_against_all_pairs(spark):
    r = random.Random(1)
    rows = [(r.choice([0, 0, 0, 1, 2]), k, [f"i{int(r.paretovariate(0.7)) % 30}" for _ in range(r.randrange(6))]) for k in range(300)]
    rows += [(7, 1, []), (7, 2, []), (8, 1, []), (9, 1, ["a", "a"]), (9, 2, ["a"]), (None, 3, ["a"]), (9, None, ["a"]), (9, 5, None), (9, 6, ["b", "a", "a"]), (9, 7, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    gone = inside(rows)
    assert {tuple(x) for x in reduce.subsumed(df, "g", "k", "items").collect()} == gone
    key = lambda x: (x is None, x or 0)
    kept = sorted(((x["g"], x["k"]) for x in reduce.maximal(df, "g", "k", "items").collect()), key=lambda x: (key(x[0]), key(x[1])))
    assert kept == sorted(((g, k) for g, k, _ in rows if (g, k) not in gone), key=lambda x: (key(x[0]), key(x[1])))
    assert {(x["g"], x["k"]) for x in reduce.over_emitted(df, "g", "k", "items").collect()} == gone


def test_candidates_of_a_hot_group_are_few(spark):
    """A thousand sets share an item: pairs by the rarest item stay far below the million of all pairs."""
    rows = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("k"), F.array(F.lit("common"), F.concat(F.lit("own"), (F.col("id") % 400).cast("string"))).alias("items"))
    out = reduce.subsumed(rows, "g", "k", "items")
    assert out.count() == 600
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_x#" in plan and rows.count() == 1000
    each = rows.select("k", F.explode("items").alias("x"))
    often = each.groupBy("x").agg(F.count("*").alias("n"))
    assert each.join(often, "x").groupBy("k").agg(F.min("n").alias("n")).agg(F.sum("n")).first()[0] <= 3000


def test_one_parse_a_document(spark):
    text = "<ownershipDocument><issuer><issuerCik>1</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>2</rptOwnerCik></reportingOwnerId></reportingOwner></ownershipDocument>"
    df = spark.createDataFrame([("a", text), ("b", "no document"), ("c", None)], "accession_number string, text string")
    rows = ownership.parsed(df)
    plan = rows.where("parsed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("xmltostructs(") + plan.lower().count("from_xml(") == 1
    assert {x["accession_number"]: x["parsed"] for x in rows.collect()} == {"a": True, "b": False, "c": False}
