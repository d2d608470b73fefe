"""Text, vector, classification-guard and comparison operators on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import reduce, vectors
from tidemark.plans.registry import query, table


@query("SELECT doc_id, before, used, size - used AS dropped FROM (SELECT doc_id, size, before, greatest(0, least(size, 2000 - before)) AS used FROM (SELECT doc_id, n_chars AS size, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents))")
def digest_budget(spark, d):
    """What of each document fits into its source's budget of characters, in order."""
    return reduce.within_budget_in_ranges(table(spark, d, "documents"), "source", "doc_id", F.col("n_chars"), 2000, width=500).select("doc_id", "before", "used", "dropped")


_TURNS = "(SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)"


@query(f"SELECT conv_id, substring(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 500) AS text, count(*) AS parts FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_TURNS}) WHERE before < 500 GROUP BY conv_id")
def section_text_budget(spark, d):
    rows = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return reduce.joined_text(rows, "conv_id", "turn", "text", 500)


@query(f"SELECT conv_id, sum(used)::BIGINT AS used, sum(size - used)::BIGINT AS dropped FROM (SELECT *, greatest(0, least(size, 300 - before)) AS used FROM (SELECT conv_id, length(text) AS size, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_TURNS})) GROUP BY conv_id")
def exhibit_budget(spark, d):
    rows = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return reduce.within_budget(rows, ["conv_id"], "turn", F.length("text"), 300).groupBy("conv_id").agg(F.sum("used").alias("used"), F.sum("dropped").alias("dropped"))


_TERMS = ("license", "the", "permission", "einem")


@query("SELECT doc_id, array_to_string(list_filter(['license', 'the', 'permission', 'einem'], lambda t: contains(lower(text), t)), ',') AS flags FROM documents WHERE len(list_filter(['license', 'the', 'permission', 'einem'], lambda t: contains(lower(text), t))) > 0")
def red_flags(spark, d):
    found = text.terms_in(F.col("text"), _TERMS)
    return table(spark, d, "documents").select("doc_id", found.alias("f")).where(F.size("f") > 0).select("doc_id", F.array_join("f", ",").alias("flags"))


@query("SELECT h AS block_hash, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS h FROM documents) GROUP BY h")
def block_hash_carry(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.block_hash(F.col("text")).alias("block_hash"))
    return rows.groupBy("block_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON length(trim(regexp_replace(b.text, '\\s+', ' ', 'g'), ' ')) >= 12 AND contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'), ' ')), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'), ' ')))")
def quote_grounding(spark, d):
    """Benchmark passages that documents hold."""
    return text.grounded_quotes(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("SELECT regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS slug, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def canonical_first_wins(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    return reduce.canonical(parts, text.slug(F.col("p_brand")), "p_partkey").select("slug", "p_partkey")


_V = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
s AS (SELECT c.label AS pair, c.vec_id AS cur, p.vec_id AS pri, list_sum(list_transform(list_zip(c.v, p.v), lambda t: t[1] * t[2])) / (c.n * p.n) AS sim FROM e c JOIN e p ON p.label = c.label AND c.vec_id % 2 = 0 AND p.vec_id % 2 = 1),
bc AS (SELECT pair, cur, arg_max(pri, (sim, -pri)) AS pri, max(sim) AS sim FROM s GROUP BY ALL), bp AS (SELECT pair, pri, max(sim) AS sim FROM s GROUP BY ALL),
ch AS (SELECT pair, CASE WHEN sim >= 0.30 THEN 'carried' WHEN sim >= 0.22 THEN 'changed' ELSE 'added' END AS change_type, cur AS current_index, CASE WHEN sim >= 0.22 THEN pri END AS prior_index, round(sim, 4) AS similarity FROM bc
UNION ALL SELECT pair, 'dropped', NULL, pri, round(sim, 4) FROM bp WHERE sim < 0.22)"""


def _changes(spark, d):
    e = table(spark, d, "embeddings").withColumn("block_index", F.col("vec_id"))
    return vectors.changes(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "label", carry=0.30, change=0.22)


@query(f"WITH {_V} SELECT * FROM ch")
def vector_diff_changes(spark, d):
    return _changes(spark, d)


@query(f"WITH {_V} SELECT pair, count(*) FILTER (change_type = 'added') AS added_count, count(*) FILTER (change_type = 'changed') AS changed_count, count(*) FILTER (change_type = 'carried') AS carried_count, count(*) FILTER (change_type = 'dropped') AS dropped_count FROM ch GROUP BY pair")
def vector_diff_counts(spark, d):
    return vectors.change_counts(_changes(spark, d))


@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT query_id, vec_id, position, round(sim, 4) AS similarity FROM (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda t: t[1] * t[2])) / (q.n * r.n) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.v, r.v), lambda t: t[1] * t[2])) / (q.n * r.n) DESC, r.vec_id) AS position FROM e q JOIN e r ON q.label = r.label AND q.vec_id <> r.vec_id WHERE q.vec_id % 10 = 0) WHERE position <= 3")
def cosine_topk(spark, d):
    """Three nearest vectors of the same label for a stated query set, the vectors whose id is divisible by ten."""
    e = table(spark, d, "embeddings")
    near = vectors.nearest(e.where("vec_id % 10 = 0"), e, "label", 3)
    return near.select("query_id", "vec_id", F.col("position").cast("long").alias("position"), F.round("similarity", 4).alias("similarity"))


_SETS = "s AS (SELECT l_orderkey AS k, l_orderkey // 32 AS g, list_sort(list_distinct(list(l_returnflag || CAST(l_linenumber AS VARCHAR)))) AS items FROM lineitem GROUP BY l_orderkey)"


def _sets(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.expr("l_orderkey div 32").alias("g")).agg(F.sort_array(F.collect_set(F.concat("l_returnflag", F.col("l_linenumber").cast("string")))).alias("items"))


@query(f"WITH {_SETS} SELECT k, array_to_string(items, ',') AS items FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.g = a.g AND b.k <> a.k AND list_has_all(b.items, a.items) AND (NOT list_has_all(a.items, b.items) OR b.k < a.k))")
def subsumed_sets(spark, d):
    """Orders of a small block of orders whose item set isn't part of another's."""
    return reduce.maximal(_sets(spark, d), "g", "k", "items").select("k", F.array_join("items", ",").alias("items"))


@query(f"WITH {_SETS} SELECT count(*) AS over_emitted FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.g = a.g AND b.k <> a.k AND list_has_all(b.items, a.items) AND (NOT list_has_all(a.items, b.items) OR b.k < a.k))")
def over_emission(spark, d):
    return reduce.over_emitted(_sets(spark, d), "g", "k", "items").agg(F.count("*").alias("over_emitted"))


@query("""WITH s AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag || l_linenumber))) AS known FROM lineitem GROUP BY 1),
r AS (SELECT k, known, 'X' || (k % 3) AS anchor, list_filter(['A2', 'N1', 'R3', 'A2', 'R1'], lambda i: list_contains(known, i)) AS real FROM s)
SELECT k, real[1] AS anchor, array_to_string(list_filter(['A2', 'N1', 'R3', 'R1'], lambda i: list_contains(known, i)), ',') AS items FROM r WHERE len(real) > 0""")
def ground_items(spark, d):
    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("known"))
    claimed = F.array(*[F.lit(x) for x in ("A2", "N1", "R3", "A2", "R1")])
    anchor, items = reduce.grounded(F.concat(F.lit("X"), (F.col("k") % 3).cast("string")), claimed, F.col("known"))
    return sets.select("k", anchor.alias("anchor"), F.array_join(items, ",").alias("items")).where("anchor is not null")


@query("SELECT l_orderkey, idx, l_partkey FROM (SELECT l_orderkey, l_linenumber % 4 AS idx, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 4 ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_linenumber % 4 BETWEEN 1 AND 3) WHERE rn = 1")
def sanitize_first_valid(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 4).alias("idx"), "l_partkey", F.lit(3).alias("size"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return reduce.first_valid(rows, ["l_orderkey"], "idx", "at", "size").select("l_orderkey", "idx", "l_partkey")


_ARMS = "a AS (SELECT doc_id, quality AS label_a, quality * 1.0::DOUBLE AS score_a FROM labels), b AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS label_b, least(1.0, n_chars / 4000.0)::DOUBLE AS score_b FROM documents WHERE doc_id % 3 <> 0)"


@query(f"WITH {_ARMS} SELECT doc_id, CASE WHEN label_a IS NOT NULL AND label_b IS NOT NULL THEN 'both' WHEN label_a IS NOT NULL THEN 'a' ELSE 'b' END AS present_in, label_a, label_b, coalesce(label_a <> label_b, false) AS changed, round(score_b - score_a, 5) AS delta FROM a FULL JOIN b USING (doc_id)")
def ab_diff(spark, d):
    left = table(spark, d, "labels").select("doc_id", "quality", F.col("quality").cast("double").alias("score"))
    right = table(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("quality"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    out = reduce.compared(left, right, "doc_id", "quality", "score").withColumn("delta", F.round("delta", 5))
    return out.withColumns({c: F.col(c).cast("int") for c in ("label_a", "label_b")})


@query("SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (quality = 1 AND n_chars > 1500) AS tp, count(*) FILTER (quality = 0 AND n_chars > 1500) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1500) AS fn FROM documents JOIN labels USING (doc_id))")
def prf1(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return reduce.precision_recall(rows, F.col("quality") == 1, F.col("n_chars") > 1500).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, pos - 1 AS pos, token FROM (SELECT p_partkey, unnest(list_filter(list_transform(string_split(replace(p_name, ' ', ' , ,'), ','), lambda x: trim(x)), lambda x: x <> '')) AS token, generate_subscripts(list_filter(list_transform(string_split(replace(p_name, ' ', ' , ,'), ','), lambda x: trim(x)), lambda x: x <> ''), 1) AS pos FROM part)")
def split_items_field(spark, d):
    parts = text.split_items(F.regexp_replace("p_name", " ", " , ,"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(parts).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT p_type AS leaf, count(*) AS n, CASE WHEN p_type LIKE 'S%' THEN 'standard' ELSE 'other' END AS domain FROM part GROUP BY p_type")
def domain_rollup(spark, d):
    parts = table(spark, d, "part")
    domains = parts.where("p_type like 'S%'").select(F.col("p_type").alias("leaf")).distinct().withColumn("domain", F.lit("standard"))
    return reduce.rolled_up(parts.groupBy(F.col("p_type").alias("leaf")).agg(F.count("*").alias("n")), "leaf", domains)


@query("SELECT p_partkey, CASE WHEN lower(trim(p_type)) IN ('small', 'large') THEN lower(trim(p_type)) ELSE 'other' END AS kind, least(1.0, greatest(0.0, p_retailprice / 1500))::DOUBLE AS confidence FROM part")
def governed_values(spark, d):
    return table(spark, d, "part").select("p_partkey", text.coerced(F.col("p_type"), ("small", "large"), "other").alias("kind"), text.clamped(F.col("p_retailprice") / 1500).alias("confidence"))
