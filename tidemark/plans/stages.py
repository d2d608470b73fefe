"""The stages' jobs over tables seeded from the provided ones, with judges that are plain columns, so that SQL can follow them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import jobs, reduce
from tidemark.plans.registry import ASOF, query, table

_CHANGES = """c AS (SELECT o_custkey::VARCHAR AS accession_number, o_orderkey AS change_seq, CASE o_orderkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'dropped' ELSE 'changed' END AS kind, 'block ' || o_orderkey % 5 || ' of ' || o_custkey AS cur, 'block ' || (o_orderkey + 1) % 5 || ' of ' || o_custkey AS pri
FROM orders SEMI JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'),
t AS (SELECT *, CASE kind WHEN 'added' THEN 'NEWLY ADDED:' || chr(10) || cur WHEN 'dropped' THEN 'REMOVED (prior year):' || chr(10) || pri ELSE 'PRIOR YEAR:' || chr(10) || pri || chr(10) || chr(10) || 'THIS YEAR:' || chr(10) || cur END AS text FROM c)"""


@query(f"WITH {_CHANGES} SELECT accession_number, change_seq, contains(text, '7') AS is_material, 0.9::DOUBLE AS confidence, CASE WHEN contains(text, 'YEAR') THEN 'cyber' ELSE 'other' END AS category, CASE WHEN kind = 'dropped' THEN 'eased' ELSE 'neutral' END AS direction FROM t WHERE NOT contains(text, 'of 9')")
def job_judge_changes(spark, d):
    """Verdicts of changes without one: orders are changes, of which the finished ones have been judged; the judge fails for some texts."""
    known = table(spark, d, "customer").select("c_custkey")
    orders = table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_semi")  # by numbers, which take less memory than texts
    customers = known.select(F.col("c_custkey").cast("string").alias("accession_number"))
    own = orders.select(F.col("o_custkey").cast("string").alias("accession_number"), "o_orderkey", "o_orderstatus", F.lit("rf").alias("section"), F.lit("m").alias("model_id"), F.col("o_orderkey").alias("change_seq"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "added").when(F.col("o_orderkey") % 3 == 1, "dropped").otherwise("changed")
    changes = own.select(*jobs.CHANGE, kind.alias("change_type"), (F.col("o_orderkey") % 5).alias("current_block_index"), ((F.col("o_orderkey") + 1) % 5).alias("prior_block_index"), F.col("accession_number").alias("prior_accession_number"))
    blocks = customers.select("accession_number", F.lit("rf").alias("section"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("block_index")).withColumn("block_text", F.format_string("block %d of %s", "block_index", "accession_number"))
    judged = own.where("o_orderstatus = 'F'").select(*jobs.CHANGE, F.lit("j").alias("judge_version"))

    def judge(text):
        said = F.to_json(F.struct(F.contains(text, F.lit("7")).alias("is_material"), F.lit(0.9).alias("confidence"), F.when(F.contains(text, F.lit("YEAR")), "Cyber ").otherwise("unheard of").alias("category"), F.when(F.contains(text, F.lit("REMOVED")), "eased").otherwise("up").alias("direction")))
        return F.when(~F.contains(text, F.lit("of 9")), said)

    out = jobs.judge_gap(changes, blocks, judged, "j", judge, ("cyber", "other"), ASOF)
    return out.select("accession_number", "change_seq", "is_material", "confidence", "category", "direction")


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 'worse' ELSE 'eased' END AS direction, l_discount, '- [' || l_returnflag || ' | ' || CASE l_linestatus WHEN 'O' THEN 'worse' ELSE 'eased' END || '] line ' || l_linenumber AS line FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey % 4 <> 0),
    g AS (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY l_discount DESC, l_linenumber, line) AS thesis, count(*) AS material_count, count(*) FILTER (direction = 'worse') AS worse_count, count(*) FILTER (direction = 'eased') AS eased_count FROM v GROUP BY ALL)
    SELECT l_orderkey::VARCHAR AS accession_number, CASE WHEN contains(thesis, 'worse') THEN 'worsening' ELSE 'easing' END AS headline_direction, thesis, material_count, worse_count, eased_count, 0::BIGINT AS neutral_count FROM g"""
)
def job_synthesize(spark, d):
    """Syntheses of filings that have none: order lines are verdicts, returned ones not material; a quarter of the orders has a synthesis."""
    lines = table(spark, d, "lineitem")
    verdicts = lines.select(
        F.col("l_orderkey").cast("string").alias("accession_number"), F.lit("rf").alias("section"), F.lit("m").alias("model_id"), F.col("l_linenumber").alias("change_seq"), F.lit("j").alias("judge_version"), (F.col("l_returnflag") != "R").alias("is_material"),
        F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("category"), F.when(F.col("l_linestatus") == "O", "worse").otherwise("eased").alias("direction"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("explanation"),
    )
    done = lines.where("l_orderkey % 4 = 0").select(F.col("l_orderkey").cast("string").alias("accession_number"), F.lit("rf").alias("section"), F.lit("m").alias("model_id"), F.lit("s").alias("synthesis_version")).distinct()
    write = lambda text: F.to_json(F.struct(F.when(F.contains(text, F.lit("worse")), "worsening").otherwise("easing").alias("headline_direction"), text.alias("thesis")))
    out = jobs.synthesis_gap(verdicts, done, "j", "s", write, ASOF)
    return out.select("accession_number", "headline_direction", "thesis", "material_count", "worse_count", "eased_count", "neutral_count")


@query("SELECT c_custkey::VARCHAR AS accession_number, item AS item_number, CASE item WHEN '1.01' THEN 'ma_activity' ELSE 'exec_departure' END AS event_type, item = '1.01' AS is_material FROM customer, (VALUES ('1.01'), ('5.02')) t(item) WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 5 <> 0")
def job_classify_sections(spark, d):
    """Sections of filings without classifications: customers are filings, a fifth of them classified; the judge fails for one segment's second section, which holds its filing back."""
    c = table(spark, d, "customer").withColumn("accession_number", F.col("c_custkey").cast("string"))
    part = lambda number, text: F.struct(F.lit(number).alias("number"), text.alias("text"))
    filings = c.select(
        "accession_number", F.lit("8-K").alias("form"), F.col("c_name").alias("company_name"), F.col("accession_number").alias("cik"), F.lit(None).cast("string").alias("ticker"), F.lit("2024-01-02").alias("filing_date"), F.lit("body").alias("body_text"),
        F.array(part("1.01", F.lit("merger")), part("5.02", F.concat(F.lit("leaves "), "c_mktsegment")), part("9.01", F.lit("exhibits"))).alias("sections"), F.lit(None).cast("array<struct<exhibit_type:string,text:string>>").alias("exhibits"),
    )
    done = c.where("c_custkey % 5 = 0").select("accession_number", F.lit("v").alias("classifier_version"))
    judge = lambda text: F.when(~F.contains(text, F.lit("leaves BUILDING")), F.to_json(F.struct(F.when(F.contains(text, F.lit("merger")), "ma_activity").otherwise("exec_departure").alias("event_type"), F.contains(text, F.lit("merger")).alias("is_material"))))
    return jobs.classify_gap(filings, done, "v", judge, ("ma_activity", "exec_departure"), ASOF).select("accession_number", "item_number", "event_type", "is_material")


@query("SELECT p_partkey::VARCHAR AS accession_number, 2 AS dim, [length(p_name)::DOUBLE, p_size::DOUBLE] AS embedding FROM part WHERE p_partkey % 3 <> 0 AND p_name NOT LIKE '%a%b%'")
def job_embed_blocks(spark, d):
    """Vectors of blocks without one: parts are blocks, of which a third has a vector; the embedder fails for some."""
    p = table(spark, d, "part")
    blocks = p.select(F.col("p_partkey").cast("string").alias("accession_number"), F.lit("rf").alias("section"), F.lit(0).alias("block_index"), F.concat_ws("|", "p_name", F.col("p_size").cast("string")).alias("block_text"))
    done = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("accession_number"), F.lit("rf").alias("section"), F.lit(0).alias("block_index"), F.lit("m").alias("model_id"))
    name, size = lambda t: F.split_part(t, F.lit("|"), F.lit(1)), lambda t: F.split_part(t, F.lit("|"), F.lit(2))
    embed = lambda t: F.when(~name(t).like("%a%b%"), F.array(F.length(name(t)).cast("double"), size(t).cast("double")))
    return jobs.embed_gap(blocks, done, "m", embed, ASOF).select("accession_number", "dim", "embedding")


_LINES = "l AS (SELECT *, l_orderkey::VARCHAR AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem)"


def _lines(spark, d):
    """Order lines as changes, numbered in their order."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, d, "lineitem").select("*", F.col("l_orderkey").cast("string").alias("accession_number"), F.lit("rf").alias("section"), F.lit("m").alias("model_id"), number.alias("change_seq"))


@query(
    f"""WITH {_LINES}, m AS (SELECT * FROM l WHERE l_quantity > 10 AND (l_orderkey % 4 <> 0 OR l_linenumber > 5))
    SELECT a AS accession_number, seq AS change_seq, l_linenumber % 2 = 1 AS is_specific, CASE WHEN l_returnflag <> 'R' THEN lower(l_returnflag) END AS matched_theme, 1.0::DOUBLE AS confidence FROM m WHERE l_linenumber <> 7"""
)
def job_classify_specificity(spark, d):
    """Specificity of material changes without it: those of a quarter of the orders are classified up to the fifth line. The judge reads an order's numbered changes, leaves out some, gives
    a number that there isn't, and a theme that the catalog lacks."""
    lines = _lines(spark, d)
    verdicts = lines.select(*jobs.CHANGE, F.lit("j").alias("judge_version"), (F.col("l_quantity") > 10).alias("is_material"), F.col("l_returnflag").alias("category"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("explanation"))
    themes = lines.where("l_returnflag <> 'R'").select(F.lit("c1").alias("catalog_version"), F.lower("l_returnflag").alias("theme_slug")).distinct()
    done = lines.where("l_orderkey % 4 = 0 and l_linenumber <= 5").select(*jobs.CHANGE, F.lit("c1").alias("catalog_version"), F.lit("v").alias("specificity_version"))

    def judge(text):
        said = F.filter(F.split(text, "\n"), lambda x: ~x.endswith("line 7"))
        one = lambda x: F.struct(F.split_part(x, F.lit("."), F.lit(1)).alias("change_index"), F.regexp_like(x, F.lit("line [135]$")).alias("is_specific"), F.regexp_extract(x, r"\[(\w)\]", 1).alias("matched_theme"), F.lit(1.0).alias("confidence"))
        beyond = F.array(F.struct(F.lit("0").alias("change_index"), F.lit(True).alias("is_specific"), F.lit("a").alias("matched_theme"), F.lit(1.0).alias("confidence")))
        return F.to_json(F.struct(F.concat(beyond, F.transform(said, one)).alias("verdicts")))

    return jobs.specificity_gap(verdicts, done, themes, "j", "v", judge, ASOF).select("accession_number", "change_seq", "is_specific", "matched_theme", "confidence")


@query(
    """WITH k AS (SELECT c_custkey AS k, DATE '2024-01-01' + (c_custkey % 20)::INT AS filed FROM customer), e AS (SELECT user_id AS k, event_id::VARCHAR AS a, ts::DATE AS day, 'event ' || event_id || ' took its place' AS summary FROM events WHERE event_type = 'purchase'),
    n AS (SELECT k, max(day) AS newest FROM e GROUP BY k), t AS (SELECT k.k, filed FROM k JOIN n USING (k) WHERE newest > filed AND k.k % 5 <> 1 AND (k.k % 5 <> 0 OR newest > DATE '2024-01-20')),
    m AS (SELECT t.k, a, day, row_number() OVER (PARTITION BY t.k ORDER BY day, a) AS pos FROM t JOIN e ON e.k = t.k AND day > filed QUALIFY pos <= 6)
    SELECT k::VARCHAR AS accession_number, coalesce(k % 3 > 0 AND max(pos) >= 2, false) AS is_realized, CASE WHEN k % 3 > 0 THEN max(a) FILTER (pos = 2) END AS realizing_accession, CASE WHEN k % 3 > 0 AND max(pos) >= 2 THEN 'seen' ELSE '' END AS evidence, max(day) AS checked_through FROM m GROUP BY k"""
)
def job_track_realizations(spark, d):
    """Whether customers' risks came true in their later purchases: of a fifth it is known already, for another fifth it was denied on what came up to a day. The judge cites the second
    event, for a third of the risks with a quote that it doesn't hold."""
    key = F.col("c_custkey")
    own = table(spark, d, "customer").select(key.cast("string").alias("accession_number"), F.lit("rf").alias("section"), F.lit("m").alias("model_id"), F.lit(1).alias("change_seq"), key.alias("cik"), F.expr("date_add(date'2024-01-01', int(c_custkey % 20))").alias("filed_at"), F.when(key % 3 == 0, "of old").otherwise("of late").alias("risk_text"), F.lit("why").alias("explanation"))
    events = table(spark, d, "events").where("event_type = 'purchase'").select(
        F.col("user_id").alias("cik"), F.col("event_id").cast("string").alias("accession_number"), F.to_date("ts").alias("filing_date"), F.lit("bought").alias("event_type"), F.lit("").alias("item"), F.format_string("event %d took its place", "event_id").alias("summary"), F.lit("").alias("source_text")
    )
    done = own.where("cik % 5 < 2").select(*jobs.CHANGE, F.lit("r").alias("realization_version"), (F.col("cik") % 5 == 1).alias("is_realized"), F.lit("2024-01-20").cast("date").alias("checked_through"), F.lit(ASOF).cast("timestamp").alias("judged_at"))

    def judge(text):
        second = F.regexp_extract(text, r"\n2\. \[[^\]]*\] bought: ([^\n]*)", 1)
        quote = F.when(F.contains(text, F.lit("of old")), "what nobody ever said").otherwise(F.upper(second))
        return F.to_json(F.struct(F.lit(True).alias("is_realized"), F.lit(2).alias("event_index"), quote.alias("quote"), F.lit("seen").alias("evidence"), F.lit(0.9).alias("confidence")))

    return jobs.realization_gap(own, events, done, "j", "r", judge, ASOF, most_events=6).select("accession_number", "is_realized", "realizing_accession", "evidence", "checked_through")


@query(
    f"""WITH {_LINES}, o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS a FROM orders WHERE o_orderkey % 5 <> 0), q AS (SELECT * FROM o WHERE a NOT IN (SELECT a FROM l WHERE l_discount > 0.03 OR l_tax > 0.06)),
    b AS (SELECT a, string_agg('block ' || i || ' of ' || a, chr(10) || chr(10) ORDER BY i) AS t FROM q, (VALUES (0), (1), (2), (3)) v(i) GROUP BY a)
    SELECT a AS accession_number, 'stable' AS headline_direction, 'none' AS headline_intensity, left(t, 20) AS thesis, 0::BIGINT AS material_count, 'all' AS effects FROM b"""
)
def job_summarize_stable(spark, d):
    """What stands in compared orders whose lines are all judged and none material: dear ones are material, heavily taxed ones aren't judged; a fifth of the orders has a summary."""
    lines = _lines(spark, d)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("accession_number"), "o_orderkey", F.lit("rf").alias("section"), F.lit("m").alias("model_id"))
    verdicts = lines.where("l_tax <= 0.06").select(*jobs.CHANGE, F.lit("j").alias("judge_version"), (F.col("l_discount") > 0.03).alias("is_material"))
    blocks = orders.select("accession_number", "section", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block_index")).withColumn("block_text", F.format_string("block %d of %s", "block_index", "accession_number"))
    done = orders.where("o_orderkey % 5 = 0").select(*jobs.FILING, F.lit("s").alias("synthesis_version"))
    write = lambda text: F.to_json(F.struct(F.substring(text, 1, 20).alias("thesis"), F.array(F.lit("all"), F.lit(" ")).alias("top_effects")))
    out = jobs.stable_gap(orders, lines.select(*jobs.CHANGE), verdicts, blocks, done, "j", "s", write, ASOF)
    return out.select("accession_number", "headline_direction", "headline_intensity", "thesis", "material_count", F.array_join("top_effects", ",").alias("effects"))


@query("""WITH e AS (SELECT vec_id // 8 AS f, vec_id % 8 AS i, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings), whole AS (SELECT f FROM e GROUP BY f HAVING count(*) = 8),
    p AS (SELECT a.f, a.f - 10 AS g FROM whole a JOIN whole b ON b.f = a.f - 10 WHERE a.f % 6 <> 0), s AS (SELECT p.f, c.i AS ci, q.i AS pi, list_sum(list_transform(list_zip(c.v, q.v), lambda t: t[1] * t[2])) / (c.n * q.n) AS sim FROM p JOIN e c ON c.f = p.f JOIN e q ON q.f = p.g),
    bc AS (SELECT f, ci, max(sim) AS sim, arg_max(pi, (sim, -pi)) AS pi FROM s GROUP BY f, ci), bp AS (SELECT f, pi, max(sim) AS sim FROM s GROUP BY f, pi)
    SELECT f::VARCHAR AS accession_number, (f - 10)::VARCHAR AS prior_accession_number, CASE WHEN sim >= 0.97 THEN 'carried' WHEN sim >= 0.7 THEN 'changed' ELSE 'added' END AS change_type, ci AS current_index, CASE WHEN sim >= 0.7 THEN pi END AS prior_index, round(sim, 4) AS similarity FROM bc
    UNION ALL SELECT f::VARCHAR, (f - 10)::VARCHAR, 'dropped', NULL, pi, round(sim, 4) FROM bp WHERE sim < 0.7""")
def job_diff_filings(spark, d):
    """Changes between each filing and its prior: eight vectors are a filing's blocks, every tenth filing is of one company; a sixth is compared already, the last one lacks vectors if they don't come out even."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("f"), (F.col("vec_id") % 8).alias("block_index"), "embedding").withColumn("accession_number", F.col("f").cast("string"))
    own = e.select("f", "accession_number").distinct()
    filings = own.select("accession_number", (F.col("f") % 10).alias("cik"), F.lit("10-K").alias("form"), F.expr("date_add(date'1970-01-01', int(f))").alias("period_of_report"), F.lit(8).alias("block_count"))
    blocks = own.select("accession_number", F.lit("rf").alias("section"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("block_index"))
    vectors = e.select("accession_number", F.lit("rf").alias("section"), "block_index", F.lit("m").alias("model_id"), "embedding")
    done = own.where("f % 6 = 0").select("accession_number", F.lit("m").alias("model_id"))
    out = jobs.diff_gap(filings, blocks, vectors, done, "m")
    return out.select(F.col("pair").alias("accession_number"), "prior_accession_number", "change_type", "current_index", "prior_index", "similarity")


@query("""SELECT o_orderkey::VARCHAR AS accession_number, '1' AS anchor_item_number, item AS item_number, arg_max(id, (day, id)) AS classification_id FROM orders, (SELECT l_orderkey, l_linenumber::VARCHAR AS item, l_partkey AS id, l_shipdate AS day FROM lineitem) l
    WHERE l_orderkey = o_orderkey AND item IN ('1', '2', '3') GROUP BY o_orderkey, item""")
def event_links(spark, d):
    """An event an order, of items 1 to 3 and one that has no classification, linked to the latest classification of each."""
    events = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("accession_number"), F.lit("1").alias("anchor_item_number"), F.array(*[F.lit(x) for x in ("1", "2", "3", "9.99")]).alias("items"))
    classified = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("accession_number"), F.col("l_linenumber").cast("string").alias("item_number"), F.col("l_partkey").alias("id"), F.col("l_shipdate").alias("classified_at"))
    return jobs.with_links(events, classified).select("accession_number", "anchor_item_number", "item_number", "classification_id")


@query("""WITH x AS (SELECT page_id, unnest([html, 'no flag', repeat('a', 3000) || ' Going Concern and FRAUD']) AS t FROM pages)
    SELECT page_id::VARCHAR AS accession_number, count(*) AS exhibit_count, sum(length(t))::BIGINT AS total_chars, sum(least(length(t), 3000))::BIGINT AS used_chars, sum(greatest(0, length(t) - 3000))::BIGINT AS dropped_chars, true AS truncated,
    bool_or(contains(lower(substring(t, 3001)), 'fraud')) AS fraud, bool_or(contains(lower(substring(t, 3001)), 'chapter 11')) AS chapter FROM x GROUP BY page_id""")
def exhibit_truncation(spark, d):
    """What a cap of 3,000 characters an exhibit drops, and the red flags in it: each page and two made texts are a filing's exhibits."""
    made = F.concat(F.repeat(F.lit("a"), F.lit(3000)), F.lit(" Going Concern and FRAUD"))
    rows = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("accession_number"), F.transform(F.array("html", F.lit("no flag"), made), lambda t: F.struct(t.alias("text"))).alias("exhibits"))
    out = reduce.truncation(rows, 3000)
    flags = F.col("red_flags")
    return out.select("accession_number", F.col("exhibit_count").cast("long").alias("exhibit_count"), *[F.col(c).cast("long").alias(c) for c in ("total_chars", "used_chars", "dropped_chars")], "truncated", F.array_contains(flags, "fraud").alias("fraud"), F.array_contains(flags, "chapter 11").alias("chapter"))


@query("""WITH u AS (SELECT a.doc_id AS k, a.source, CASE a.doc_id % 3 WHEN 0 THEN 'other_material' ELSE a.lang END AS la, CASE b.quality WHEN 1 THEN 'other_material' ELSE a.lang END AS lb, a.n_chars > 500 AS ma, b.toxic = 1 AS mb, b.doc_id IS NOT NULL AS two FROM documents a LEFT JOIN labels b USING (doc_id))
    SELECT count(DISTINCT source) AS filings, count(*) FILTER (two) AS comparable_units, count(*) FILTER (two AND la <> lb) AS label_changed, round(100.0 * count(*) FILTER (two AND la <> lb) / count(*) FILTER (two), 2) AS label_changed_pct, count(*) FILTER (two AND ma <> mb) AS material_changed,
    count(*) FILTER (two AND la = 'other_material') AS other_a, count(*) FILTER (two AND lb = 'other_material') AS other_b, count(*) FILTER (two AND la = 'other_material') - count(*) FILTER (two AND lb = 'other_material') AS other_reduction FROM u""")
def ab_summary(spark, d):
    """Figures of two arms: documents and their labels where there are any."""
    docs = table(spark, d, "documents")
    own = F.when(F.col("doc_id") % 3 == 0, "other_material").otherwise(F.col("lang"))
    left = docs.select("doc_id", own.alias("label"), F.lit(0.0).alias("score"))
    right = table(spark, d, "labels").join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, "other_material").otherwise(F.col("lang")).alias("label"), F.lit(0.5).alias("score"))
    material = docs.select("doc_id", "source", (F.col("n_chars") > 500).alias("material_a")).join(table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("material_b")), "doc_id", "left")
    return reduce.compared_summary(reduce.compared(left, right, "doc_id", "label", "score").join(material, "doc_id"), "source").drop("mean_delta")
