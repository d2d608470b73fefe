"""Current views, feeds, gaps, joins and upserts on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import alerts, current, gap, periods
from tidemark.plans.registry import ASOF, query, table


def _runs(spark, d):
    return current.latest_run(table(spark, d, "events").withColumn("run_id", F.to_date("ts")), "user_id")


_RUN = "WITH r AS (SELECT user_id, max(CAST(ts AS DATE)) AS run_id FROM events GROUP BY user_id), v AS (SELECT e.*, r.run_id FROM events e JOIN r ON e.user_id = r.user_id AND CAST(e.ts AS DATE) = r.run_id)"


@query(f"{_RUN} SELECT event_id, user_id, c_name, run_id, value FROM v JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'")
def material_feed_latest_run(spark, d):
    """Flagship: rows of each user's newest run that are material, with the name of the customer."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return _runs(spark, d).where("event_type = 'purchase'").join(names, "user_id").select("event_id", "user_id", "c_name", "run_id", "value")


@query(f"{_RUN} SELECT event_type, count(*) AS n FROM v GROUP BY event_type")
def label_counts_latest_run(spark, d):
    return _runs(spark, d).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_per_key_row_number(spark, d):
    return current.latest_one(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rk FROM orders) WHERE rk = 1")
def latest_all_ties(spark, d):
    return current.latest_all(table(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_one_tiebreak(spark, d):
    return current.latest_one(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def paged_feed(spark, d):
    """A page of 50, the feature itself."""
    rows = current.page(table(spark, d, "orders"), 50, 50, F.desc("o_orderdate"), F.col("o_orderkey"))
    return rows.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT (SELECT count(*) FROM orders) AS unfiltered, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS filtered")
def optional_filter_feed(spark, d):
    o = table(spark, d, "orders")
    counts = [current.optional(o, "o_orderstatus", v).agg(F.count("*").alias(name)) for v, name in (("", "unfiltered"), ("F", "filtered"))]
    return counts[0].join(F.broadcast(counts[1]))  # one row each


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) FILTER (l_linenumber IS NOT NULL), '') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def events_nested_items(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("a"))
    text = F.array_join(F.transform("a", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_returnflag"])), ",")
    return table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce(text, F.lit("")).alias("items"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)")
def gap_unprocessed(spark, d):
    return gap.gap(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"], toxic=0).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def seen_subset(spark, d):
    return gap.seen(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > 1000 AND o_orderdate < TIMESTAMP '2001-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
def orphans_with_limits(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 1000 and o_orderdate < timestamp_ntz'2001-01-01 00:00:00'")
    return gap.gap(orders, table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders o WHERE o_orderkey NOT IN (SELECT doc_id FROM labels) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_linestatus <> 'F') AND EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate)")
def ready_for_diff(spark, d):
    """Not done yet, complete, and with an earlier period: the last by each key's earliest date, not by a range join."""
    orders = table(spark, d, "orders")
    todo = gap.gap(orders, table(spark, d, "labels").withColumnRenamed("doc_id", "o_orderkey"), ["o_orderkey"])
    whole = gap.universally(todo, table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", F.col("l_linestatus") == "F")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return whole.join(first, "o_custkey").where("first < o_orderdate").select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_linestatus <> 'F')")
def universal_judged(spark, d):
    return gap.universally(table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", F.col("l_linestatus") == "F").select("o_orderkey")


@query("SELECT o.o_orderkey, (SELECT arg_max(p.o_orderkey, (p.o_orderdate, p.o_orderkey)) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS prior FROM orders o")
def prior_period_asof(spark, d):
    return periods.with_prior(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "prior")


@query("SELECT anchor, event_id, position FROM (SELECT a.event_id AS anchor, e.event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY e.ts, e.event_id) AS position FROM events a JOIN events e ON a.user_id = e.user_id AND e.ts > a.ts WHERE a.event_type = 'error') WHERE position <= 20")
def subsequent_events_topn(spark, d):
    e = table(spark, d, "events")
    anchors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("anchor"), F.col("ts").alias("since"))
    return periods.following(anchors, e, "user_id", "anchor", "since", "ts", 20, "ts", "event_id").select("anchor", "event_id", F.col("position").cast("long").alias("position"))


@query("SELECT c_custkey, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event FROM customer JOIN events ON user_id = c_custkey GROUP BY c_custkey HAVING max(ts) > TIMESTAMP '2024-01-29 12:00:00'")
def reopen_watermark(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "c_custkey")
    rows = periods.newer_than(table(spark, d, "customer"), e, "c_custkey", "ts", F.lit("2024-01-29 12:00:00").cast("timestamp_ntz"))
    return rows.select("c_custkey", F.date_format("last_event", "yyyy-MM-dd HH:mm:ss").alias("last_event"))


@query("SELECT key, name, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank) AS rn FROM (SELECT c_custkey AS key, c_name AS name, 1 AS source_rank FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier UNION ALL SELECT n_nationkey, n_name, 3 FROM nation) WHERE key IN (SELECT DISTINCT user_id FROM events)) WHERE rn = 1")
def identity_fallback(spark, d):
    keys = table(spark, d, "events").select(F.col("user_id").alias("key"))
    pick = lambda t, k, n: t.select(F.col(k).cast("long").alias("key"), F.col(n).alias("name"))
    sources = [pick(table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey", "c_name"), pick(table(spark, d, "supplier"), "s_suppkey", "s_name"), pick(table(spark, d, "nation"), "n_nationkey", "n_name")]
    return current.ranked_sources(keys, "key", sources)


@query("SELECT e.user_id, coalesce(c.c_name, 'order ' || max(o.o_orderkey)) AS found FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_mktsegment = 'BUILDING' LEFT JOIN orders o ON o.o_custkey = e.user_id GROUP BY e.user_id, c.c_name HAVING coalesce(c.c_name, 'order ' || max(o.o_orderkey)) IS NOT NULL")
def ticker_fallback(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    names = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), "c_name")
    newest = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderkey").alias("k"))
    found = F.coalesce("c_name", F.concat(F.lit("order "), F.col("k").cast("string")))
    return users.join(names, "user_id", "left").join(newest, "user_id", "left").select("user_id", found.alias("found")).where("found is not null")


@query("SELECT n_nationkey, n_regionkey FROM nation")
def backfill_nulls(spark, d):
    n = table(spark, d, "nation")
    holes = n.select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("n_regionkey"))
    return gap.fill_nulls(holes, n, "n_nationkey", "n_regionkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'new' WHEN o_orderkey % 3 = 0 THEN 'old' END AS note, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS version FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def preserve_nonnull_upsert(spark, d):
    """Two batches of orders; a null note of the second doesn't overwrite the first's."""
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("old").alias("note"), F.lit(1).alias("version"))
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, "new").alias("note"), F.lit(2).alias("version"))
    return gap.upsert_keeping(old, new, ["o_orderkey"], ["note"])


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 2) DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def upsert_last_wins(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return gap.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1) ON o_custkey = c_custkey")
def append_if_absent(spark, d):
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey"))
    new = gap.append_new(known, table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    return table(spark, d, "customer").join(new, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done FROM orders WHERE o_custkey % 2 = 1 OR o_orderstatus = 'F' GROUP BY o_custkey")
def replace_partition(spark, d):
    """Groups of the batch (even customers' finished orders) take the place of those customers' orders; others stay whole."""
    o = table(spark, d, "orders")
    batch = o.where("o_custkey % 2 = 0 and o_orderstatus = 'F'")
    gone = o.join(batch.select("o_custkey").distinct(), "o_custkey", "left_semi").unionByName(o.where("o_custkey % 2 = 1"))
    return gap.replace_groups(gone, batch, ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


def _outbox(spark, d):
    e = table(spark, d, "events").where("event_type in ('error', 'signup')")
    severity = F.when(F.col("event_type") == "error", "critical").otherwise("info")
    done = F.when(F.col("event_id") % 5 == 0, F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), severity.alias("severity"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"))).alias("dedup_key"), done.alias("delivered_at"))


@query(f"""
WITH b AS (SELECT event_id AS id, ts AS created_at, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'info' END AS severity, CASE WHEN event_id % 7 <> 0 THEN 'u' || (user_id % 50) END AS dedup_key, CASE WHEN event_id % 5 = 0 THEN ts END AS delivered_at FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT *, severity = 'info' AND created_at < TIMESTAMP '{ASOF}' - INTERVAL 4 DAY AS stale FROM b WHERE delivered_at IS NULL),
n AS (SELECT *, CASE WHEN NOT stale AND dedup_key IS NOT NULL THEN row_number() OVER (PARTITION BY dedup_key, stale ORDER BY created_at, id) ELSE 1 END AS n FROM s)
SELECT id, severity, dedup_key, CASE WHEN stale THEN 'expired' WHEN n > 1 OR dedup_key IN (SELECT dedup_key FROM b WHERE dedup_key IS NOT NULL AND delivered_at > TIMESTAMP '{ASOF}' - INTERVAL 48 HOUR) THEN 'repeat' ELSE 'deliver' END AS outcome FROM n
""")
def alert_drain(spark, d):
    return alerts.drain(_outbox(spark, d), ASOF, ttl_minutes=4 * 24 * 60, repeat_hours=48)


@query("SELECT attempts, count(*) AS n FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 >= 3 THEN 'abandoned' ELSE 'retry' END AS attempts FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) GROUP BY attempts")
def orphan_abandon(spark, d):
    orphans = gap.gap(table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])
    state = F.when(F.col("o_orderkey") % 4 >= 3, "abandoned").otherwise("retry")
    return orphans.groupBy(state.alias("attempts")).agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS filed_at, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def high_water_mark(spark, d):
    top = table(spark, d, "events").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return top.select(F.date_format("m.ts", "yyyy-MM-dd HH:mm:ss").alias("filed_at"), "m.event_id")
