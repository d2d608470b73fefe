"""Insider, operations, traffic and radar aggregates on the provided tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import net
from tidemark.functions.dates import business_days_between
from tidemark.operators import current, insider, ops, radar
from tidemark.plans.registry import ASOF, query, table
from tidemark.streaming import visits


def _trades(spark, d):
    """Events as trades: a purchase is a buy, an error a sale, the user the owner and user_id % 40 the issuer."""
    code = F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "error", "S").otherwise("M")
    return table(spark, d, "events").select(
        F.concat(F.lit("i"), (F.col("user_id") % 40).cast("string")).alias("issuer_cik"), F.lit("Issuer").alias("issuer_name"), F.when(F.col("user_id") % 2 == 0, "N/A").otherwise("TCK").alias("issuer_ticker"),
        F.col("user_id").alias("owner_cik"), code.alias("transaction_code"), F.date_format("ts", "yyyyMMdd").alias("transaction_date"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("transaction_value"),
        F.col("event_id").cast("string").alias("accession_number"), F.lit(1).alias("txn_seq"), (F.col("event_id") % 2 == 0).alias("is_officer"), F.when(F.col("event_id") % 4 == 0, "CEO").alias("officer_title"),
        (F.col("event_id") % 3 == 0).alias("is_director"), F.lit(False).alias("is_ten_percent_owner"), (F.col("event_id") % 5 == 0).alias("is_other"), "event_id",
    )


_PULSE = """SELECT 'i' || (user_id % 40) AS issuer_cik, round(coalesce(sum(v) FILTER (event_type = 'purchase'), 0), 2) AS buy_value, count(*) FILTER (event_type = 'purchase') AS buy_count, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buy_people,
round(coalesce(sum(v) FILTER (event_type = 'error'), 0), 2) AS sell_value, count(*) FILTER (event_type = 'error') AS sell_count, count(DISTINCT user_id) FILTER (event_type = 'error') AS sell_people, count(*) FILTER (event_type IN ('purchase', 'error')) > 0 AS has_activity
FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN value ELSE 0 END AS v FROM events) WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - {days} GROUP BY 1"""


def _pulse(spark, d, days):
    return insider.pulse(_trades(spark, d), F.lit("2024-01-31").cast("date"), days).withColumns({c: F.round(c, 2) for c in ("buy_value", "sell_value")})


@query(_PULSE.format(days=10))
def insider_pulse_10(spark, d):
    return _pulse(spark, d, 10)


@query(_PULSE.format(days=30))
def insider_pulse_30(spark, d):
    return _pulse(spark, d, 30)


@query("SELECT 'i' || (user_id % 40) AS issuer_cik, 'Issuer' AS issuer_name, max(CASE WHEN user_id % 2 = 0 THEN '' ELSE 'TCK' END) AS issuer_ticker, count(DISTINCT user_id) AS buyers, count(*) AS trades, round(sum(CASE WHEN event_id % 11 <> 0 THEN value ELSE 0 END), 2) AS value, min(CAST(ts AS DATE)) AS first_trade, max(CAST(ts AS DATE)) AS last_trade FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) >= DATE '2024-01-11' GROUP BY 1 HAVING count(DISTINCT user_id) >= 2 AND sum(CASE WHEN event_id % 11 <> 0 THEN value ELSE 0 END) >= 800")
def cluster_buys(spark, d):
    return insider.clusters(_trades(spark, d), F.lit("2024-01-31").cast("date"), 20, 800.0).withColumn("value", F.round("value", 2))


@query("SELECT issuer_cik, event_id, role FROM (SELECT 'i' || (user_id % 40) AS issuer_cik, event_id, CASE WHEN event_id % 4 = 0 THEN 'CEO' WHEN event_id % 2 = 0 THEN 'Officer' WHEN event_id % 3 = 0 THEN 'Director' WHEN event_id % 5 = 0 THEN 'Other' ELSE '' END AS role, row_number() OVER (PARTITION BY user_id % 40 ORDER BY CAST(ts AS DATE) DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM events) WHERE rn <= 20")
def recent_trades_role(spark, d):
    return insider.recent_trades(_trades(spark, d), 20).select("issuer_cik", "event_id", "role")


def _buckets(unit, n):
    return f"SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, count(event_id) AS calls, round(coalesce(sum(value), 0), 2) AS total FROM (SELECT unnest(range(date_trunc('{unit}', TIMESTAMP '{ASOF}') - INTERVAL {n - 1} {unit}, date_trunc('{unit}', TIMESTAMP '{ASOF}') + INTERVAL 1 {unit}, INTERVAL 1 {unit})) AS b) LEFT JOIN events ON date_trunc('{unit}', ts) = b GROUP BY b"


def _padded(spark, d, unit, n):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ops.padded_buckets(rows, "ts", "value", unit, ASOF, n).select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "calls", F.round("total", 2).alias("total"))


@query(_buckets("hour", 24))
def hourly_buckets_padded(spark, d):
    return _padded(spark, d, "hour", 24)


@query(_buckets("day", 30))
def daily_buckets_padded(spark, d):
    return _padded(spark, d, "day", 30)


@query(f"SELECT count(*) AS calls, round(coalesce(sum(value), 0), 2) AS total FROM events WHERE ts > TIMESTAMP '{ASOF}' - INTERVAL 72 HOUR AND ts <= TIMESTAMP '{ASOF}'")
def trailing_spend(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ops.trailing(rows, "ts", "value", ASOF, 72).withColumn("total", F.round("total", 2))


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY event_type")
def freshness_argmax(spark, d):
    return ops.freshest(table(spark, d, "events"), "event_type", "ts", "event_id").withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS calls, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax FROM lineitem GROUP BY 1")
def day_token_totals(spark, d):
    four = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return ops.day_totals(table(spark, d, "lineitem"), "l_shipdate", *four).withColumns({c: F.round(c, 2) for c in four})


@query("""SELECT doc_id, round((greatest(0, n_chars - n_chars // 4 - n_chars // 8) * i + (n_chars // 8) * i * 1.25 + (n_chars // 4) * i * 0.10 + 10 * o) / 1e6, 9) AS usd, doc_id % 5 > 2 AS unknown
FROM (SELECT doc_id, n_chars, CASE doc_id % 5 WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 ELSE 15.0 END::DOUBLE AS i, CASE doc_id % 5 WHEN 1 THEN 15.0 WHEN 2 THEN 5.0 ELSE 75.0 END::DOUBLE AS o FROM documents)""")
def cost_estimate(spark, d):
    k = F.col("doc_id") % 5
    model = F.when(k == 0, "claude-opus-4-7").when(k == 1, "claude-sonnet-4-6").when(k == 2, "claude-haiku-4-5-20251001").when(k == 3, "else")
    usd, unknown = ops.cost(model, F.col("n_chars"), F.lit(10), F.expr("n_chars div 4"), F.expr("n_chars div 8"))
    return table(spark, d, "documents").select("doc_id", F.round(usd, 9).alias("usd"), unknown.alias("unknown"))


_KIND = "CASE WHEN regexp_matches(lower(p.url), 'bot|crawl|spider|slurp|bingpreview|facebookexternalhit|embedly|quora link preview|pingdom|uptimerobot|statuscake|yandex|ahrefs|semrush') THEN 'crawler' WHEN regexp_matches(lower(p.url), 'curl|wget|python-requests|python-urllib|go-http-client|httpx|okhttp|java/|libwww|postman|insomnia|axios|node-fetch|scrapy|headless|phantomjs|puppeteer|playwright|restsharp') OR page_id % 7 = 0 THEN 'automated' WHEN regexp_matches(lower(p.url), 'mozilla|applewebkit|gecko') THEN 'human' ELSE 'automated' END"
_AGENT = "(SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Mozilla/5.0 ' || url WHEN 1 THEN 'GoogleBot ' || url WHEN 2 THEN 'curl/8 ' || url ELSE url END AS url FROM pages) p"


def _agents(spark, d):
    k, url = F.col("page_id") % 4, F.col("url")
    agent = F.when(k == 0, F.concat(F.lit("Mozilla/5.0 "), url)).when(k == 1, F.concat(F.lit("GoogleBot "), url)).when(k == 2, F.concat(F.lit("curl/8 "), url)).otherwise(url)
    return table(spark, d, "pages").withColumn("client_kind", net.client_kind(agent, F.col("page_id") % 7 == 0))


@query(f"SELECT page_id, {_KIND} AS client_kind FROM {_AGENT}")
def client_kind(spark, d):
    return _agents(spark, d).select("page_id", "client_kind")


@query(f"""SELECT count(*) AS views, count(*) FILTER (day) AS views_day, count(*) FILTER (week) AS views_week, count(*) FILTER (week AND person) AS human_week, count(*) FILTER (week AND NOT person) AS other_week, count(DISTINCT who) FILTER (day AND person) AS visitors_day, count(DISTINCT who) FILTER (week AND person) AS visitors_week
FROM (SELECT ts > TIMESTAMP '2024-01-30' - INTERVAL 1 DAY AS day, ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AS week, event_type IN ('view', 'click') AS person, CAST(user_id AS VARCHAR) AS who FROM events WHERE ts <= TIMESTAMP '2024-01-30')""")
def page_view_stats(spark, d):
    views = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("viewed_at"), F.when(F.col("event_type").isin("view", "click"), "human").otherwise("automated").alias("client_kind"), F.col("user_id").cast("string").alias("visitor_day_hash"))
    return ops.view_summary(views, "2024-01-30 00:00:00")


@query("SELECT path, count(*) AS views FROM (SELECT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages) GROUP BY path ORDER BY views DESC, path LIMIT 10")
def top_paths(spark, d):
    """The ten most frequent, the feature itself."""
    return ops.top(table(spark, d, "pages").select(net.url_path(F.col("url")).alias("path")), "path", 10)


@query("SELECT host, count(*) AS views FROM (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) GROUP BY host ORDER BY views DESC, host LIMIT 10")
def top_companies(spark, d):
    return ops.top(table(spark, d, "pages").select(net.url_host(F.col("url")).alias("host")), "host", 10)


@query("SELECT user_id, (ip BETWEEN 167772160 AND 167772287) OR (ip BETWEEN 167837696 AND 167903231) AS datacenter FROM (SELECT DISTINCT user_id, 167772160 + (user_id * 7919) % 200000 AS ip FROM events)")
def cidr_membership(spark, d):
    number = F.lit(167772160) + (F.col("user_id") * 7919) % 200000
    rows = table(spark, d, "events").select("user_id", number.alias("n")).distinct()
    return net.in_ranges(rows, "n", net.ranges(["10.0.0.0/26", "10.0.0.64/26", "10.1.0.0/16"]), "datacenter").select("user_id", "datacenter")


@query("SELECT DISTINCT user_id, substring(sha256('salt|' || strftime(ts, '%Y-%m-%d') || '|' || user_id || '|' || event_type), 1, 16) AS visitor FROM events")
def visitor_day_hash(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", net.visitor_day(F.col("user_id").cast("string"), F.col("event_type"), F.col("ts"), "salt").alias("visitor")).distinct()


def _flagged(spark, d):
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("is_specific"))
    return radar.with_flags(table(spark, d, "documents"), labels, ["doc_id"])


@query("SELECT d.doc_id, coalesce(f.s, false) AS has_specific, f.doc_id IS NOT NULL AS ever_classified FROM documents d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS s FROM labels GROUP BY doc_id) f ON f.doc_id = d.doc_id WHERE d.lang <> 'stable' AND (coalesce(f.s, false) OR f.doc_id IS NULL)")
def radar_feed_flags(spark, d):
    return _flagged(spark, d).where(radar.in_feed(F.col("lang"))).select("doc_id", "has_specific", "ever_classified")


@query("SELECT count(DISTINCT source) AS companies, count(DISTINCT source) FILTER (quality = 1) AS with_specific, count(DISTINCT source) FILTER (quality IS NOT NULL) AS classified FROM documents LEFT JOIN labels USING (doc_id)")
def radar_coverage(spark, d):
    return radar.coverage(_flagged(spark, d), "source")


@query("SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY rn) AS captions FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 2 GROUP BY l_orderkey")
def top2_captions(spark, d):
    lines = table(spark, d, "lineitem").withColumn("part", F.col("l_partkey").cast("string"))
    return radar.captions(lines, "l_orderkey", "part", 2, F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_linenumber")).withColumn("captions", F.array_join("captions", ","))


_BUCKET = "CASE WHEN quality IS NULL THEN 'unclassified' WHEN quality = 1 AND (lang = 'fr' OR source = 'src1') THEN 'eased' WHEN quality = 1 THEN 'specific' ELSE 'common_mode' END"


def _bucketed(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    direction, kind = F.when(F.col("lang") == "fr", "eased").otherwise("worse"), F.when(F.col("source") == "src1", "dropped").otherwise("changed")
    return rows.withColumn("bucket", radar.bucket(F.col("quality") == 1, direction, kind))


@query(f"SELECT doc_id, {_BUCKET} AS bucket FROM documents LEFT JOIN labels USING (doc_id)")
def bucket_changes(spark, d):
    return _bucketed(spark, d).select("doc_id", "bucket")


@query("SELECT source AS theme, count(*) AS n, min(doc_id) AS first_at FROM documents GROUP BY source")
def theme_tally(spark, d):
    return radar.themes(table(spark, d, "documents").withColumnRenamed("source", "theme"), "theme", "doc_id")


@query("SELECT l_orderkey, count(*) AS material_count, count(*) FILTER (l_returnflag = 'R') AS worse_count, count(*) FILTER (l_returnflag = 'A') AS eased_count, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS neutral_count FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey")
def synthesis_counts(spark, d):
    direction = F.when(F.col("l_returnflag") == "R", "worse").when(F.col("l_returnflag") == "A", "eased").otherwise("neutral")
    verdicts = table(spark, d, "lineitem").select("l_orderkey", direction.alias("direction"), (F.col("l_quantity") > 10).alias("is_material"))
    return radar.synthesis_counts(verdicts, ["l_orderkey"])


@query("SELECT o_orderkey, o_orderdate::DATE AS ordered, l_shipdate::DATE AS shipped, (SELECT count(*) FROM (SELECT unnest(range(o_orderdate::DATE + 1, l_shipdate::DATE, INTERVAL 1 DAY)) AS x) WHERE isodow(x) < 6) AS days FROM (SELECT o_orderkey, o_orderdate, min(l_shipdate) AS l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE o_orderkey % 1 = 0")
def business_days_lag(spark, d):
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("shipped"))
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered")).join(first, "o_orderkey")
    return rows.withColumn("days", business_days_between(F.col("ordered"), F.col("shipped")))


@query("SELECT day, calls, round(CASE WHEN calls = 0 THEN 0 ELSE greatest(2, calls * 100.0 / max(calls) OVER ()) END, 4) AS height FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY 1)")
def bar_heights(spark, d):
    return ops.bar_heights(ops.day_totals(table(spark, d, "events"), "ts"), "calls", "day").withColumn("height", F.round("height", 4))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def top_n_per_key(spark, d):
    return current.first_n(table(spark, d, "events"), ["user_id"], 3, F.desc("value"), F.col("event_id")).select("user_id", "event_id")


@query("""WITH r AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN '/' WHEN 'click' THEN '/companies/' || user_id WHEN 'purchase' THEN '/ops/' ELSE '/filings/x' END AS path, CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || user_id % 256 WHEN event_id % 5 = 0 THEN '' ELSE '10.1.0.5' END AS ip,
    CASE event_id % 4 WHEN 0 THEN 'Mozilla/5.0' WHEN 1 THEN 'Googlebot' WHEN 2 THEN 'curl/8' ELSE '' END AS agent, event_id % 2 = 0 AND user_id % 256 BETWEEN 64 AND 127 AS dc FROM events WHERE event_id % 10 <> 0 AND event_type <> 'purchase')
    SELECT path, CASE WHEN event_id % 3 = 1 THEN 'Host.example:8080' ELSE '' END AS referrer_host, CASE WHEN agent = 'Googlebot' THEN 'crawler' WHEN agent = 'Mozilla/5.0' AND NOT dc THEN 'human' ELSE 'automated' END AS client_kind,
    CASE ip WHEN '' THEN '' ELSE substring(sha256('salt|' || strftime(ts, '%Y-%m-%d') || '|' || ip || '|' || agent), 1, 16) END AS visitor_day_hash, date_trunc('second', ts) AS viewed_at FROM r""")
def page_view_log(spark, d):
    """Events as requests: other methods and pages that don't count are left out, addresses come from the proxy or the peer."""
    k, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    requests = table(spark, d, "events").select(
        F.when(k % 10 == 0, "POST").otherwise("GET").alias("method"), F.when(kind == "view", "/").when(kind == "click", F.concat(F.lit("/companies/"), u.cast("string"))).when(kind == "purchase", "/ops/").otherwise("/filings/x").alias("path"),
        F.when(k % 3 == 1, "https://u:p@Host.example:8080/a?b=c").when(k % 3 == 2, "not a url").alias("referrer"), F.when(k % 2 == 0, F.format_string(" 10.0.0.%d , 9.9.9.9", u % 256)).otherwise("").alias("forwarded"),
        F.when(k % 5 != 0, "10.1.0.5:443").alias("remote"), F.when(k % 4 == 0, "Mozilla/5.0").when(k % 4 == 1, "Googlebot").when(k % 4 == 2, "curl/8").alias("agent"), F.col("ts").cast("timestamp").alias("at"),
    )
    return visits.viewed(requests, ["10.0.0.64/26"], "salt")


_NULLABLE = "(SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS p FROM orders)"


@query(f"""SELECT o_custkey, o_orderkey, r, s FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p ASC NULLS FIRST, o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC NULLS LAST, o_orderkey) AS s FROM {_NULLABLE}) WHERE r <= 2 OR s <= 2""")
def null_order(spark, d):
    """Nulls are smaller than any value: first when rising, last when falling."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("p"))
    ranks = {"r": (F.asc("p"), F.col("o_orderkey")), "s": (F.desc("p"), F.col("o_orderkey"))}
    return rows.withColumns({name: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)) for name, order in ranks.items()}).where("r <= 2 or s <= 2").select("o_custkey", "o_orderkey", "r", "s")
