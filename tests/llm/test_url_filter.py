import math

import duckdb
from pyspark.sql import functions as F
from tidemark.llm import queries, url_filter as u
from against_sql import DATA

ODD = [None, "", "no scheme/a", "http://", "HTTP://COM/en/x?y#z", "https://A.B.Example.com/en/7?q", "http://xcom/en/", "http://a.net/de/", "http://sub.example.net/de/81#f", "http://ORG/es/1", "http://org?es/", "a://b://c.com/en/", "http://com/EN/", "http://e.com\n/en/", "http://ä.com/en/ü"]


def split(url):
    """Host and path by the contract, without patterns."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end], rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(r, v) for r, v in u.RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_hosts_paths_and_rules_by_plain_code(spark):
    rows = [(i, x, "clash") for i, x in enumerate(ODD)] + [(3, "http://", "clash"), (None, "http://com/en/", "clash")]
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string, suffix string")).collect()
    assert len(got) == len(rows)
    for r, (_, url, _) in zip(sorted(got, key=lambda r: (r["page_id"] is None, r["page_id"])), sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        host, path = split(url)
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ({verdict} if verdict else {"allow", "block"})
    assert u.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_verdicts_by_the_contracts_list(spark):
    """Every rule of the contract, on its host and on a subdomain, with the word that the contract gives."""
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    rows = [(i, f"http://{sub}{rule}0") for i, (sub, rule) in enumerate((s, r) for r in contract for s in ("", "a.b."))]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in u.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {i: (rule, contract[rule]) for i, rule in enumerate(r for r in contract for _ in range(2))}


def test_query_against_sql_on_all_pages(spark):
    """Host, path, rule and the rule's verdict of every page by DuckDB."""
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in queries.op6_url_filter(spark, DATA).collect())
    con = duckdb.connect()
    pages = con.execute(f"SELECT page_id, url FROM read_parquet('{DATA}/pages.parquet')").fetchall()
    assert got == sorted((i, *split(x), *rule_of(*split(x))) for i, x in pages)


def test_features_by_plain_code(spark):
    urls = [x for x in ODD if x] + ["https://ab-cd.e1.example.org/a/b/c?x=1&y=2#t"]
    df = spark.createDataFrame([(x, *split(x)) for x in urls], "url string, host string, path string")
    for r in u.lexical(df).collect():
        x, h, p = r["url"], r["host"], r["path"]
        bits = -sum(x.count(c) / len(x) * math.log2(x.count(c) / len(x)) for c in set(x))
        query = x.partition("?")[2].partition("#")[0] if "?" in x else ""
        want = (len(x), len(h), len(p), p.count("/"), len(h.split(".")), sum(c in "0123456789" for c in x) / len(x), h.count("-"), len(query.split("&")) if query else 0, "#" in x)
        assert (r["url_length"], r["host_length"], r["path_length"], r["depth"], r["labels"], r["digit_ratio"], r["hyphens"], r["n_params"], r["has_fragment"]) == want
        assert abs(r["entropy"] - bits) < 1e-9


def test_held_out_hosts_urls(spark):
    """Trees trained on four fifths of the labelled URLs tell those of the last fifth apart."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    urls = pages.select("url").distinct().withColumns({"host": u.host_of(F.col("url")), "path": u.path_of(F.col("url"))}).withColumn("held", F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    model, rates = u.train(urls.where("not held"), u.listed(F.col("host")))
    rows = VectorAssembler(inputCols=list(u.FEATURES), outputCol="features").transform(u.with_rate(u.lexical(urls.where("held")), rates))
    got = [(r["s"], r["y"]) for r in model.transform(rows).select(vector_to_array("probability")[1].alias("s"), u.listed(F.col("host")).alias("y")).collect()]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in got for b, z in got if y and not z]
    assert pairs and sum(pairs) / len(pairs) > 0.95
