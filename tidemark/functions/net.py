"""Page views: client kinds, addresses, hosts."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of user agents, in lower case.
CRAWLERS = ("bot", "crawl", "spider", "slurp", "bingpreview", "facebookexternalhit", "embedly", "quora link preview", "pingdom", "uptimerobot", "statuscake", "googlebot", "bingbot", "duckduckbot", "yandex", "baiduspider", "ahrefs", "semrush")
TOOLS = ("curl", "wget", "python-requests", "python-urllib", "go-http-client", "httpx", "okhttp", "java/", "libwww", "postman", "insomnia", "axios", "node-fetch", "scrapy", "headless", "phantomjs", "puppeteer", "playwright", "restsharp")
BROWSERS = ("mozilla", "applewebkit", "gecko")


def client_kind(agent: Column, datacenter: Column, crawlers=CRAWLERS, tools=TOOLS) -> Column:
    """human, crawler or automated. An agent without text is automated; then crawlers that say so, tools, addresses of data centres and browsers come in this order."""
    a = F.lower(F.trim(F.coalesce(agent, F.lit(""))))
    has = lambda marks: a.rlike("|".join(re.escape(m) for m in marks))  # noqa: E731  one pass over the agent
    return F.when(a == "", "automated").when(has(crawlers), "crawler").when(has(tools) | F.coalesce(datacenter, F.lit(False)), "automated").when(has(BROWSERS), "human").otherwise("automated")


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long")
    value = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    return F.when(F.regexp_like(ip, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")), value)


def ranges(blocks: list[str]) -> list[tuple[int, int]]:
    """First and last number of each CIDR block, merged where they overlap."""
    out: list[list[int]] = []
    for lo, hi in sorted((int(n.network_address), int(n.broadcast_address)) for n in map(ipaddress.ip_network, blocks)):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def in_ranges(rows: DataFrame, number: str, table: list[tuple[int, int]], name: str) -> DataFrame:
    """Adds whether a number lies in one of the ranges (a parameter, merged and sorted); false for null.

    The ranges don't overlap, so a number lies in at most one: the ranges go by the 65536-wide buckets that they touch, and within a bucket as one list, which is
    looked up by one left join. Its rows come from the parameter, whose size Spark knows.
    """
    spark, buckets = rows.sparkSession, {}
    for lo, hi in table:
        for b in range(lo >> 16, (hi >> 16) + 1):
            buckets.setdefault(b, []).append((lo, hi))
    r = spark.createDataFrame(list(buckets.items()), "_b long, _r array<struct<lo: long, hi: long>>")
    out = rows.withColumn("_n", F.expr(f"{number} div 65536")).join(r, F.col("_n") == F.col("_b"), "left")
    hit = F.exists("_r", lambda x: F.col(number).between(x["lo"], x["hi"]))
    return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_n", "_b", "_r")


def first_hop(forwarded: Column) -> Column:
    return F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1)))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def visitor_day(ip: Column, agent: Column, day: Column, salt: str) -> Column:
    """Eight bytes in hex that tell visitors of one day apart; empty, and so not counted, without an address."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    who = F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.date_format(day, "yyyy-MM-dd"), empty(ip), empty(agent)), 256), 1, 16)
    return F.when(empty(ip) == "", "").otherwise(who)


def referrer_host(referrer: Column) -> Column:
    """The host (and port) of a referrer alone, as written; empty without one."""
    return F.regexp_extract(F.coalesce(referrer, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def client_address(forwarded: Column, remote: Column) -> Column:
    """The first hop that a proxy names, else the peer's address without its port."""
    peer = F.regexp_replace(F.regexp_replace(F.coalesce(remote, F.lit("")), r":\d+$", ""), r"^\[|\]$", "")
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first_hop(forwarded)).otherwise(peer)


def is_tracked(path: Column, exact: tuple[str, ...] = ("/", "/filings", "/radar", "/insiders", "/live"), below: tuple[str, ...] = ("/companies/", "/filings/")) -> Column:
    """Whether views of a page are counted: the pages named and those below the others named."""
    found = path.isin(*exact)
    for start in below:
        found = found | path.startswith(start)
    return F.coalesce(found, F.lit(False))
