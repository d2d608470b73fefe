"""URL filter: rules first, then gradient-boosted trees on lexical features, trained from labelled URLs."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict), each rule being a host followed by the start of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Hosts whose URLs are labelled 1 for training, with those below them; other URLs are labelled 0.
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.org", "ads-track.example.org", "free-bets.example.com")
#: Most URLs that training reads; the smallest by hash are taken.
MAX_TRAIN_URLS = 20_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "n_params", "has_fragment", "vowel_ratio", "suffix_rate")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest comes to stand outermost
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def share(text: Column, pattern: str) -> Column:
    """Share of a text's characters that the pattern keeps."""
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def entropy(text: Column) -> Column:
    """Bits per character."""
    n, chars = F.length(text), F.filter(F.split(text, ""), lambda c: c != "")
    share_of = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.coalesce(-F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + share_of(c) * F.log2(share_of(c))), F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features (but the suffix's) to columns url, host, path."""
    u, h, p = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    feats = {
        "url_length": F.length(u), "host_length": F.length(h), "path_length": F.length(p), "depth": F.length(F.regexp_replace(p, "[^/]", "")), "labels": F.size(F.split(h, r"\.")),
        "digit_ratio": share(u, "[^0-9]"), "host_digit_ratio": share(h, "[^0-9]"), "hyphens": F.length(F.regexp_replace(h, "[^-]", "")), "entropy": entropy(u), "host_entropy": entropy(h),
        "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "has_fragment": F.instr(u, "#") > 0, "vowel_ratio": share(h, "[^aeiou]"),
    }
    return urls.withColumns({k: c.cast("double") for k, c in feats.items()}).withColumn("suffix", F.substring_index("host", ".", -1))


def listed(host: Column, hosts=LISTED_HOSTS) -> Column:
    found = F.lit(False)
    for h in hosts:
        found = found | (host == h) | host.endswith("." + h)
    return found


def train(urls: DataFrame, labels: Column, max_urls: int = MAX_TRAIN_URLS):
    """Trees and each suffix's smoothed share of label 1, from at most max_urls different URLs; None without both labels."""
    sample = urls.where("host <> ''").select("url", "host", "path", labels.cast("double").alias("label")).distinct()
    sample = lexical(sample.orderBy(F.xxhash64("url"), "url").limit(max_urls)).cache()
    rates = [(r["suffix"], r["rate"]) for r in sample.groupBy("suffix").agg(((F.sum("label") + 1) / (F.count("*") + 10)).alias("rate")).orderBy("suffix").collect()]  # at most one for each URL of the sample
    if sample.select("label").distinct().count() < 2:
        return None, rates
    rows = with_rate(sample, rates).select(*FEATURES, "label").coalesce(1)
    model = GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.3, seed=1, maxBins=32, cacheNodeIds=False).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    sample.unpersist()
    return model, rates


def with_rate(urls: DataFrame, rates: list) -> DataFrame:
    """Adds each suffix's share; 0.1, the prior, for suffixes not seen."""
    table = urls.sparkSession.createDataFrame(rates or [("", 0.1)], "suffix string, suffix_rate double")
    return urls.join(F.broadcast(table), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(0.1)))


def judge(pages: DataFrame, rules=RULES, hosts=LISTED_HOSTS, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page.

    A rule's verdict stands; else the trees block at a probability over threshold. A null url, or one without ``://``, has an empty host
    and path, fits no rule and is judged by its features. Repeated rows are judged alike; no rows give no rows; other columns are ignored.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    model, rates = train(urls, listed(F.col("host"), hosts))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    rows = with_rate(lexical(urls), rates)
    if model is None:
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        from pyspark.ml.functions import vector_to_array

        rows = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")
