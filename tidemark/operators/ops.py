"""Operations: cost, zero-padded buckets, trailing windows, freshness, page views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dollars for a million tokens (input, output). Cached tokens are part of the input.
PRICES = {"claude-haiku-4-5-20251001": (1.0, 5.0), "claude-sonnet-4-6": (3.0, 15.0), "claude-opus-4-7": (15.0, 75.0)}
CACHE_WRITE, CACHE_READ = 1.25, 0.10


def cost(model: Column, tokens_in: Column, tokens_out: Column, read: Column, created: Column, prices=PRICES) -> tuple[Column, Column]:
    """Estimated dollars, and whether the model is unknown (then the highest rates hold). Missing counts are zero."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    top = max(p[0] for p in prices.values()), max(p[1] for p in prices.values())
    rate_in, rate_out = F.lit(top[0]), F.lit(top[1])
    for name, (i, o) in prices.items():
        rate_in, rate_out = F.when(model == name, i).otherwise(rate_in), F.when(model == name, o).otherwise(rate_out)
    plain = F.greatest(F.lit(0), zero(tokens_in) - zero(read) - zero(created))
    dollars = (plain * rate_in + zero(created) * rate_in * CACHE_WRITE + zero(read) * rate_in * CACHE_READ + zero(tokens_out) * rate_out) / 1e6
    return dollars, F.coalesce(~model.isin(*prices), F.lit(True))


def padded_buckets(rows: DataFrame, at: str, value: str, unit: str, asof: str, n: int) -> DataFrame:
    """Exactly n buckets (hour or day) up to the one that holds asof, oldest first: bucket, calls, total; empty ones are zero."""
    spark = rows.sparkSession
    last = F.date_trunc(unit, F.lit(asof).cast("timestamp"))
    step = F.expr(f"interval 1 {unit}")
    first = last - F.expr(f"interval {n - 1} {unit}")
    grid = spark.range(1).select(F.explode(F.sequence(first, last, step)).alias("bucket"))
    sums = rows.where((F.col(at) >= first) & (F.col(at) < last + step)).groupBy(F.date_trunc(unit, at).alias("bucket")).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))
    return grid.join(sums, "bucket", "left").select("bucket", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.coalesce("total", F.lit(0.0)).alias("total"))


def trailing(rows: DataFrame, at: str, value: str, asof: str, hours: int) -> DataFrame:
    """Number and sum of what happened in the hours up to asof."""
    now = F.lit(asof).cast("timestamp")
    return rows.where((F.col(at) > now - F.expr(f"interval {hours} hours")) & (F.col(at) <= now)).agg(F.count("*").alias("calls"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def freshest(rows: DataFrame, key: str, at: str, shown: str) -> DataFrame:
    """Per key the column ``shown`` of the latest row (ties: its largest value) and the time."""
    return rows.groupBy(key).agg(F.max_by(shown, F.struct(at, shown)).alias(shown), F.max(at).alias("latest"))


def day_totals(rows: DataFrame, at: str, *columns: str) -> DataFrame:
    return rows.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def view_summary(views: DataFrame, asof: str) -> DataFrame:
    """Views and visitors (people with an address) of a day and a week, their kinds: seven figures in one pass."""
    now = F.lit(asof).cast("timestamp")
    day, week = F.col("viewed_at") > now - F.expr("interval 1 day"), F.col("viewed_at") > now - F.expr("interval 7 days")
    person = F.col("client_kind") == "human"
    who = F.nullif("visitor_day_hash", F.lit(""))
    return views.where(F.col("viewed_at") <= now).agg(
        F.count("*").alias("views"), F.count_if(day).alias("views_day"), F.count_if(week).alias("views_week"), F.count_if(week & person).alias("human_week"), F.count_if(week & ~person).alias("other_week"),
        F.count_distinct(F.when(day & person, who)).alias("visitors_day"), F.count_distinct(F.when(week & person, who)).alias("visitors_week"),
    )


def top(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties in their order."""
    return rows.groupBy(column).agg(F.count("*").alias("views")).orderBy(F.desc("views"), column).limit(n)


def bar_heights(rows: DataFrame, value: str, order: str, tallest: float = 100.0, floor: float = 2.0) -> DataFrame:
    """Adds bar heights in relation to the peak; what is above zero is at least ``floor`` high."""
    peak = rows.agg(F.max(value).alias("_peak"))
    height = F.when(F.col(value) <= 0, 0.0).otherwise(F.greatest(F.lit(floor), F.col(value) / F.col("_peak") * tallest))
    return rows.join(F.broadcast(peak)).withColumn("height", F.when(F.col("_peak") > 0, height).otherwise(0.0)).drop("_peak").orderBy(order)


def over_budget(spent: float, cap: float = 5.0, warn: float = 4.0) -> str:
    return "stop" if spent >= cap else "warn" if spent >= warn else "ok"


def first_day(rows: DataFrame, at: str) -> DataFrame:
    """The day of the earliest row; null without rows."""
    return rows.agg(F.to_date(F.min(at)).alias("start"))


def spend_caveat(start: Column, asof: Column, days: int) -> Column:
    """Whether data begin within the window of ``days`` up to asof, so that its sum is of a shorter time."""
    return F.coalesce(start > F.date_sub(asof, days), F.lit(False))


def cursor_freshness(cursor: DataFrame, asof: str) -> DataFrame:
    """last_filed_at of a cursor as a date, and the days that it lies behind asof."""
    from tidemark.functions.dates import any_date

    day = any_date(F.col("last_filed_at"))
    return cursor.select(day.alias("last_filed"), F.datediff(F.lit(asof).cast("date"), day).alias("days_behind"))


def collapsed(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each key of many: the first and last time and their number."""
    return rows.groupBy(*keys).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))
