"""The alert outbox: emit, drain, mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "critical")


def checked(alerts: DataFrame) -> DataFrame:
    """Alerts to append; an unknown severity is an error."""
    return alerts.withColumn("severity", F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise(F.raise_error(F.concat(F.lit("unknown severity "), F.coalesce("severity", F.lit("null"))))))


def drain(outbox: DataFrame, asof: str, ttl_minutes: int = 30, repeat_hours: int = 4, routes: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """What becomes of each undelivered alert: ``expired`` (info older than its time), ``unroutable`` (stays pending), ``repeat`` (its key was delivered
    within the window, or comes earlier in this pass) or ``deliver``. Alerts without a key are never repeats.
    """
    now = F.lit(asof).cast("timestamp")
    pending = outbox.where("delivered_at is null")
    recent = outbox.where(F.col("delivered_at") > now - F.expr(f"interval {repeat_hours} hours")).where("dedup_key is not null").select("dedup_key").distinct().withColumn("_sent", F.lit(True))
    stale = (F.col("severity") == "info") & (F.col("created_at") < now - F.expr(f"interval {ttl_minutes} minutes"))
    rows = pending.join(recent, "dedup_key", "left").withColumn("_live", ~stale & F.col("severity").isin(*routes))
    first = F.row_number().over(Window.partitionBy("dedup_key", "_live").orderBy("created_at", "id"))
    rows = rows.withColumn("_n", F.when(F.col("dedup_key").isNotNull(), first).otherwise(1))
    outcome = F.when(stale, "expired").when(~F.col("severity").isin(*routes), "unroutable").when(F.coalesce("_sent", F.lit(False)) | (F.col("_n") > 1), "repeat").otherwise("deliver")
    return rows.select("id", "severity", "dedup_key", outcome.alias("outcome"))


def settle(outbox: DataFrame, results: DataFrame, asof: str) -> DataFrame:
    """The outbox after a pass: results (id, ok, error) set the time of delivery, or count an attempt and keep the error."""
    r = results.select("id", "ok", "error")
    now = F.lit(asof).cast("timestamp")
    done = outbox.join(r, "id", "left")
    return done.withColumns({"delivered_at": F.when(F.col("ok"), now).otherwise(F.col("delivered_at")), "attempts": F.col("attempts") + F.col("ok").isNotNull().cast("int"), "last_error": F.when(F.col("ok"), None).otherwise(F.coalesce("error", "last_error"))}).select(outbox.columns)
