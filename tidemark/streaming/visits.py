"""The log of page views: requests become rows that name no one, and a stream of them goes to a table of the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import net
from tidemark.streaming.store import Store, Table

VIEWS = Table("path string, referrer_host string, client_kind string, visitor_day_hash string, viewed_at timestamp")


def viewed(requests: DataFrame, datacenters: Sequence[str], salt: str) -> DataFrame:
    """Views of requests (method, path, referrer, forwarded, remote, agent, at), as a table or a stream: what was fetched of the pages that count, whence (the host alone), by what kind of client
    (those in the CIDR blocks ``datacenters`` aren't people), and a visitor's hash of the day instead of the address. Times are cut to seconds; requests without a time aren't views."""
    day = F.date_trunc("second", "at")
    own = requests.where((F.col("method") == "GET") & net.is_tracked(F.col("path")) & F.col("at").isNotNull()).withColumn("_ip", net.client_address(F.col("forwarded"), F.col("remote")))
    rows = net.in_ranges(own.withColumn("_number", net.ip_number(F.col("_ip"))), "_number", net.ranges(list(datacenters)), "_datacenter")
    return rows.select(
        "path", net.referrer_host(F.col("referrer")).alias("referrer_host"), net.client_kind(F.col("agent"), F.col("_datacenter")).alias("client_kind"), net.visitor_day(F.col("_ip"), F.col("agent"), day, salt).alias("visitor_day_hash"), day.alias("viewed_at")
    )


def log_views(requests: DataFrame, path: str, checkpoint: str, datacenters: Sequence[str], salt: str, every: str | None = None) -> StreamingQuery:
    """Runs a stream of requests into the log: all there is and then stops, or a batch at each interval. Each batch is one commit under its number, so a view is logged once, whatever fails."""

    def store(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, path, {"views": VIEWS}).commit({"views": batch}, "stream", number)

    writer = viewed(requests, datacenters, salt).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def views(spark: SparkSession, path: str) -> DataFrame:
    """The log; no rows before the first batch."""
    return Store(spark, path, {"views": VIEWS}).read("views")
