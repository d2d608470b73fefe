"""Streams of landed files: parsed in micro-batches, each key stored once, whatever is read twice.

A sink is a table of a ``store.Store``: each batch is one commit under its number, so a restart neither loses nor repeats rows, and re-scans may write at the same time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.operators.current import first_n
from tidemark.streaming.state import first_seen
from tidemark.streaming.store import Store, Table


def landed(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of whole files (text, path, landed_at); ``per_trigger`` files a batch at most, the others wait."""
    reader = spark.readStream.format("text").option("wholetext", "true")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("landed_at"))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a sink has stored; no rows before the first batch."""
    return Store(spark, path, {"rows": Table(schema)}).read("rows")


def append_once(path: str, schema: str, keys: Sequence[str], order: str, known_new: bool = False) -> Callable[[DataFrame, int | str], None]:
    """For ``foreachBatch``: commits the batch's rows whose keys (null is one) aren't stored yet, the first by ``order`` of each key. A batch by hand has a name instead of a number."""
    table = Table(schema, tuple(keys), "once", order)

    def store(batch: DataFrame, number: int | str) -> None:
        by_hand = isinstance(number, str)
        Store(batch.sparkSession, path, {"rows": table}).commit({"rows": batch}, number if by_hand else "stream", None if by_hand else number, known_new)

    return store


def ingest(entries: DataFrame, path: str, schema: str, keys: Sequence[str], order: str, checkpoint: str, every: str | None = None, at: str | None = None, late: str = "1 day", keep_hours: float = 24 * 30) -> StreamingQuery:
    """Runs a stream of entries into the sink: all there is and then stops, or a batch at each interval (as "30 seconds"). One query a checkpoint.

    Each batch is compared with what is stored. With a time column ``at`` the stream's own keys are kept as state instead (see ``state.first_seen``, which says what is late),
    so that a batch is compared with re-scans alone and costs the same after a year as on the first day; ``state.uses_rocksdb`` comes before.
    """
    rows = entries if at is None else first_seen(entries, keys, at, order, late, keep_hours)
    writer: DataStreamWriter = rows.writeStream.foreachBatch(append_once(path, schema, keys, order, known_new=at is not None)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rescan(listing: DataFrame, path: str, schema: str, keys: Sequence[str], order: str, name: str = "re-scan") -> None:
    """Heals what the stream missed: a full listing goes through the same sink, under a name of its own (a day, say). It may run again, and beside the stream."""
    append_once(path, schema, keys, order)(listing, name)


def next_batch(entries: DataFrame, done: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """What a tick takes on: entries not done, the first ``most`` by order; the others stay for later ticks."""
    return entries.join(done.select(key), key, "left_anti").orderBy(*order, key).limit(most)


def since(rows: DataFrame, at: str, baseline: str, most: int = 50, key: str = "id") -> DataFrame:
    """Rows strictly later than a client's baseline in whole seconds, newest first, ``most`` at most (the poll's feature); rows without a time don't show."""
    return rows.where(F.date_trunc("second", at) > F.date_trunc("second", F.lit(baseline).cast("timestamp"))).orderBy(F.desc(at), F.desc(key)).limit(most)


def window_of(rows: DataFrame, at: str, asof: str, hours: int) -> DataFrame:
    """Rows of the last hours up to asof."""
    now = F.lit(asof).cast("timestamp")
    return rows.where((F.col(at) >= now - F.expr(f"interval {hours} hours")) & (F.col(at) <= now))


def bucketed(stream: DataFrame, at: str, width: str, late: str, *values: Column, slide: str | None = None) -> DataFrame:
    """Tumbling (or, with slide, sliding) windows of a stream: start, calls and the values given. Windows close once the watermark, ``late`` behind the newest row, has passed them."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, width, slide) if slide else F.window(at, width)).agg(F.count("*").alias("calls"), *values)
    return rows.select(F.col("window.start").alias("start"), "calls", *[c for c in rows.columns if c not in ("window", "calls")])


def once_within(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """A stream's keys once within the watermark, for streams too long to remember every key."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def advanced(cursor: DataFrame, done: DataFrame) -> DataFrame:
    """The cursor (id, last_accession_number, last_filed_at) after what is done (accession_number, filed_at): it only moves forward."""
    new = done.agg(F.max(F.struct("filed_at", "accession_number")).alias("m"))
    later = F.col("m").isNotNull() & (F.col("last_filed_at").isNull() | (F.struct(F.col("m.filed_at"), F.col("m.accession_number")) > F.struct("last_filed_at", "last_accession_number")))
    return cursor.join(F.broadcast(new)).select("id", F.when(later, F.col("m.accession_number")).otherwise(F.col("last_accession_number")).alias("last_accession_number"), F.when(later, F.col("m.filed_at")).otherwise(F.col("last_filed_at")).alias("last_filed_at"))


def ingested_through(days: DataFrame) -> DataFrame:
    """The last of the days (day, complete) before the first that isn't complete: a cursor never passes a day with a gap."""
    gap = days.where("not complete").agg(F.min("day").alias("gap"))
    return days.join(F.broadcast(gap)).where("complete and (gap is null or day < gap)").agg(F.max("day").alias("through"))


def drained(outbox: DataFrame, asof: str, send: Callable[[dict], None], most: int = 500) -> DataFrame:
    """The outbox after a pass: what is due is sent, ``most`` alerts at most, and settled; stale info and repeats count as delivered without being sent; the rest stays."""
    from tidemark.operators import alerts

    decided = alerts.drain(outbox, asof)
    due = first_n(decided.where("outcome = 'deliver'").join(outbox.select("id", "title", "body", "created_at"), "id").withColumn("_", F.lit(1)), ["_"], most, F.col("created_at"), F.col("id")).drop("_")
    results = []
    for row in due.collect():  # the pass's limit bounds these
        try:
            send(row.asDict())
            results.append((row["id"], True, None))
        except Exception as e:  # a failed alert stays pending with its error
            results.append((row["id"], False, str(e)))
    quiet = decided.where("outcome in ('expired', 'repeat')").select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    return alerts.settle(outbox, outbox.sparkSession.createDataFrame(results, "id long, ok boolean, error string").unionByName(quiet), asof)
