"""A filing's way as one resumable job: listed, fetched, classified, reduced to events, stored.

Each batch of a listing is one commit of all tables, under the batch's number. What is outside Spark (fetching, classifying, reducing) goes through call logs. So a run that ends
anywhere leaves tables as they were, and the next one takes up the answers that there are and asks for the rest: the tables are those of one clean run. A filing that was fetched and not
classified is an orphan: ``heal`` tries it again until it has failed three times.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import jobs
from tidemark.operators.calls import Caller
from tidemark.streaming.store import Store, Table

CONTENT = "body_text string, sections array<struct<number:string,text:string>>, exhibits array<struct<exhibit_type:string,text:string>>"
_ENTRY = "accession_number string, form string, company_name string, cik string, ticker string, filing_date string, url string"
TABLES = {
    "filings": Table(f"{_ENTRY}, {CONTENT}, fetched_at timestamp", ("accession_number",), "last", "fetched_at"),
    "classifications": Table("accession_number string, form string, item_number string, event_type string, is_material boolean, confidence double, reasoning string, event_domain string, classifier_version string, classified_at timestamp", ("accession_number", "item_number", "classifier_version"), "once", "classified_at"),
    "events": Table("accession_number string, event_type string, is_material boolean, confidence double, summary string, anchor_item_number string, items array<string>, event_domain string, run_id long", ("accession_number", "event_type", "anchor_item_number", "run_id"), "once"),
    "attempts": Table("accession_number string, at timestamp, cause string"),
}


class Outside(NamedTuple):
    """What the chain asks: fetch (a URL; a JSON object of CONTENT), classify and reduce (texts; JSON)."""

    fetch: Caller
    classify: Caller
    reduce: Caller


def store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, TABLES)


def _classified(db: Store, filings: DataFrame, outside: Outside, version: str, leaves: tuple[str, ...], asof: str, run_id: int) -> dict[str, DataFrame]:
    """Classifications and events of filings with a body, and an attempt for each filing that has no classification after all."""
    none = db.spark.createDataFrame([], TABLES["classifications"].schema)
    rows = db.staged(jobs.classify_gap(filings.where("body_text is not null"), none, version, outside.classify, leaves, asof))
    failed = filings.join(rows.select("accession_number"), "accession_number", "left_anti")
    cause = F.when(F.col("body_text").isNull(), "not fetched").otherwise("not classified")
    return {"classifications": rows, "events": jobs.reduce_filings(rows, outside.reduce, run_id), "attempts": failed.select("accession_number", F.lit(asof).cast("timestamp").alias("at"), cause.alias("cause"))}


def process(db: Store, entries: DataFrame, batch: int, outside: Outside, version: str, leaves: tuple[str, ...], asof: str, writer: str = "chain") -> int | None:
    """One batch of entries (columns of a listing, url among them) through the chain; the commit, or None if it was done before. Entries with a stored body are left out.

    An entry that couldn't be fetched is stored without a body and comes again with a listing that holds it.
    """
    if db.state()["writers"].get(writer, -1) >= batch:
        return None
    own = entries.select(*[c.split()[0] for c in _ENTRY.split(", ")]).where("accession_number is not null").dropDuplicates(["accession_number"])
    new = own.join(db.read("filings").where("body_text is not null").select("accession_number"), "accession_number", "left_anti")
    answers = outside.fetch.ask(new.select("accession_number", F.col("url").alias("text")), ["accession_number"], "fetch", "1").select("accession_number", F.from_json("raw", CONTENT).alias("c"))
    filings = db.staged(new.join(answers, "accession_number", "left").select(*new.columns, "c.*", F.lit(asof).cast("timestamp").alias("fetched_at")))
    return db.commit({"filings": filings} | _classified(db, filings, outside, version, leaves, asof, batch), writer, batch)


def run(db: Store, entries: DataFrame, checkpoint: str, outside: Outside, version: str, leaves: tuple[str, ...], asof: str, every: str | None = None) -> StreamingQuery:
    """A stream of entries through the chain: all there is and then stops, or a batch at each interval. One query a checkpoint."""
    writer = entries.writeStream.foreachBatch(lambda batch, number: process(db, batch, number, outside, version, leaves, asof)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def orphans(db: Store, asof: str, grace_minutes: int = 5, abandon: int = 3) -> DataFrame:
    """Filings with a body, without classifications, whose attempts haven't reached the limit."""
    tries = db.read("attempts").groupBy("accession_number").agg(F.count("*").alias("classify_attempts"))
    filings = db.read("filings").where("body_text is not null").join(tries, "accession_number", "left")
    return jobs.orphans(filings, db.read("classifications"), asof, grace_minutes, abandon).drop("classify_attempts")


def heal(db: Store, batch: int, outside: Outside, version: str, leaves: tuple[str, ...], asof: str, most: int | None = None, grace_minutes: int = 5, abandon: int = 3) -> int | None:
    """Try orphans again, ``most`` of the oldest at once; each failure is an attempt more."""
    waiting = db.staged(jobs.first_rows(orphans(db, asof, grace_minutes, abandon), most, "fetched_at", "accession_number"))
    return db.commit(_classified(db, waiting, outside, version, leaves, asof, 1_000_000_000 + batch), "heal", batch)


def current_events(db: Store) -> DataFrame:
    """Events of each filing's newest run, with the time of its filing."""
    from tidemark.operators.current import latest_run

    return latest_run(db.read("events"), "accession_number").join(db.read("filings").select("accession_number", "filing_date", "cik", "company_name"), "accession_number")
