"""Keyed state of streams: each key's first row, and a budget that stops work until the next day.

State lives in the state store (RocksDB, see ``uses_rocksdb``), so what a batch costs depends on its own rows. It comes back after a restart from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

_DAY = timedelta(days=1)


def uses_rocksdb(spark: SparkSession) -> None:
    """Set the state store that processors need, for queries that start later in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(at: datetime) -> int:
    return int(at.replace(tzinfo=UTC).timestamp() * 1000)


class _FirstSeen(StatefulProcessor):
    """Gives a key's first row by (at, tie) of the batch in which the key comes up, and forgets the key once the watermark is keep_ms past that row."""

    def __init__(self, at: str, tie: str, keep_ms: int) -> None:
        self.at, self.tie, self.keep_ms = at, tie, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:  # of a hot key one row is held
            own = part.sort_values([self.at, self.tie], kind="stable").head(1)
            first = own if first is None else pd.concat([first, own]).sort_values([self.at, self.tie], kind="stable").head(1)
        if first is None or self.seen.exists():
            return
        at = first[self.at].iloc[0].to_pydatetime()
        self.seen.update((at,))
        self.handle.registerTimer(_millis(at) + self.keep_ms)
        yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, keys: Sequence[str], at: str, tie: str, late: str, keep_hours: float) -> DataFrame:
    """The first row of each key (null is a key too) by at, then tie; a key counts as new again keep_hours after its row. Rows later than ``late`` behind the newest are dropped by
    Spark; a re-scan heals them. at must not be null."""
    rows = stream.withWatermark(at, late)
    return rows.groupBy(*keys).transformWithStateInPandas(_FirstSeen(at, tie, int(keep_hours * 3_600_000)), rows.schema, "Append", "EventTime")


class _Gate(StatefulProcessor):
    """Lets work of one budget through until the day's cap is spent; the rest waits for the next day."""

    def __init__(self, columns: list[str], at: str, cost: str, warn: float, cap: float, waiting: T.StructType) -> None:
        self.columns, self.at, self.cost, self.warn, self.cap, self.waiting_schema = columns, at, cost, warn, cap, waiting

    def init(self, handle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", "day timestamp, spent double, warned boolean")
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def _through(self, rows: list[tuple], day: datetime, spent: float, warned: bool) -> tuple[list[tuple], list[tuple], float, bool]:
        out, wait = [], []
        for row in rows:
            if spent >= self.cap:
                wait.append(row)
                continue
            spent += float(row[self.columns.index(self.cost)] or 0.0)
            crossed = spent >= self.warn and not warned
            warned |= crossed
            out.append((*row, day, spent, "warn" if crossed else "go"))
        return out, wait, spent, warned

    def _settled(self, day: datetime, rows: list[tuple], spent: float, warned: bool, waiting: list[tuple]) -> Iterator[pd.DataFrame]:
        out, wait, spent, warned = self._through([*waiting, *rows], day, spent, warned)
        self.day.update((day, spent, warned))
        self.waiting.clear()
        if wait:
            self.waiting.put(wait)
            self.handle.registerTimer(_millis(day + _DAY))
        if out:
            yield pd.DataFrame(out, columns=[*self.columns, "spent_day", "spent", "decision"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))[self.columns].sort_values([self.at, self.columns[0]], kind="stable")
        for day, part in own.groupby(own[self.at].dt.normalize()):
            day = day.to_pydatetime()
            known, spent, warned = self.day.get() if self.day.exists() else (day, 0.0, False)
            if day > known:
                spent, warned = 0.0, False
            else:
                day = known  # late work counts for the day that is open
            plain = [tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r) for r in part.itertuples(index=False)]
            yield from self._settled(day, plain, spent, warned, [tuple(r) for r in self.waiting.get()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A day is over: what waits goes on with the next day's budget."""
        day = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).replace(tzinfo=None)
        known, _, _ = self.day.get()
        if day > known and self.waiting.exists():
            yield from self._settled(day, [], 0.0, False, [tuple(r) for r in self.waiting.get()])

    def close(self) -> None:
        pass


def within_daily_budget(work: DataFrame, gate: str, at: str, cost: str, warn: float = 4.0, cap: float = 5.0, late: str = "0 seconds") -> DataFrame:
    """A stream of work (its first column names a row) let through while its gate's (a column) spending of the day is under the cap, with spent_day, spent and decision.

    The row that reaches ``warn`` says so once a day. The row that reaches the cap still runs, as its cost is known only afterwards; later ones wait in the state and go on first thing
    once the watermark reaches the next day (UTC). A gate's work is in one task, as its sum is one number; a backlog waits in the state.
    """
    rows = work.withWatermark(at, late)
    schema = T.StructType([*rows.schema.fields, T.StructField("spent_day", T.TimestampType()), T.StructField("spent", T.DoubleType()), T.StructField("decision", T.StringType())])
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    return rows.groupBy(gate).transformWithStateInPandas(_Gate(rows.columns, at, cost, warn, cap, plain), schema, "Append", "EventTime")


def reopened(verdicts: DataFrame, events: DataFrame, late: str, horizon: str) -> DataFrame:
    """Verdicts (risk_id, cik, checked_at) with the later events (cik, filed_at, event_id) of their company that open them again, within the horizon; or with nulls once none can come.

    Both sides are streams; the watermarks and the horizon bound what is kept of either: a verdict goes when no event in its horizon can come any more.
    """
    v = verdicts.withWatermark("checked_at", late)
    e = events.select(F.col("cik").alias("_cik"), "filed_at", "event_id").withWatermark("filed_at", late)
    met = (F.col("cik") == F.col("_cik")) & (F.col("filed_at") > F.col("checked_at")) & (F.col("filed_at") <= F.col("checked_at") + F.expr(f"interval {horizon}"))
    return v.join(e, met, "left_outer").select("risk_id", "cik", "checked_at", "event_id", "filed_at")
