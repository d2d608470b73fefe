"""Calls to what is outside Spark (judges, embedders), each answer kept in a log before anything is made of it.

A call is a function from a list of texts to (index, answer) pairs, in any order. It runs in Arrow batches inside tasks. An index that doesn't come back, and a batch
that raises, are failures of their rows alone, and so is an answer that isn't acceptable; ``Passing`` errors are tried again after growing waits. Every outcome, good or bad, is one row of the log, written by one job and committed
as a whole; what is derived reads the log. So a row with an answer isn't asked again, whatever reads or repeats the derived tables, and only failed rows come again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.streaming.store import Store, Table

OUTCOMES = Table("stage string, version string, key string, ok boolean, raw string, error string, attempts int, called_at timestamp", ("stage", "version", "key"), "all")
Call = Callable[[list[str]], Iterable[tuple[int, str | None]]]


class Passing(Exception):
    """An error that may be gone the next time: a limit of the rate, an outage."""


def attempted(call: Call, texts: list[str], tries: int, wait: float, accept: Callable[[str], bool] | None = None, sleep=time.sleep) -> tuple[list[str | None], list[str | None], int]:
    """Answers and errors in the order of the texts, and the number of calls made. A passing error is waited out, twice as long each time."""
    for k in range(1, tries + 1):
        try:
            answers: list[str | None] = [None] * len(texts)
            for i, answer in call(texts):
                if 0 <= i < len(texts):
                    answers[i] = answer
            errors = ["no answer" if a is None else "not acceptable" if accept and not accept(a) else None for a in answers]
            return [a if e is None else None for a, e in zip(answers, errors)], errors, k
        except Passing as e:
            error = f"{type(e).__name__}: {e}"
            if k < tries:
                sleep(wait * 2 ** (k - 1))
        except Exception as e:  # what is wrong with the request doesn't pass
            return [None] * len(texts), [f"{type(e).__name__}: {e}"] * len(texts), k
    return [None] * len(texts), [error] * len(texts), tries


class Caller:
    """A call with its log: a folder that all executors and the driver share."""

    def __init__(self, spark: SparkSession, log: str, call: Call, batch: int = 32, tries: int = 4, wait: float = 1.0, most_failures: int | None = None, accept: Callable[[str], bool] | None = None) -> None:
        self.store = Store(spark, log, {"outcomes": OUTCOMES})
        self.call, self.batch, self.tries, self.wait, self.most_failures, self.accept = call, batch, tries, wait, most_failures, accept

    def outcomes(self, stage: str, version: str) -> DataFrame:
        """Of each key of a stage at a version: its answer (the first, if it was asked twice at once) or else its last failure, and how many failures it has."""
        folders = self.store.state()["folders"].get("outcomes", [])
        rows = self.store.rows_of("outcomes", folders).where((F.col("stage") == stage) & (F.col("version") == version))
        good = Window.partitionBy("key").orderBy(F.desc("ok"), F.when(F.col("ok"), F.col("_n")).otherwise(-F.col("_n")))
        failures = F.count_if(~F.col("ok")).over(Window.partitionBy("key"))
        return rows.withColumn("_k", F.row_number().over(good)).withColumn("failures", failures).where("_k = 1").drop("_k", "_n")

    def ask(self, requests: DataFrame, keys: Sequence[str], stage: str, version: str) -> DataFrame:
        """requests (keys, text and more) with ``raw``, of those that have an answer after this pass. Only requests without one are called, each once.

        A null text isn't asked. Another text under the same keys is another question.
        """
        key = F.to_json(F.struct(*keys, F.xxhash64("text").alias("text_hash")), {"ignoreNullFields": "false"})
        named = requests.withColumn("_key", key)
        done = self.outcomes(stage, version)
        closed = done.where("ok" if self.most_failures is None else f"ok or failures >= {self.most_failures}").select(F.col("key").alias("_key"))
        todo = named.where("text is not null").select("_key", "text").dropDuplicates(["_key"]).join(closed, "_key", "left_anti")
        call, size, tries, wait, accept = self.call, self.batch, self.tries, self.wait, self.accept

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, size):
                    part = b.slice(at, size)
                    answers, errors, n = attempted(call, part["text"].to_pylist(), tries, wait, accept)
                    yield pa.RecordBatch.from_arrays([part["_key"], pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array([n] * part.num_rows, pa.int32())], names=["key", "raw", "error", "attempts"])

        said = todo.mapInArrow(run, "key string, raw string, error string, attempts int")
        rows = said.select(F.lit(stage).alias("stage"), F.lit(version).alias("version"), "key", F.col("error").isNull().alias("ok"), "raw", "error", "attempts", F.current_timestamp().alias("called_at"))
        self.store.commit({"outcomes": rows}, stage, None)  # the one job that calls
        found = self.outcomes(stage, version).where("ok").select(F.col("key").alias("_key"), "raw")
        return named.join(found, "_key").drop("_key")

    def failed(self, stage: str, version: str) -> DataFrame:
        """Keys without an answer: error and how many failures."""
        return self.outcomes(stage, version).where("not ok").select("key", "error", "failures", "called_at")


Judge = Caller | Callable[[Column], Column]


def answered(requests: DataFrame, keys: Sequence[str], judge: Judge, stage: str, version: str) -> DataFrame:
    """requests with ``raw``, without those that have no answer.

    A column function is evaluated once a row: its value goes through a generator, below which Spark moves no filter and into which it copies no expression. It is
    evaluated again when the result is read again; a Caller isn't.
    """
    if isinstance(judge, Caller):
        return judge.ask(requests, keys, stage, version)
    return requests.select("*", F.explode(F.array(judge(F.col("text")))).alias("raw")).where("raw is not null")
