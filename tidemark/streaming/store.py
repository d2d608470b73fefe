"""Tables that are written together, a commit at a time, by any number of writers.

Data go to folders that nobody reads until a commit names them. A commit is a file ``_commits/<number>.json`` that is put only if it is absent, so of two writers who want the same
number one has to look again at what the other has stored. Readers see the folders of the newest commit: all tables of one commit, or none. A writer numbers its batches; one that it
has committed already is not stored again, so a batch that comes back after a failure changes nothing. A writer that dies leaves a folder that no commit names.

A table keeps ``once`` each key's first row, ``last`` each key's newest row, or ``all`` rows. Null keys are keys like others.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Table(NamedTuple):
    """schema: a DDL text; keys; kind: once, last or all; order: of rows of one key in a batch, the first (once) or last (last) of which counts."""

    schema: str
    keys: Sequence[str] = ()
    kind: str = "all"
    order: str | None = None


class Conflict(Exception):
    """Another writer has taken the number."""


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.columns = {name: spark.createDataFrame([], t.schema).columns for name, t in tables.items()}
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path(self.path).getFileSystem(conf)
        self.files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf) if self.fs.getScheme() != "file" else None

    # --- the log

    def numbers(self) -> list[int]:
        """Numbers of all commits."""
        at = self._path(f"{self.path}/_commits")
        if not self.fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self.fs.listStatus(at) if f.getPath().getName().endswith(".json"))

    def state(self, number: int | None = None) -> dict:
        """The newest commit (or one by number): number, writers (the last batch of each) and folders of each table, in the order of their commits."""
        all_ = self.numbers() if number is None else [number]
        if not all_:
            return {"number": 0, "writers": {}, "folders": {}}
        stream = self.fs.open(self._path(f"{self.path}/_commits/{all_[-1]:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, state: dict) -> None:
        """Put the commit's file if it is absent: by a link on one machine's disk, by a rename that doesn't overwrite elsewhere."""
        target, own = f"{self.path}/_commits/{state['number']:020d}.json", f"{self.path}/_commits/.{uuid.uuid4().hex}"
        text = json.dumps(state)
        self.fs.mkdirs(self._path(f"{self.path}/_commits"))
        if self.files is None:
            local = lambda p: self._path(p).toUri().getPath()
            with open(local(own), "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(local(own), local(target))
            except FileExistsError:
                raise Conflict(target) from None
            finally:
                os.unlink(local(own))
            return
        out = self.fs.create(self._path(own), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self.files.rename(self._path(own), self._path(target), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(self._path(own), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(target) from None
            raise

    # --- reading

    def rows_of(self, name: str, folders: Sequence[dict]) -> DataFrame:
        """All rows of folders, with the number of their commit in ``_n`` (which column no table has)."""
        schema = self.tables[name].schema
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, _n long")
        rows = self.spark.read.schema(f"{schema}, c string").option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/c={f['c']}" for f in folders])
        numbers = self.spark.createDataFrame([(f["c"], f["n"]) for f in folders], "c string, _n long")  # as many as compaction leaves
        return rows.join(F.broadcast(numbers), "c").drop("c").select(*self.columns[name], "_n")

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """The table at the newest commit, or at that of state."""
        state, table = state or self.state(), self.tables[name]
        rows = self.rows_of(name, state["folders"].get(name, []))
        if table.kind != "last":
            return rows.drop("_n")
        newest = Window.partitionBy(*table.keys).orderBy(F.desc("_n"))
        return rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k", "_n")

    # --- writing

    def first_of(self, name: str, batch: DataFrame) -> DataFrame:
        """A batch with the row of each key that counts."""
        table = self.tables[name]
        rows = batch.select(*self.columns[name])
        if table.kind == "all":
            return rows
        order = [F.col(table.order) if table.kind == "once" else F.desc(table.order)] if table.order else []
        own = Window.partitionBy(*table.keys).orderBy(*order, F.xxhash64(*self.columns[name]))
        return rows.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")

    def without(self, name: str, rows: DataFrame, folders: Sequence[dict]) -> DataFrame:
        """Rows whose keys the folders lack."""
        if not folders:
            return rows
        keys = list(self.tables[name].keys)
        known = self.rows_of(name, folders).select(*[F.col(k).alias(f"_{k}") for k in keys])
        same: Column = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        return rows.join(known, same, "left_anti")

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}/c={folder}")
        return folder

    def staged(self, rows: DataFrame) -> DataFrame:
        """rows, written once beside the tables, so that steps that build on them have a short plan and don't do the work again. No commit names what is written here."""
        at = f"{self.path}/_staged/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def commit(self, batches: dict[str, DataFrame], writer: str, batch: int | None, known_new: bool = False, tries: int = 50) -> int | None:
        """Store batches of some tables together; the number of the commit, or None if the writer has committed this batch, or a later one, before. Without a number it is stored always.

        With known_new the caller vouches (by a stream's state) that this writer hasn't stored the keys, so only folders of other writers are compared: what a batch costs then
        doesn't depend on how much the stream has stored.
        """
        state = self.state()
        done = lambda state: batch is not None and state["writers"].get(writer, -1) >= batch
        if done(state):
            return None
        compared = {name: [f for f in state["folders"].get(name, []) if not (known_new and f["w"] == writer)] if self.tables[name].kind == "once" else [] for name in batches}
        folders = {name: self._write(name, self.without(name, self.first_of(name, rows), compared[name])) for name, rows in batches.items()}
        for _ in range(tries):
            number = state["number"] + 1
            now = {name: [*state["folders"].get(name, [])] for name in self.tables}
            for name, folder in folders.items():
                now[name].append({"c": folder, "n": number, "w": writer})
            try:
                self._put({"number": number, "writers": state["writers"] | ({} if batch is None else {writer: batch}), "folders": now})
                return number
            except Conflict:
                before, state = state, self.state()
            if done(state):
                return None
            for name in [n for n in folders if self.tables[n].kind == "once"]:  # what came in between may hold the same keys
                old = {f["c"] for f in before["folders"].get(name, [])}
                came = [f for f in state["folders"].get(name, []) if f["c"] not in old]
                if came:
                    own = self.rows_of(name, [{"c": folders[name], "n": 0}]).drop("_n")
                    folders[name] = self._write(name, self.without(name, own, came))
        raise Conflict(f"{tries} tries by {writer}")

    def compact(self, name: str, tries: int = 20) -> int | None:
        """Put a table's folders together: one for each writer, so that known_new goes on working, or a single one of a ``last`` table, without what newer rows have replaced.

        None if there is nothing to do. What is committed meanwhile stays.
        """
        state, last = self.state(), self.tables[name].kind == "last"
        folders = state["folders"].get(name, [])
        groups: dict[str, list[dict]] = {}
        for f in folders:
            groups.setdefault("" if last else f["w"], []).append(f)
        groups = {w: g for w, g in groups.items() if len(g) > 1}
        if not groups:
            return None
        whole = [{"c": self._write(name, self.read(name, state) if last else self.rows_of(name, g).drop("_n")), "n": max(f["n"] for f in g), "w": w} for w, g in groups.items()]
        gone = {f["c"] for g in groups.values() for f in g}
        for _ in range(tries):
            here = state["folders"].get(name, [])
            if not gone <= {f["c"] for f in here}:
                return None  # another compaction was faster
            now = sorted([*whole, *(f for f in here if f["c"] not in gone)], key=lambda f: f["n"])
            try:
                self._put({"number": state["number"] + 1, "writers": state["writers"], "folders": state["folders"] | {name: now}})
                return state["number"] + 1
            except Conflict:
                state = self.state()
        raise Conflict(f"{tries} tries of compaction")

    def unnamed(self, name: str) -> list[str]:
        """Folders that the newest commit doesn't name: replaced ones, and those of writers that died or are at work. Removing them is the caller's decision."""
        at = self._path(f"{self.path}/{name}")
        named = {f["c"] for f in self.state()["folders"].get(name, [])}
        return [x for x in (f.getPath().getName()[2:] for f in self.fs.listStatus(at)) if x not in named] if self.fs.exists(at) else []
