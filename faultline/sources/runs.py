"""Stored runs: staged writes, one commit for a run with all its tables, reads of details and pages."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The tables of a run: what it is, its cases, and what was found for them; each has the columns run_id and (but `run`) case_id.
TABLES = ("run", "cases", "linked_entities", "checks", "corrections", "paths", "artifacts")
#: The order of what a case has, as it is read.
CHILD_ORDER = {"linked_entities": ("field", "link_id"), "checks": ("check_id",), "corrections": ("field", "candidate_id"), "paths": ("rank", "path_id")}


class Conflict(RuntimeError):
    """Another writer has committed since."""


class RunStore:
    """Runs under a folder that all executors see.

    A run is written by attempts: each table of an attempt goes to data/<table>/attempt=<id>, then one file in log/ says that the
    attempt is the run's. Files of the log are numbered and created only if they are not there, so of two writers one has to
    write again, and a driver that is lost before that file leaves the old run, after it the new one. Details of cases are nested
    when they are written, so that reading them needs no join and no exchange.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        path, fs = self._path("log")
        return sorted(int(s.getPath().getName().partition(".")[0]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def commit(self, entry: dict, after: int) -> int:
        """Adds the entry to the log, after the number that the writer has seen; Conflict if that is not the last any more.

        The file is written under another name and moved: a move to a name that exists fails, and no half of it is ever seen.
        """
        number = after + 1
        staged, fs = self._path(f"staged/{uuid.uuid4().hex}.json")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(entry | {"seq": number}).encode()))
        out.close()
        target, _ = self._path(f"log/{number:012d}.json")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(staged, target):
            raise Conflict(f"commit {number} is there already")
        return number

    def save(self, run_id: str, tables: dict[str, DataFrame], again: int = 10) -> str:
        """Writes a run, new or once more, with all its tables; tables that are not given are empty from now on. Returns the attempt."""
        if unknown := set(tables) - set(TABLES):
            raise ValueError(f"no tables of a run: {sorted(unknown)}")
        attempt = uuid.uuid4().hex
        for name, df in tables.items():
            df.withColumn("run_id", F.lit(run_id)).write.parquet(f"{self.root}/data/{name}/attempt={attempt}")
        if "cases" in tables:
            read = {n: self.spark.read.parquet(f"{self.root}/data/{n}/attempt={attempt}") for n in tables}
            nested(read).write.parquet(f"{self.root}/data/details/attempt={attempt}")
        for _ in range(again):
            commits = self._commits()
            try:
                self.commit({"run_id": run_id, "attempt": attempt, "tables": sorted(tables)}, commits[-1] if commits else 0)
            except Conflict:
                continue
            return attempt
        raise Conflict(f"{again} other writers came before")

    def remove(self, run_id: str) -> None:
        commits = self._commits()
        self.commit({"run_id": run_id, "attempt": None, "tables": []}, commits[-1] if commits else 0)

    def current(self, as_of: int | None = None) -> DataFrame:
        """run_id, attempt, seq of the runs there are, or were after that commit: the last entry of each."""
        schema = "run_id string, attempt string, tables array<string>, seq long"
        if not self._commits():
            return self.spark.createDataFrame([], schema).select("run_id", "attempt", "seq")
        log = self.spark.read.schema(schema).json(f"{self.root}/log")
        if as_of is not None:
            log = log.where(F.col("seq") <= as_of)
        last = log.groupBy("run_id").agg(F.max_by("attempt", "seq").alias("attempt"), F.max("seq").alias("seq"))
        return last.where("attempt is not null")

    def table(self, name: str, as_of: int | None = None) -> DataFrame:
        """The rows of all runs, with seq; attempts that are none's are passed over by their folders."""
        rows = self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/data/{name}")
        return rows.join(self.current(as_of), ["run_id", "attempt"]).drop("attempt")

    def runs(self) -> DataFrame:
        """The runs, newest first."""
        return self.table("run").drop("seq").orderBy(F.desc("started_at"), "run_id")

    def cases(self) -> DataFrame:
        """Each case of a dataset once, as the run that was committed last has it."""
        w = Window.partitionBy("dataset", "case_id").orderBy(F.desc("seq"), F.desc("case_order"))
        return self.table("cases").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "seq")

    def _attempt(self, run_id: str) -> str:
        found = self.current().where(F.col("run_id") == run_id).first()
        if found is None:
            raise ValueError(f"unknown run: {run_id}")
        return found["attempt"]

    def detail(self, run_id: str) -> DataFrame:
        """The cases of a run with what was found for each, as arrays: a scan of one folder."""
        return self.spark.read.parquet(f"{self.root}/data/details/attempt={self._attempt(run_id)}").where(F.col("run_id") == run_id)

    def page(self, run_id: str, size: int, after: tuple[int, str] | None = None) -> DataFrame:
        """The next cases of a run in the order of case_order and case_id, after the last one seen; no rows before it are read again and sorted."""
        rows = self.detail(run_id)
        if after is not None:
            rows = rows.where((F.col("case_order") > after[0]) | (F.col("case_order") == after[0]) & (F.col("case_id") > after[1]))
        return rows.orderBy("case_order", "case_id").limit(size)

    def artifact(self, run_id: str, name: str) -> str:
        """Where a run's artifact of that file name is; of several the newest."""
        rows = self.spark.read.parquet(f"{self.root}/data/artifacts/attempt={self._attempt(run_id)}")
        found = rows.where(F.endswith("uri", F.lit("/" + name))).orderBy(F.desc("created_at"), "uri").first()
        if found is None:
            raise ValueError(f"unknown artifact of the run: {name}")
        return found["uri"]

    def vacuum(self) -> list[str]:
        """Deletes the attempts that are no run's; none may be under way."""
        kept, gone = {r["attempt"] for r in self.current().select("attempt").collect()}, []  # a row for each run
        path, fs = self._path("data")
        for table in fs.listStatus(path) if fs.exists(path) else []:
            for folder in fs.listStatus(table.getPath()):
                if folder.getPath().getName().removeprefix("attempt=") not in kept:
                    fs.delete(folder.getPath(), True)
                    gone.append(folder.getPath().toString())
        return gone


def nested(tables: dict[str, DataFrame]) -> DataFrame:
    """The cases with an array for each table that has rows of them, ordered as CHILD_ORDER says; a case's rows are a few."""
    out = tables["cases"]
    for name, order in CHILD_ORDER.items():
        if name not in tables:
            continue
        rows = tables[name]
        own = [c for c in (*order, *[c for c in rows.columns if c not in order]) if c not in ("run_id", "case_id")]
        lists = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name))
        out = out.join(lists, "case_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: bool = True, order: Callable[[], Column] | None = None) -> DataFrame:
    """The old rows and the new; where a key is in both the new row stays (update), or the old one. Of several new rows with a key the first in order.

    Columns that only one side has are null on the other.
    """
    w = Window.partitionBy(*keys).orderBy(order() if order else F.hash(*[F.col(c) for c in new.columns]))
    new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    if update:
        return old.join(new, same(old, new), "left_anti").unionByName(new, allowMissingColumns=True)
    return old.unionByName(new.join(old, same(new, old), "left_anti"), allowMissingColumns=True)
