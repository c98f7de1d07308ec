"""Tables that grow by commits: keyed rows in buckets of which a commit rewrites the touched ones, and runs of several tables that show once they are whole.

Both write their rows first and a manifest last. A reader goes by manifests only, so what a failed writer leaves is never seen, and the same commit or
run can be written again.
"""

from __future__ import annotations

import contextlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources.storage import drop, names_in, read_note, short_shuffles, write_note

class KeyedStore:
    """Named tables of keyed rows under one folder, each in ``buckets`` folders by a hash of its key, and one manifest for all.

    ``tables``: name -> (schema, key columns). A manifest has, for each table, the commit that last wrote each bucket: a few bytes a bucket on the driver.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[T.StructType, list[str]]], buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets

    def _manifests(self) -> list[str]:
        return [n for n in names_in(self.spark, f"{self.path}/manifest") if n.endswith(".json")]

    def _manifest(self, name: str) -> tuple[int, dict[str, dict[str, int]]]:
        return int(name.removesuffix(".json")), json.loads(read_note(self.spark, f"{self.path}/manifest/{name}"))

    def last(self) -> tuple[int, dict[str, dict[str, int]]]:
        """(number, manifest) of the last commit; (-1, {}) before the first."""
        found = self._manifests()
        return self._manifest(found[-1]) if found else (-1, {})

    def bucket(self, name: str, columns: list[str] | None = None):
        return F.pmod(F.xxhash64(*(columns or self.tables[name][1])), F.lit(self.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> list[int]:
        """The buckets of the keys of ``rows``, at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket(name, columns)).distinct().collect())

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """The committed rows, of all buckets or of some."""
        held = self.last()[1].get(name, {})
        paths = [f"{self.path}/{name}/commit={v}/bucket={b}" for b, v in held.items() if only is None or int(b) in only]
        schema = self.tables[name][0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, number: int, changes: dict[str, tuple[DataFrame, list[int]]]) -> None:
        """Replace buckets: name -> (all their rows, their numbers). Nothing happens if ``number`` is committed already. Versions older than the last commit's are deleted."""
        before, held = self.last()
        if number <= before:
            return
        now = {name: dict(held.get(name, {})) for name in self.tables}
        for name, (rows, buckets) in changes.items():
            own = rows.select(*self.tables[name][0].fieldNames()).withColumn("bucket", self.bucket(name))
            out = f"{self.path}/{name}/commit={number}"
            own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
            now[name] = {b: v for b, v in now[name].items() if int(b) not in buckets}
            now[name] |= {b.removeprefix("bucket="): number for b in names_in(self.spark, out) if b.startswith("bucket=")}
        write_note(self.spark, f"{self.path}/manifest/{number:012d}.json", json.dumps(now))
        # a reader may still hold the manifest before this one; what only an older one names can go, and so can that manifest
        older = self._manifests()[:-2]
        for found in map(self._manifest, older):
            for name, versions in found[1].items():
                used = {(b, v) for m in (held, now) for b, v in m.get(name, {}).items()}
                for b, v in set(versions.items()) - used:
                    drop(self.spark, f"{self.path}/{name}/commit={v}/bucket={b}")
        for name in older:
            drop(self.spark, f"{self.path}/manifest/{name}")


class RunStore:
    """Runs of one kind: each is a set of tables, written under its run id, and a manifest with their counts, written last."""

    RUNS = "run_id string, completed_at timestamp, counts map<string, long>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, run: str, completed_at, tables: dict[str, DataFrame]) -> None:
        """Write all tables of ``run``, then its manifest; the same run again replaces its own rows only. A run in work is out of sight."""
        drop(self.spark, f"{self.path}/manifest/run={run}")
        with short_shuffles(self.spark):
            for name, rows in tables.items():
                rows.write.mode("overwrite").parquet(f"{self.path}/{name}/run_id={run}")
            counts = {name: self.spark.read.parquet(f"{self.path}/{name}/run_id={run}").count() for name in tables}
        self.spark.createDataFrame([(run, completed_at, counts)], self.RUNS).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/run={run}")

    def runs(self) -> DataFrame:
        """(run_id, completed_at, counts) of whole runs."""
        with contextlib.suppress(AnalysisException):
            return self.spark.read.schema(self.RUNS).json(f"{self.path}/manifest")
        return self.spark.createDataFrame([], self.RUNS)

    def read(self, name: str, runs: DataFrame | None = None) -> DataFrame:
        """Rows of a table, with ``run_id``, of the whole runs, or of those in ``runs`` (run_id) that are whole. Folders of other runs aren't read."""
        known = self.runs() if runs is None else self.runs().join(runs.select("run_id"), "run_id", "left_semi")
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/run_id=*")
        return rows.withColumn("run_id", F.col("run_id").cast("string")).join(F.broadcast(known.select("run_id")), "run_id", "left_semi")

    def latest(self, until=None) -> DataFrame:
        """(run_id) of the last whole run, by completion (ties: the greater id), not after ``until``."""
        known = self.runs() if until is None else self.runs().where(F.col("completed_at") <= F.lit(until))
        return known.orderBy(F.col("completed_at").desc_nulls_last(), F.desc("run_id")).limit(1).select("run_id")
