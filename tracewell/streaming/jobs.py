"""Micro-batch jobs over a folder of transfer files. Progress is the query's checkpoint; each run takes what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.scalar import exact_sum
from tracewell.operators.etl import keep_latest
from tracewell.operators.relational import role_union
from tracewell.operators.risk import screen
from tracewell.schema import TRANSFERS
from tracewell.sources.tables import KeyedStore


def read_transfers(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TRANSFERS).parquet(path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each new batch once through ``handle``, then stop: a scheduled run."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_transfers(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Transfers once a hash, however often they are delivered within ``late``."""
    return stream.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["tx_hash"])


def screened(stream: DataFrame, watchlist: DataFrame, now: float) -> DataFrame:
    """Watchlist alerts of a stream: stream-static joins."""
    return screen(stream, watchlist, now)


def windowed_rollup(stream: DataFrame, width: str = "12 hours", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(address, window): sides and sums in sliding windows; rows later than ``late`` are left out."""
    sides = role_union(stream).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", late)
    return sides.groupBy("address", F.window("event_time", width, step)).agg(F.count("*").alias("n"), exact_sum("value").alias("total"))


def keyed_store(spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = 64) -> KeyedStore:
    """The table that ``keyed_table`` keeps at ``path``."""
    return KeyedStore(spark, path, {"rows": (schema, key)}, buckets)


def keyed_table(path: str, key: list[str], by: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A handler that keeps one row a key in the table at ``path``: the greatest by ``by`` of what is there and each batch.

    A batch reads and writes the buckets of its own keys. One that is delivered again, after a failure or out of a lost executor, gives the same table.
    """

    def handle(batch: DataFrame, number: int) -> None:
        store = keyed_store(batch.sparkSession, path, batch.schema, key, buckets)
        if number > store.last()[0]:
            near = store.touched("rows", batch)
            store.commit(number, {"rows": (keep_latest(store.read("rows", near).unionByName(batch), key, by), near)})

    return handle
