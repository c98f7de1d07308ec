"""Streams with state of their own: a watchlist that runs off, and persons of interest who stay so between two thresholds.

Each processor takes the rows of a key in order of time and keeps what the next batch needs, so that the output is that of the batch
query (``risk.screen_over_time``, ``risk.poi_history``) however the input, in order of time, is cut into batches. State lives in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators.risk import ENTER, FACTORS, LEAVE, STRONG

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """The session's state store, as processors with their own state need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Watch(StatefulProcessor):
    """Keeps the end of an address's last entry; with ``keep`` (milliseconds) no longer than that by the clock, if nothing renews it."""

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until double", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["at", "kind", "until"])
        held = self.until.get()[0] if self.until.exists() else None
        out, last = [], held
        for r in own.itertuples(index=False):
            if r.kind == 0:
                last = r.until
            elif last is not None and last > r.at:
                out.append((r.tx_hash, key[0], r.side))
        if last is not None and last <= own["at"].iloc[-1]:
            self.until.clear()
        elif last is not None and last != held:
            self.until.update((float(last),))
        yield pd.DataFrame(out, columns=["tx_hash", "address", "side"])

    def close(self) -> None:
        pass


class Poi(StatefulProcessor):
    """Keeps whether an entity is a person of interest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.is_poi = handle.getValueState("is_poi", "is_poi boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("at")
        state, out = self.is_poi.get()[0] if self.is_poi.exists() else False, []
        for r in own.itertuples(index=False):
            state = r.strong >= 2 and (r.risk >= ENTER or state and r.risk >= LEAVE)
            out.append((key[0], r.at, r.risk, bool(state)))
        self.is_poi.update((bool(state),))
        yield pd.DataFrame(out, columns=["entity", "at", "risk", "is_poi"])

    def close(self) -> None:
        pass


def screened_by_state(transfers: DataFrame, entries: DataFrame, keep_days: float | None = None) -> DataFrame:
    """(tx_hash, address, side) alerts of streams of transfers and of watchlist ``entries`` (address, added_at, expires_at).

    Both streams must come in order of time, batch by batch; within a batch rows are put in order. An entry's state goes with the first row of its address after its end.
    With ``keep_days`` state also ends by the clock, for streams that run on and addresses that are never seen again; such a stream doesn't end by itself.
    """
    with_state(transfers.sparkSession)
    ends = F.array(*[F.struct(F.col(f"{s}_address").alias("address"), F.lit(s).alias("side")) for s in ("from", "to")])
    sides = transfers.select("tx_hash", F.col("ts").alias("at"), F.explode(ends).alias("e")).select("tx_hash", "e.address", "e.side", "at", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("until"))
    known = entries.select(F.lit(None).cast("string").alias("tx_hash"), "address", F.lit(None).cast("string").alias("side"), F.col("added_at").alias("at"), F.lit(0).alias("kind"), F.col("expires_at").alias("until"))
    rows = sides.unionByName(known).where("address is not null")
    watch = Watch(None if keep_days is None else int(keep_days * 86_400_000))
    return rows.groupBy("address").transformWithStateInPandas(watch, "tx_hash string, address string, side string", "Append", "None" if keep_days is None else "ProcessingTime")


def poi_by_state(scored: DataFrame) -> DataFrame:
    """(entity, at, risk, is_poi) after each row of a stream of scores (entity, at, six factors, risk) in order of time."""
    with_state(scored.sparkSession)
    strong = sum(((F.coalesce(F.col(f), F.lit(0.0)) >= STRONG).cast("int") for f in FACTORS), F.lit(0))
    own = scored.select("entity", "at", "risk", strong.alias("strong"))
    return own.groupBy("entity").transformWithStateInPandas(Poi(), "entity string, at long, risk double, is_poi boolean", "Append", "None")
