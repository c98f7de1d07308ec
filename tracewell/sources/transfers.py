"""Transfer tables: readers, and derivations from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.schema import FLAT, TRANSFERS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def event_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event pays the user of the next event: small, dense and cyclic."""
    e = _table(spark, sf_dir, "events")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("next_user"))
    return e.join(after, "event_id").select(
        F.concat(F.lit("E"), "event_id").alias("tx_hash"), F.col("event_id").alias("block_number"), epoch(F.col("ts")).alias("ts"),
        F.concat(F.lit("U"), "user_id").alias("from_address"), F.concat(F.lit("U"), "next_user").alias("to_address"), F.col("value"),
        (F.col("event_type") == "click").alias("is_contract_call"), F.col("event_type").alias("method_id"),
    )


def purchase_transfers(spark: SparkSession, sf_dir: str, least: float = 100.0) -> DataFrame:
    """Sparse: purchases of at least ``least`` between different users."""
    return event_transfers(spark, sf_dir).where((F.col("method_id") == "purchase") & (F.col("value") >= least) & (F.col("from_address") != F.col("to_address")))


def trade_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large and bipartite: customers pay suppliers for line items; value is exact to four places."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    value = F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)"))
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", epoch(F.col("l_shipdate")).cast("long")).alias("tx_hash"), F.col("l_orderkey").alias("block_number"),
        epoch(F.col("l_shipdate")).alias("ts"), F.concat(F.lit("C"), "o_custkey").alias("from_address"), F.concat(F.lit("S"), "l_suppkey").alias("to_address"),
        value.cast("decimal(22,4)").alias("value"), F.lit(False).alias("is_contract_call"), F.lit("").alias("method_id"),
    )


class TransferSource:
    """Where transfers come from; ``load`` gives the TRANSFERS columns."""

    def load(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError


class ParquetTransfers(TransferSource):
    def __init__(self, path: str):
        self.path = path

    def load(self, spark: SparkSession) -> DataFrame:
        return canonical(spark.read.parquet(self.path))


class CsvTransfers(TransferSource):
    """Flat rows with a header, as exported by the load stage."""

    def __init__(self, path: str):
        self.path = path

    def load(self, spark: SparkSession) -> DataFrame:
        flat = spark.read.schema(FLAT).option("header", True).csv(self.path)
        ts = F.coalesce(F.try_to_timestamp("timestamp").cast("double"), F.lit(0.0))
        return canonical(flat.select("tx_hash", "block_number", ts.alias("ts"), "from_address", "to_address", F.col("value_eth").cast("double").alias("value"), F.coalesce("is_contract_call", F.lit(False)).alias("is_contract_call"), F.lit("").alias("method_id")))


class JsonTransfers(TransferSource):
    def __init__(self, path: str):
        self.path = path

    def load(self, spark: SparkSession) -> DataFrame:
        return canonical(spark.read.schema(TRANSFERS).json(self.path))


class FirstAvailable(TransferSource):
    """The first source that has a row; the last if none has."""

    def __init__(self, *sources: TransferSource):
        self.sources = sources

    def load(self, spark: SparkSession) -> DataFrame:
        for source in self.sources[:-1]:
            if not (found := source.load(spark)).isEmpty():
                return found
        return self.sources[-1].load(spark)


def canonical(rows: DataFrame) -> DataFrame:
    """Addresses lower-cased and trimmed, empty ones null; rows without either address go."""
    address = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    out = rows.withColumns({"from_address": address("from_address"), "to_address": address("to_address")})
    return out.where("from_address is not null or to_address is not null").select(*TRANSFERS.fieldNames())


#: The same tables for DuckDB.
EV = """ev AS (SELECT 'E' || a.event_id AS tx_hash, a.event_id AS block_number, epoch(a.ts) AS ts, 'U' || a.user_id AS from_address, 'U' || b.user_id AS to_address, a.value AS value,
 a.event_type = 'click' AS is_contract_call, a.event_type AS method_id FROM events a JOIN events b ON b.event_id = a.event_id + 1)"""
HV = EV + ", hv AS (SELECT * FROM ev WHERE method_id = 'purchase' AND value >= 100 AND from_address <> to_address)"
TR = """tr AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch(l_shipdate)::BIGINT) AS tx_hash, l_orderkey AS block_number, epoch(l_shipdate) AS ts,
 'C' || o_custkey AS from_address, 'S' || l_suppkey AS to_address, (CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))::DECIMAL(22,4) AS value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
