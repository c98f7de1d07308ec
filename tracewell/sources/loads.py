"""Exports of flat rows, scans by time, and the choice of a source by what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.scalar import any_timestamp
from tracewell.operators.etl import keep_latest
from tracewell.schema import FLAT
from tracewell.sources.transfers import TransferSource

#: Where a row stands in the files of an export.
PLACE = ["file", "block_start", "line"]


def read_export(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The columns of FLAT as text, and PLACE, of CSV files with headers; an error that names the columns which are missing. ``limit`` takes that many rows, any ones."""
    rows = spark.read.option("header", True).csv(path)
    if missing := [c for c in FLAT.fieldNames() if c not in rows.columns]:
        raise ValueError(f"{path} is missing columns: {missing}")
    rows = rows.select(*FLAT.fieldNames(), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line"))
    return rows if limit is None else rows.limit(limit)


def _flag(x: Column) -> Column:
    text = F.lower(F.trim(x))
    return F.coalesce(F.when(text.isin("true", "false"), (text == "true").cast("int")), text.try_cast("double").cast("int"), F.lit(0))


def prepare_rows(rows: DataFrame, order: list[str] = PLACE) -> tuple[DataFrame, DataFrame]:
    """(prepared, counts) of an export's rows.

    Unreadable times are null, unreadable flags and amounts 0; amounts are plain text of 18 places, read exactly. Rows without a hash, or a blank one, go;
    of one hash the last row by ``order`` stays. counts: (rows, blank, repeated, kept), how many of each.
    """
    kept = rows.where("trim(tx_hash) <> ''")
    last = keep_latest(kept, ["tx_hash"], order)
    amount = F.coalesce(F.trim("value_eth").try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)")).cast("decimal(38,18)")
    # a decimal of 18 places that is 0 or tiny prints with an exponent as text, digits don't
    ready = last.select(
        "tx_hash", F.col("block_number").try_cast("long").alias("block_number"), any_timestamp(F.col("timestamp")).alias("timestamp"), "from_address", "to_address",
        F.regexp_replace(F.format_number(amount, 18), ",", "").alias("value_eth"), _flag(F.col("is_contract_call")).alias("is_contract_call"), F.col("gas_used").try_cast("long").alias("gas_used"), F.col("status").try_cast("int").alias("status"),
    )
    blank = F.coalesce(F.trim("tx_hash") == "", F.lit(True))
    counts = rows.agg(F.count("*").alias("rows"), F.count(F.when(blank, 1)).alias("blank"), F.countDistinct(F.when(~blank, F.col("tx_hash"))).alias("kept"))
    return ready, counts.select("rows", "blank", (F.col("rows") - F.col("blank") - F.col("kept")).alias("repeated"), "kept")


def scan_since(docs: DataFrame, since=None) -> DataFrame:
    """FLAT_DOC documents of blocks later than ``since`` (a time; all if none), those without a readable time only if there is none."""
    if since is None:
        return docs
    return docs.where(F.try_to_timestamp(F.col("block.timestamp")) > F.lit(since).cast("timestamp"))


def write_lines(docs: DataFrame, path: str) -> None:
    """Documents as lines of JSON, in order of block and place within each file; files are ranges of blocks."""
    docs.repartitionByRange("block.number").sortWithinPartitions("block.number", "forensics.transaction_index").write.mode("overwrite").json(path)


def resolve_source(spark: SparkSession, sources: dict[str, TransferSource], prefer: str | None = None) -> tuple[str | None, DataFrame | None, dict[str, int]]:
    """(name, rows, counts): the first source with rows, ``prefer`` before the others in their order; rows counted of each that was asked. (None, None, counts) if none has any."""
    counts = {}
    for name in sorted(sources, key=lambda n: n != prefer):
        rows = sources[name].load(spark)
        counts[name] = rows.count()
        if counts[name]:
            return name, rows, counts
    return None, None, counts
