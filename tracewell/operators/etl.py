"""Extract and load steps: flattening, cleaning, keyed replacement, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import hex_to_long, wei_to_eth


def keep_latest(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One row a key: the greatest by ``by`` in turn, nulls least."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in by])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; of several new ones the greatest."""
    fresh = keep_latest(new, key, [c for c in new.columns if c not in key])
    return old.join(fresh, key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def replace_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks that ``new`` holds are replaced whole, so rows gone from them disappear."""
    return old.join(new.select("block_number").distinct(), "block_number", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def flatten_blocks(blocks: DataFrame) -> DataFrame:
    """One row a transaction of RAW_BLOCK documents, with its receipt; a hash counts once a block."""
    tx = blocks.select("block_number", F.col("fetched_at"), F.explode("transactions").alias("t")).select("block_number", "fetched_at", "t.*")
    receipts = blocks.select("block_number", F.posexplode("receipts").alias("pos", "r")).select("block_number", "pos", F.lower("r.transactionHash").alias("tx_hash"), F.col("r.status").alias("status"), F.col("r.gasUsed").alias("gas_used"))
    receipts = keep_latest(receipts, ["block_number", "tx_hash"], ["pos"]).drop("pos")
    flat = tx.select(
        F.lower("hash").alias("tx_hash"), "block_number", F.nullif(F.lower(F.trim("from")), F.lit("")).alias("from_address"), F.nullif(F.lower(F.trim("to")), F.lit("")).alias("to_address"),
        wei_to_eth(F.col("value")).alias("value_eth"), F.substring(F.coalesce("input", F.lit("0x")), 1, 10).alias("method_id"), (F.length(F.coalesce("input", F.lit("0x"))) - 2).alias("input_size"),
        ((F.coalesce("input", F.lit("0x")) != "0x") | F.col("to").isNull()).alias("is_contract_call"),
    ).where("tx_hash is not null and tx_hash <> ''").dropDuplicates(["block_number", "tx_hash"])
    return flat.join(receipts, ["block_number", "tx_hash"], "left").withColumns({"status": hex_to_long(F.col("status")).cast("int"), "gas_used": hex_to_long(F.col("gas_used"))})


def complete_blocks(headers: DataFrame, flat: DataFrame) -> DataFrame:
    """(block_number, use_flat): flat rows serve if there are as many as the header expects, or any if it doesn't say."""
    n = flat.groupBy("block_number").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.lit(0))
    return headers.join(n, "block_number", "left").select("block_number", F.when(F.col("transaction_count").isNull(), found > 0).otherwise(found == F.col("transaction_count")).alias("use_flat"))


def incremental(rows: DataFrame, sink: DataFrame) -> DataFrame:
    """Rows of blocks beyond the sink's highest; all if it is empty."""
    mark = sink.agg(F.coalesce(F.max("block_number"), F.lit(-1)).alias("mark"))
    return rows.join(F.broadcast(mark), F.col("block_number") > F.col("mark")).drop("mark")


def sync_report(rows: DataFrame, sink: DataFrame) -> DataFrame:
    """(synced, already, total) of an ``incremental`` load: rows that are new, rows of blocks that the sink has reached, and what it holds after it."""
    new = incremental(rows, sink).agg(F.count("*").alias("synced"))
    there = sink.agg(F.count("*").alias("held"), F.max("block_number").alias("mark"))
    already = rows.join(F.broadcast(there.select("mark")), F.col("block_number") <= F.col("mark")).agg(F.count("*").alias("already"))
    return new.crossJoin(already).crossJoin(there).select("synced", "already", (F.col("held") + F.col("synced")).alias("total"))
