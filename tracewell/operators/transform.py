"""The transform job: blocks that wait are taken in order, a batch at a time, flattened from whichever source has them whole, and committed with a mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.etl import complete_blocks, flatten_blocks, keep_latest, replace_blocks
from tracewell.schema import BLOCK_MARKS, TRANSFERS
from tracewell.schema import TRANSFORMED as ROWS
from tracewell.sources.storage import materialise
from tracewell.sources.tables import KeyedStore

#: Blocks that share a bucket of the table, so that a batch of successive blocks rewrites few.
RANGE = 10_000


def flat_rows(docs: DataFrame) -> DataFrame:
    """The columns of ROWS of FLAT_DOC documents, addresses and method ids lower-cased and trimmed; those without either address go."""
    clean = lambda c: F.lower(F.trim(c))
    own = docs.select(
        F.col("block.number").alias("block_number"), "tx_hash", F.nullif(clean("address_pair.from"), F.lit("")).alias("from_address"), F.nullif(clean("address_pair.to"), F.lit("")).alias("to_address"), F.coalesce("value.eth", F.lit(0.0)).alias("value_eth"),
        F.coalesce("forensics.is_contract", F.lit(False)).alias("is_contract_call"), F.coalesce(clean("forensics.method_id"), F.lit("")).alias("method_id"), F.lit("flat").alias("derived"), F.col("block.timestamp").alias("timestamp"),
    )
    return own.where("from_address is not null or to_address is not null")


def flat_document_transfers(docs: DataFrame) -> DataFrame:
    """TRANSFERS rows of FLAT_DOC documents; an unreadable time is 0."""
    own = flat_rows(docs).withColumns({"ts": F.coalesce(F.try_to_timestamp("timestamp").cast("double"), F.lit(0.0)), "value": F.col("value_eth"), "block_number": F.coalesce("block_number", F.lit(0))})
    return own.select(*TRANSFERS.fieldNames())


def pending_blocks(headers: DataFrame, done: DataFrame, size: int, start: int | None = None, end: int | None = None, after: int | None = None) -> DataFrame:
    """The next ``size`` of ``headers`` (block_number, ...) by number that are not in ``done`` (block_number), from ``start``, or beyond ``after`` where that is given, to ``end``."""
    least = F.lit(True) if start is None and after is None else F.col("block_number") > after if after is not None else F.col("block_number") >= start
    most = F.lit(True) if end is None else F.col("block_number") <= end
    return headers.where(least & most).join(done.select("block_number"), "block_number", "left_anti").orderBy("block_number").limit(size)


def transform_rows(headers: DataFrame, flat: DataFrame, raw: DataFrame) -> DataFrame:
    """ROWS of the blocks in ``headers`` (block_number, transaction_count): from FLAT_DOC documents where all that the header expects are there, else anew from RAW_BLOCK ones.

    Of several raw documents of one block the last fetched counts; a block without raw documents gives no rows then.
    """
    own = flat.join(headers.select(F.col("block_number").alias("k")), F.col("block.number") == F.col("k"), "left_semi")
    which = complete_blocks(headers.select("block_number", "transaction_count"), own.select(F.col("block.number").alias("block_number")))
    whole, rest = which.where("use_flat").select("block_number"), which.where("not use_flat").select("block_number")
    again = flatten_blocks(keep_latest(raw.join(rest, "block_number", "left_semi"), ["block_number"], ["fetched_at"])).withColumns({"value_eth": F.col("value_eth").cast("double"), "method_id": F.lower("method_id"), "derived": F.lit("raw")})
    names = [c for c in ROWS.fieldNames() if c != "block_range"]
    rows = flat_rows(own).join(whole, "block_number", "left_semi").select(*names).unionByName(again.select(*names))
    return rows.select(F.floor(F.col("block_number") / RANGE).alias("block_range"), *names)


def transform_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedStore:
    """Where ``transform`` keeps its rows and the blocks that are done."""
    return KeyedStore(spark, path, {"rows": (ROWS, ["block_range"]), "blocks": (BLOCK_MARKS, ["block_range"])}, buckets)


def transform(store: KeyedStore, headers: DataFrame, flat: DataFrame, raw: DataFrame, size: int = 300, start: int | None = None, end: int | None = None, most: int | None = None) -> int:
    """Take pending blocks in batches of ``size`` until none is left, or ``most`` batches are done; how many were.

    A batch's rows and the marks of its blocks are one commit, so a run that is interrupted leaves whole batches and the next one goes on after them. A batch reads its own
    range of blocks, and the buckets of that range.
    """
    batches, after = 0, None
    while most is None or batches < most:
        batch = materialise(pending_blocks(headers, store.read("blocks"), size, start, end, after), "pending")
        low, high = batch.agg(F.min("block_number"), F.max("block_number")).first()
        if low is None:
            break
        inside = lambda c: F.col(c).between(low, high)  # noqa: B023, E731
        rows = materialise(transform_rows(batch, flat.where(inside("block.number")), raw.where(inside("block_number"))), "transformed")
        marks = batch.select(F.floor(F.col("block_number") / RANGE).alias("block_range"), "block_number")
        near = store.touched("blocks", marks)
        store.commit(store.last()[0] + 1, {"rows": (replace_blocks(store.read("rows", near), rows), near), "blocks": (store.read("blocks", near).unionByName(marks), near)})
        batches, after = batches + 1, high
    return batches
