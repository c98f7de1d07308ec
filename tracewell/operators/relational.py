"""Roll-ups of a transfer table by address, entity and pair.

A transfer touches two addresses. ``role_union`` gives a row for each, so that nothing needs a join on "from or to".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import exact_sum


def role_union(transfers: DataFrame) -> DataFrame:
    """(address, peer, role, and the transfer's columns): ``out`` for the sender, ``in`` for the receiver; self transfers give both."""
    rest = [c for c in transfers.columns if c not in ("from_address", "to_address")]
    out = transfers.select(F.col("from_address").alias("address"), F.col("to_address").alias("peer"), F.lit("out").alias("role"), *rest)
    back = transfers.select(F.col("to_address").alias("address"), F.col("from_address").alias("peer"), F.lit("in").alias("role"), *rest)
    return out.unionByName(back).where("address is not null and address <> ''")


def _if(role: str, value: str | Column = "value") -> Column:
    return F.when(F.col("role") == role, value if isinstance(value, Column) else F.col(value))


def address_rollup(transfers: DataFrame) -> DataFrame:
    """Per address: contract flag, first and last time, sums in and out, count of sides (a self transfer counts twice)."""
    return role_union(transfers).groupBy("address").agg(
        F.max(F.when(F.col("role") == "in", F.col("is_contract_call")).otherwise(False).cast("int")).alias("is_contract"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.coalesce(exact_sum(_if("in")), F.lit(0.0)).alias("total_in"), F.coalesce(exact_sum(_if("out")), F.lit(0.0)).alias("total_out"), F.count("*").alias("tx_count"),
    )


def address_degree(transfers: DataFrame) -> DataFrame:
    """Per address: times, count of sides, distinct neighbours other than itself."""
    return role_union(transfers).groupBy("address").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("tx_count"), F.countDistinct(F.when(F.col("peer") != F.col("address"), F.col("peer"))).alias("degree"))


def with_entities(transfers: DataFrame, members: DataFrame) -> DataFrame:
    """Transfers with both ends' entities; ``members``: (address, entity)."""
    a = members.select(F.col("address").alias("from_address"), F.col("entity").alias("from_entity"))
    b = members.select(F.col("address").alias("to_address"), F.col("entity").alias("to_entity"))
    return transfers.join(a, "from_address").join(b, "to_address")


def some_hashes(rows: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """(keys, ``name``): the first ``most`` distinct hashes of each key, in order. They are cut before the shuffle, so a hot key sends no more than that from each task."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("tx_hash"))
    first = rows.select(*keys, "tx_hash").withColumn("_place", place).where(F.col("_place") <= most)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_set("tx_hash")).alias(name))


def entity_edges(transfers: DataFrame, members: DataFrame, most: int = 20) -> DataFrame:
    """(src, dst): sum, count, times and the first ``most`` hashes of transfers between different entities."""
    own = with_entities(transfers, members).where("from_entity <> to_entity").select(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst"), "value", "ts", "tx_hash")
    sums = own.groupBy("src", "dst").agg(exact_sum("value").alias("total"), F.count("*").alias("tx_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return sums.join(some_hashes(own, ["src", "dst"], most, "tx_hashes"), ["src", "dst"])


def entity_profile(transfers: DataFrame, members: DataFrame) -> DataFrame:
    """Per entity: transfers and sums in, out and within, distinct counterparties, first and last time."""
    own = with_entities(transfers, members)
    rows = []
    for entity, peer, role in (("from_entity", "to_entity", "out"), ("to_entity", "from_entity", "in")):
        rows.append(own.where("from_entity <> to_entity").select(F.col(entity).alias("entity"), F.col(peer).alias("peer"), F.lit(role).alias("role"), "value", "ts"))
    rows.append(own.where("from_entity = to_entity").select(F.col("from_entity").alias("entity"), F.lit(None).cast("string").alias("peer"), F.lit("within").alias("role"), "value", "ts"))
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    counts = [F.count(_if(r)).alias(f"n_{r}") for r in ("in", "out", "within")]
    sums = [F.coalesce(exact_sum(_if(r)), F.lit(0.0)).alias(f"sum_{r}") for r in ("in", "out", "within")]
    return every.groupBy("entity").agg(*counts, *sums, F.countDistinct("peer").alias("counterparties"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def cluster_graph(transfers: DataFrame, members: DataFrame) -> DataFrame:
    """Undirected volumes between entities, (a, b) with a < b."""
    own = with_entities(transfers, members).where("from_entity <> to_entity")
    return own.groupBy(F.least("from_entity", "to_entity").alias("a"), F.greatest("from_entity", "to_entity").alias("b")).agg(exact_sum("value").alias("volume"), F.count("*").alias("tx_count"))


def entity_tx_stats(transfers: DataFrame, members: DataFrame) -> DataFrame:
    """Transfers that touch an entity: count, times, sum. "From or to" as two equi-joins; a transfer within counts twice."""
    return role_union(transfers).join(members, "address").groupBy("entity").agg(F.count("*").alias("tx_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), exact_sum("value").alias("total"))


def exposure(transfers: DataFrame, members: DataFrame, risky: DataFrame) -> DataFrame:
    """Share of what an entity receives from ``risky`` (entity) ones; 0 if it receives under 0.01."""
    own = with_entities(transfers, members).where("from_entity <> to_entity").join(risky.select(F.col("entity").alias("from_entity"), F.lit(True).alias("is_risky")), "from_entity", "left")
    sums = own.groupBy(F.col("to_entity").alias("entity")).agg(F.coalesce(exact_sum(F.when(F.col("is_risky"), F.col("value"))), F.lit(0.0)).alias("risky"), exact_sum("value").alias("total"))
    return sums.select("entity", "risky", "total", F.when(F.col("total") < 0.01, 0.0).otherwise(F.round(F.col("risky") / F.greatest(F.col("total"), F.lit(1e-9)), 6)).alias("exposure"))


def variation(value: Column) -> Column:
    """Population deviation over mean of the positive values, 0 for fewer than two."""
    own = F.when(value > 0, value)
    return F.when(F.count(own) < 2, 0.0).otherwise(F.stddev_pop(own) / F.greatest(F.avg(own), F.lit(1e-9)))


def latest_run(runs: DataFrame, by: str = "completed_at", then: str = "run_id") -> DataFrame:
    return runs.orderBy(F.col(by).desc_nulls_last(), F.col(then).desc()).limit(1)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
