"""What the application's pages and files show: ids, texts, paths, run tables, cluster upkeep, owner lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import owner_addresses
from tracewell.operators.etl import upsert
from tracewell.operators.relational import top_per_group
from tracewell.sources.storage import cut

#: Names of layering methods, and what a report says of the strongest one.
METHODS = {
    "peeling_chain": "Peeling chains",
    "mixing_interaction": "Mixing & anonymity tool interaction",
    "bridge_hopping": "Cross-chain & bridge hopping",
    "shell_wallet_network": "Shell wallet networks",
    "high_depth_transaction_chaining": "High-depth transaction chaining",
}
#: The first sentence on an entity, by its strongest method.
FIRST_SENTENCES = {
    "peeling_chain": "Peeling chains dominate this entity, with value repeatedly shaved into smaller follow-on transfers.",
    "mixing_interaction": "Mixing and anonymity-tool interaction is the dominant layering signal around this entity.",
    "bridge_hopping": "Cross-chain and bridge hopping is the dominant signal, suggesting the flow re-entered after bridge use.",
    "shell_wallet_network": "Shell wallet network behavior dominates here, with funds cycling through a tightly connected wallet set.",
    "high_depth_transaction_chaining": "High-depth transaction chaining dominates here, with funds forwarded through long value-retaining hops.",
}
SECOND, SECOND_SHARE = 0.45, 0.72


def digest_id(prefix: str, seed: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha1(seed), 1, digits)))


def run_id(prefix: str, at: Column) -> Column:
    """PREFIX-yyyyMMddHHmmss-digest of a time's ISO text in UTC."""
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    iso = F.regexp_replace(iso, r"\.000000", "")
    return F.concat(F.lit(prefix + "-"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), F.upper(F.substring(F.sha1(iso), 1, 8)))


def evidence_id(entity: Column, detector: Column, ordinal: Column) -> Column:
    return digest_id("LEV", F.concat_ws("|", entity, detector, ordinal.cast("string")), 12)


def representative(cluster_id: Column, addresses: Column) -> Column:
    """The address of a cluster that its id's digest picks."""
    at = F.conv(F.substring(F.sha1(cluster_id), 1, 8), 16, 10).cast("long") % F.size(addresses)
    return F.get(addresses, at.cast("int"))


def location(*parts: Column) -> Column:
    """The parts that are not empty, joined by commas."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")


def humanised(method: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    return F.coalesce(known[F.trim(method)], F.initcap(F.trim(F.regexp_replace(method, "_", " "))))


def ranked_methods(hits: DataFrame) -> DataFrame:
    """(entity, methods, primary, second, strong_second) of (entity, method, score): best first; the second is strong at 0.45 and 0.72 of the first, on either scale of scores."""
    own = hits.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("score", "method")), asc=False).alias("s"))
    first, second = F.get("s", 0), F.get("s", 1)
    scale = F.when(first["score"] > 1, 10.0).otherwise(1.0)
    strong = (first["score"] > 0) & (second["score"] > 0) & (second["score"] >= SECOND * scale) & (second["score"] >= SECOND_SHARE * first["score"])
    return own.select("entity", F.transform("s", lambda x: x["method"]).alias("methods"), first["method"].alias("primary"), second["method"].alias("second"), F.coalesce(strong, F.lit(False)).alias("strong_second"))


def narrative(ranked: DataFrame, behaviors: DataFrame, pairs: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """(entity, text): what stands out, with ``behaviors`` (entity, behavior, rank), bridge ``pairs`` (entity, n) and detectors' ``reasons`` (entity, reasons array).

    The first reason that is not blank ends the text, unless the text says it already in whatever case; where no method is known it is the text.
    """
    named = behaviors.where("rank <= 2").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("rank", "behavior"))).alias("b"))
    rows = ranked.join(named, "entity", "left").join(pairs.select("entity", F.col("n").alias("pairs")), "entity", "left")
    if reasons is None:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))
    else:
        cleaned = F.filter(F.transform("reasons", lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
        rows = rows.join(reasons.select("entity", F.get(cleaned, 0).alias("reason")), "entity", "full")
    first = F.create_map(*[F.lit(x) for kv in FIRST_SENTENCES.items() for x in kv])[F.trim("primary")]
    parts = [
        F.coalesce(first, F.concat(humanised(F.col("primary")), F.lit(" is the dominant layering signal for this entity."))),
        F.when(F.col("strong_second"), F.concat(humanised(F.col("second")), F.lit(" also scores strongly enough to reinforce the same alert."))),
        F.when(F.size("b") > 0, F.concat(F.lit("Placement seeding for this entity was already linked to "), F.array_join(F.transform("b", lambda x: F.trim(F.regexp_replace(x["behavior"], "_", " "))), ", "), F.lit("."))),
        F.when(F.col("pairs") == 1, F.lit("1 bridge-linked transfer pair supports the trace.")).when(F.col("pairs") > 1, F.concat(F.col("pairs").cast("string"), F.lit(" bridge-linked transfer pairs support the trace."))),
    ]
    said = F.concat_ws(" ", *parts)
    more = F.when(~F.lower(said).contains(F.lower("reason")), F.col("reason"))
    return rows.select("entity", F.when(F.col("primary").isNull(), F.col("reason")).otherwise(F.concat_ws(" ", said, more)).alias("text"))


def paths(edges: DataFrame, starts: DataFrame, hops: int, directed: bool = True, least: float | None = None, most: int | None = None) -> DataFrame:
    """(start, nodes, hashes, total) of walks of 1 to ``hops`` edges (a, b, tx_hash, value) from ``starts`` (node), no edge twice.

    ``least`` is asked of every edge, before walks are made; ``most`` keeps the walks of least length (ties: by hashes), a report's limit: as a walk's beginning is
    no longer than the walk and comes first, each length needs no more than ``most`` of them in all, and steps end once there are as many.
    """
    step = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "tx_hash", "value")
    step = step if least is None else step.where(F.col("value") >= least)
    if not directed:
        step = step.unionByName(step.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "tx_hash", "value"))
    front = starts.select(F.col("node").alias("start"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("hashes"), F.lit(0).cast("decimal(18,2)").alias("total"))
    order = [F.size("hashes"), F.array_join("hashes", ">")]
    found, held = None, 0
    for hop in range(hops):
        grown = front.join(step, F.element_at("nodes", -1) == F.col("u")).where(~F.array_contains("hashes", F.col("tx_hash")))
        front = cut(grown.select("start", F.concat("nodes", F.array("v")).alias("nodes"), F.concat("hashes", F.array("tx_hash")).alias("hashes"), (F.col("total") + F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)").alias("total")))
        found = front if found is None else found.unionByName(front)
        if most is not None and hop + 1 < hops and (held := held + front.count()) >= most:
            break
    found = found.select("start", "nodes", "hashes", F.col("total").cast("double").alias("total"))
    return found if most is None else found.orderBy(*order).limit(most)


def edges_of(transfers: DataFrame, addresses: DataFrame, most: int = 200) -> DataFrame:
    """The newest ``most`` transfers (ties: by hash) with an end among ``addresses`` (address)."""
    known = addresses.select("address").distinct()
    near = transfers.join(known.withColumnRenamed("address", "from_address"), "from_address", "left_semi").unionByName(transfers.join(known.withColumnRenamed("address", "to_address"), "to_address", "left_semi").select(*transfers.columns))
    return near.dropDuplicates(["tx_hash"]).orderBy(F.desc("block_number"), "tx_hash").limit(most)


def save_run(table: DataFrame, path: str, run: str) -> None:
    """One run's rows as a partition of the table at ``path``; the same run again replaces its own rows only."""
    table.withColumn("run_id", F.lit(run)).write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run)


def save_blocks(blocks: DataFrame, path: str, per_folder: int = 10_000) -> None:
    """Raw blocks as JSON, a folder for each range of ``per_folder`` block numbers, rows in order."""
    own = blocks.withColumn("block_range", F.floor(F.col("block_number") / per_folder))
    own.repartition("block_range").sortWithinPartitions("block_range", "block_number").write.partitionBy("block_range").mode("append").json(path)


def stage_rows(rows: DataFrame, staging: str, processed: str) -> None:
    """A batch as CSV in ``staging``, in place of the last one, and appended to ``processed``."""
    batch = cut(rows)
    batch.write.mode("overwrite").option("header", True).csv(staging)
    batch.write.mode("append").option("header", True).csv(processed)


def sync_clusters(old: DataFrame, found: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, stale, addresses): clusters (cluster_id, size) of ``found`` (address, cluster_id) with at least ``least`` members; ids of ``old`` (cluster_id) that are
    none of them; and every address with its cluster, null where that is too small."""
    clusters = found.groupBy("cluster_id").agg(F.countDistinct("address").alias("size")).where(F.col("size") >= least)
    stale = old.select("cluster_id").distinct().join(clusters, "cluster_id", "left_anti")
    kept = clusters.select("cluster_id", F.col("cluster_id").alias("kept"))
    return clusters, stale, found.join(kept, "cluster_id", "left").select("address", F.col("kept").alias("cluster_id"))


def owner_conflicts(owned: DataFrame, new: DataFrame) -> DataFrame:
    """(address, owner_id, held_by) of the addresses of ``new`` (owner_id, address) that another owner in ``owned`` holds."""
    return new.join(owned.select("address", F.col("owner_id").alias("held_by")), "address").where("owner_id <> held_by").select("address", "owner_id", "held_by")


def insert_owners(owned: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """``owned`` (owner_id, address, is_primary) with ``new`` added; addresses of other owners move to the new one with ``force``, else stay."""
    if force:
        return upsert(owned, new, ["address"])
    return owned.unionByName(new.join(owned.select("address"), "address", "left_anti").select(*owned.columns)).dropDuplicates(["address"])


def clean_owner_lists(lists: DataFrame) -> DataFrame:
    """(owner_id, address) of (owner_id, addresses array); an error for anything that is no address."""
    return lists.select("owner_id", F.explode(owner_addresses(F.col("addresses"))).alias("address")).distinct()


def heuristic_ranking(evidence: DataFrame) -> DataFrame:
    """(cluster_id, names): a cluster's heuristics (cluster_id, name, n), the most frequent first, ties to the greater name."""
    own = evidence.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("n", "name")), asc=False).alias("s"))
    return own.select("cluster_id", F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("names"))


def best_entity(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """(cluster_id, entity, shared): the entity (entity, address) with most of a cluster's (cluster_id, address) addresses; ties to the least."""
    met = clusters.join(entities, "address").groupBy("cluster_id", "entity").agg(F.countDistinct("address").alias("shared"))
    return top_per_group(met, ["cluster_id"], [F.desc("shared"), F.col("entity")], 1)


def named_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, name): an entity's own name in ``names`` (key, name), else that of its first address (entity, address) with one."""
    direct = entities.select("entity").distinct().join(names.select(F.col("key").alias("entity"), F.col("name").alias("own")), "entity", "left")
    via = entities.join(names.select(F.col("key").alias("address"), "name"), "address").groupBy("entity").agg(F.min_by("name", "address").alias("other"))
    return direct.join(via, "entity", "left").select("entity", F.coalesce("own", "other").alias("name"))


def strongest_hits(hits: DataFrame) -> DataFrame:
    """(entity, method, score, hashes): of hits (entity, method, score, hashes) that share entity and method the best score and all hashes."""
    return hits.groupBy("entity", "method").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes")))).alias("hashes"))


def run_counts(rows: DataFrame, column: str) -> DataFrame:
    """One row with a map of counts by ``column``: a run's summary."""
    return rows.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))


def utxo_transfers(raw: DataFrame) -> DataFrame:
    """(wallet, tx_hash, from_address, to_address, value, direction) of (wallet, txid, vin array<string>, vout array<struct<address, value>>): what outputs to the wallet hold, in coins; others go."""
    me = F.lower("wallet")
    into = F.filter("vout", lambda o: F.lower(o["address"]) == me)
    hit = (F.size(into) > 0) | F.exists("vin", lambda a: F.lower(a) == me)
    value = F.aggregate(into, F.lit(0).cast("long"), lambda t, o: t + o["value"]) / F.lit(100_000_000)
    out = raw.where(F.coalesce(hit, F.lit(False)))
    return out.select("wallet", F.col("txid").alias("tx_hash"), F.coalesce(F.lower(F.get("vin", 0)), F.lit("")).alias("from_address"), F.when(F.size(into) > 0, F.col("wallet")).alias("to_address"), value.alias("value"), F.when(F.size(into) > 0, "in").otherwise("out").alias("direction"))


def lamport_transfers(raw: DataFrame) -> DataFrame:
    """(wallet, tx_hash, from_address, value, direction) of (wallet, signature, keys, pre, post): the change of the first account's balance, in coins."""
    change = F.coalesce(F.get("post", 0), F.lit(0)) - F.coalesce(F.get("pre", 0), F.lit(0))
    return raw.select("wallet", F.col("signature").alias("tx_hash"), F.coalesce(F.get("keys", 0), F.lit("")).alias("from_address"), (F.abs(change) / F.lit(1_000_000_000)).alias("value"), F.when(change > 0, "in").otherwise("out").alias("direction"))


def feed_addresses(feed: DataFrame, text: str) -> DataFrame:
    """(address, chain) of the addresses in free text, each once; the chain goes by how it begins."""
    found = F.concat(F.regexp_extract_all(F.col(text), F.lit("(0x[a-fA-F0-9]{40})")), F.regexp_extract_all(F.col(text), F.lit(r"\b((?:bc1|[13])[a-zA-HJ-NP-Z0-9]{20,90})\b")))
    chain = F.when(F.col("address").startswith("0x"), "ethereum").when(F.col("address").rlike("^(bc1|1|3)"), "bitcoin").otherwise("global")
    return feed.select(F.explode(found).alias("address")).distinct().withColumn("chain", chain)
