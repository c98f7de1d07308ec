"""Wallet clusters from gated pairs, their indicators, evidence and owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.config import EngineConfig
from tracewell.functions.scalar import ascii_text, exact_sum, stable_id
from tracewell.operators.graph import connected_components
from tracewell.sources.storage import materialise
from tracewell.sources.tables import KeyedStore


def build_clusters(pairs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(address, cluster_id, size) of components with at least ``min_cluster_size`` members."""
    roots = connected_components(pairs.select("a", "b"))
    named = roots.groupBy("root").agg(stable_id("C-", F.collect_set("node")).alias("cluster_id"), F.count("*").alias("size")).where(F.col("size") >= cfg.min_cluster_size)
    return roots.join(named, "root").select(F.col("node").alias("address"), "cluster_id", "size")


def cluster_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedStore:
    """Where clusters are kept between batches: roots by address, addresses by root, and each root's cluster."""
    columns = lambda *names: T.StructType([T.StructField(n, T.LongType() if n == "size" else T.StringType()) for n in names])
    return KeyedStore(spark, path, {"roots": (columns("address", "root"), ["address"]), "members": (columns("root", "address"), ["root"]), "clusters": (columns("root", "cluster_id", "size"), ["root"])}, buckets)


def update_clusters(store: KeyedStore, number: int, pairs: DataFrame) -> DataFrame:
    """Take the accepted ``pairs`` (a, b) of batch ``number`` into the store; (root, cluster_id, size) of the clusters that the batch made or changed.

    Old clusters are single nodes, their roots; the batch's pairs join them. Only buckets with an address of the batch, and with a root that it touches, are read
    and written, and only touched clusters are counted and named again. A batch that is committed already changes nothing.
    """
    ends = materialise(pairs.where("a is not null and b is not null and a <> b").select(F.explode(F.array("a", "b")).alias("address"), "a", "b"), "batch-ends")
    who = ends.select("address").distinct()
    near = store.touched("roots", who)
    held = store.read("roots", near)
    known = materialise(who.join(held, "address", "left").withColumn("was", F.col("root")).withColumn("root", F.coalesce("root", "address")), "batch-roots")
    a, b = (known.select(F.col("address").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    between = ends.select("a", "b").distinct().join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    merged = materialise(connected_components(between).select(F.col("node").alias("was"), "root"), "merged-roots")
    # what an old root held goes to its new root, and so does an address that had none
    old = materialise(store.read("members", store.touched("members", merged, ["was"])).withColumnRenamed("root", "was").join(merged, "was"), "old-members")
    fresh = known.where("was is null").select("address", F.col("root").alias("was")).join(merged, "was").select("address", "root")
    now = materialise(old.select("address", "root").unionByName(fresh), "new-members")
    named = materialise(now.groupBy("root").agg(stable_id("C-", F.collect_list("address")).alias("cluster_id"), F.count("*").alias("size")), "new-clusters")

    def replaced(name: str, gone: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, list[int]]:
        where = sorted({*store.touched(name, gone, [key]), *store.touched(name, rows, [key])})
        return store.read(name, where).join(gone.select(key).distinct(), key, "left_anti").unionByName(rows.select(*store.tables[name][0].fieldNames())), where

    moved = now.join(old.where("was = root").select("address"), "address", "left_anti")
    gone = merged.select(F.col("was").alias("root"))
    store.commit(number, {"roots": replaced("roots", moved, moved, "address"), "members": replaced("members", gone, now, "root"), "clusters": replaced("clusters", gone, named, "root")})
    return named


def stored_clusters(store: KeyedStore, cfg: EngineConfig) -> DataFrame:
    """(address, cluster_id, size) of the store's clusters with at least ``min_cluster_size`` members."""
    return store.read("members").join(store.read("clusters").where(F.col("size") >= cfg.min_cluster_size), "root").select("address", "cluster_id", "size")


def evidence(links: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, name, n, confidence) of links within a cluster, accepted or not; confidence is n over its size, at most 1."""
    a = members.select(F.col("address").alias("a"), "cluster_id", "size")
    b = members.select(F.col("address").alias("b"), F.col("cluster_id").alias("other"))
    within = links.join(a, "a").join(b, "b").where("cluster_id = other")
    return within.groupBy("cluster_id", "name").agg(F.count("*").alias("n"), F.max("size").alias("size")).select("cluster_id", "name", "n", F.least(F.lit(1.0), F.round(F.col("n") / F.col("size"), 6)).alias("confidence"))


#: What each heuristic says of the addresses that it links.
DESCRIPTIONS = {
    "behavioral_similarity": "Addresses sharing >= N common counterparties are likely controlled by the same entity.",
    "coordinated_cashout": "Addresses cashing out similar amounts to the same collector in a short window are grouped as likely jointly controlled.",
    "common_funder": "Addresses funded by the same source and later converging on the same outbound counterparty are grouped as likely jointly controlled.",
    "contract_interaction": "Addresses interacting with the same smart contracts are grouped. Deposit->Contract->Withdraw cycles are linked as shared contract usage.",
    "deposit_address_reuse": "Addresses using the same forwarding deposit address are grouped as likely belonging to one operator or exchange account.",
    "fan_pattern": "Addresses on the receiving end of a fan-out (or sending end of a fan-in) are grouped as likely related.",
    "loop_detection": "Addresses forming circular transaction flows are grouped as likely coordinated or jointly controlled.",
    "temporal_coordination": "Addresses transacting within a short time window toward the same destination are flagged as coordinated.",
    "repeated_flow": "Addresses with repeated value transfers between each other are grouped as likely related entities.",
}


def persisted(found: DataFrame, signs: DataFrame, sums: DataFrame, addresses: DataFrame, owners: DataFrame, old: DataFrame, cfg: EngineConfig) -> dict[str, DataFrame]:
    """The tables of a clustering run, to be saved as one: ``clusters``, ``addresses``, ``evidence``, ``stale``.

    ``found`` (address, cluster_id, size) is counted again over the known ``addresses`` (address); what has fewer than two of them, or ``min_cluster_size``, goes.
    clusters: (cluster_id, size, total_balance, risk_level, label_status, owner_id, matched_owner_address), the balance what ``sums`` (``indicators``) moved inside,
    labelled anew by ``owners``; addresses: every known address with its cluster, null for those of none; evidence: (cluster_id, heuristic, text, confidence) from
    ``signs`` (``evidence``), in place of all there was; stale: (cluster_id) of ``old`` that is no longer there.
    """
    held = addresses.select("address").distinct().join(found.select("address", "cluster_id"), "address", "left")
    counted = held.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= max(2, cfg.min_cluster_size))
    kept = counted.select("cluster_id")
    assigned = held.join(kept.withColumn("kept", F.lit(True)), "cluster_id", "left").select("address", F.when(F.col("kept"), F.col("cluster_id")).alias("cluster_id"))
    named = owner_labels(assigned.where("cluster_id is not null"), owners)
    clusters = counted.join(sums.select("cluster_id", "internal_volume"), "cluster_id", "left").join(named, "cluster_id").select(
        "cluster_id", "size", F.coalesce("internal_volume", F.lit(0.0)).alias("total_balance"), F.lit("normal").alias("risk_level"), F.col("status").alias("label_status"), "owner_id", F.col("address").alias("matched_owner_address")
    )
    told = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])[F.col("name")]
    text = F.concat(F.coalesce(told, F.regexp_replace("name", "_", " ")), F.lit(" (signals: "), F.col("n").cast("string"), F.lit(")"))
    rows = signs.join(kept, "cluster_id", "left_semi").select("cluster_id", F.col("name").alias("heuristic"), ascii_text(text).alias("text"), "confidence")
    return {"clusters": clusters, "addresses": assigned, "evidence": rows, "stale": old.select("cluster_id").distinct().join(kept, "cluster_id", "left_anti")}


def indicators(transfers: DataFrame, members: DataFrame) -> DataFrame:
    """Per cluster that a transfer touches: its size, transfers, those within and contract calls, sums, net flow, span between known times."""
    a = members.select(F.col("address").alias("from_address"), F.col("cluster_id").alias("ca"))
    b = members.select(F.col("address").alias("to_address"), F.col("cluster_id").alias("cb"))
    own = transfers.join(a, "from_address", "left").join(b, "to_address", "left").where("ca is not null or cb is not null")
    touched = F.array_distinct(F.array_compact(F.array("ca", "cb")))
    rows = own.select("*", F.explode(touched).alias("cluster_id"))
    inside = (F.col("ca") == F.col("cb"))
    sent, got = F.col("ca") == F.col("cluster_id"), F.col("cb") == F.col("cluster_id")
    zero, known = F.lit(0.0), F.when(F.col("ts") > 0, F.col("ts"))
    out = rows.groupBy("cluster_id").agg(
        F.count("*").alias("tx_count"), F.count(F.when(inside, 1)).alias("internal_tx"), F.count(F.when(F.col("is_contract_call"), 1)).alias("contract_calls"), F.coalesce(exact_sum(F.when(inside, F.col("value"))), zero).alias("internal_volume"), exact_sum("value").alias("total_volume"),
        F.coalesce(exact_sum(F.when(got, F.col("value"))), zero).alias("total_in"), F.coalesce(exact_sum(F.when(sent, F.col("value"))), zero).alias("total_out"), F.min(known).alias("first_ts"), F.max(known).alias("last_ts"),
    )
    out = out.join(members.groupBy("cluster_id").agg(F.countDistinct("address").alias("size")), "cluster_id")
    return out.withColumn("net", F.round(F.col("total_in") - F.col("total_out"), 2)).withColumn("span", F.coalesce(F.col("last_ts") - F.col("first_ts"), zero))


def owner_labels(members: DataFrame, owners: DataFrame) -> DataFrame:
    """(cluster_id, status, owner_id, address): the owner with most matched addresses, primary ones deciding; a tie is a conflict.

    ``owners``: (owner_id, address, is_primary). Unlabelled clusters keep a null owner.
    """
    met = members.join(owners, "address")
    per = met.groupBy("cluster_id", "owner_id").agg(F.count("*").alias("n"), F.max(F.col("is_primary").cast("int")).alias("has_primary"), F.min("address").alias("any_address"), F.min(F.when(F.col("is_primary"), F.col("address"))).alias("main"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), F.desc("has_primary"), "owner_id")
    ranked = per.withColumns({"r": F.row_number().over(w), "n2": F.lead("n").over(w), "p2": F.lead("has_primary").over(w)}).where("r = 1")
    tie = (F.col("n") == F.col("n2")) & (F.col("has_primary") == F.col("p2"))
    chosen = ranked.select("cluster_id", F.when(tie, "conflict").otherwise("matched").alias("status"), F.when(~F.coalesce(tie, F.lit(False)), F.col("owner_id")).alias("owner_id"), F.when(~F.coalesce(tie, F.lit(False)), F.coalesce("main", "any_address")).alias("address"))
    return members.select("cluster_id").distinct().join(chosen, "cluster_id", "left").withColumn("status", F.coalesce("status", F.lit("unlabeled")))
