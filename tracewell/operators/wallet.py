"""Single-wallet scans: labels, detections, entity class, risk, clusters, alerts, screening.

``txs``: (wallet, tx_hash, from_address, to_address, value, ts, method_id); direction is out iff the wallet sends.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.relational import top_per_group

BOT_RATE, BOT_SHARE, FAST = 5.0, 0.8, 600.0
STAGES = ("placement", "layering", "integration")


def with_direction(txs: DataFrame) -> DataFrame:
    return txs.withColumn("direction", F.when(F.col("from_address") == F.col("wallet"), "out").otherwise("in"))


def detections(txs: DataFrame, protocols: DataFrame, methods: dict[str, str], large: float = 100.0) -> DataFrame:
    """(wallet, detector, label, tx_hash): by method signature, known protocol (address, label) and value, each once a transfer."""
    by_method = txs.where(F.col("method_id").isin(*methods)).select("wallet", F.lit("method_signature").alias("detector"), F.create_map(*[F.lit(x) for kv in methods.items() for x in kv])[F.col("method_id")].alias("label"), "tx_hash")
    known = txs.join(protocols.select(F.col("address").alias("to_address"), "label"), "to_address").select("wallet", F.lit("known_protocol").alias("detector"), "label", "tx_hash")
    big = txs.where(F.col("value") >= large).select("wallet", F.lit("value_heuristic").alias("detector"), F.lit("large_transfer").alias("label"), "tx_hash")
    return by_method.unionByName(known).unionByName(big).distinct()


def bot_behavior(txs: DataFrame) -> DataFrame:
    """(wallet, n, rate, top_share, is_bot): at least ten transfers, very frequent or mostly to one address.

    rate is transfers a minute of the span, 0 where all are of one moment; the share counts transfers with a target, of all.
    """
    n = txs.groupBy("wallet").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    top = txs.where("coalesce(to_address, '') <> ''").groupBy("wallet", "to_address").agg(F.count("*").alias("k")).groupBy("wallet").agg(F.max("k").alias("k"))
    span = F.col("t1") - F.col("t0")
    rate = F.when(span > 0, F.round(F.col("n") / (span / 60), 6)).otherwise(0.0)
    share = F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 6)
    return n.join(top, "wallet", "left").select("wallet", "n", rate.alias("rate"), share.alias("top_share"), ((F.col("n") >= 10) & ((rate > BOT_RATE) | (share > BOT_SHARE))).alias("is_bot"))


def fast_movement(txs: DataFrame) -> DataFrame:
    """(wallet, times): incoming transfers that an outgoing one follows next, within ten minutes."""
    w = Window.partitionBy("wallet").orderBy("ts", "tx_hash")
    own = with_direction(txs).withColumns({"next_d": F.lead("direction").over(w), "gap": F.lead("ts").over(w) - F.col("ts")})
    return own.where((F.col("direction") == "in") & (F.col("next_d") == "out") & (F.col("gap") > 0) & (F.col("gap") < FAST)).groupBy("wallet").agg(F.count("*").alias("times"))


def wallet_risk(txs: DataFrame, found: DataFrame, flagged: DataFrame, classes: DataFrame) -> DataFrame:
    """(wallet, score, level, reasons) of 0 to 100 points.

    ``found`` are the wallet's ``detections``, ``flagged`` (address, points) the entries that hold for its chain, whose points add up where they name the
    wallet itself, in either case, ``classes`` its ``entity_class``. reasons names the rules that gave points, in their order.
    """
    own = with_direction(txs)
    target = F.lower("to_address")
    agg = own.groupBy("wallet").agg(
        F.countDistinct(F.when((F.coalesce("to_address", F.lit("")) != "") & (target != F.lower("wallet")), target)).alias("targets"), F.count("*").alias("n"), F.count(F.when(F.col("direction") == "out", 1)).alias("n_out")
    )
    seen = found.groupBy("wallet").agg(
        F.count(F.when(F.col("label") == "approval", 1)).alias("approvals"), F.max(F.col("label").isin("tornado_cash", "bridge")).alias("exposed"), F.max(F.col("label") == "large_transfer").alias("large")
    )
    flags = flagged.groupBy(F.lower("address").alias("key")).agg(F.sum("points").alias("points"))
    out = agg.join(seen, "wallet", "left").join(fast_movement(txs), "wallet", "left").join(classes, "wallet", "left").withColumn("key", F.lower("wallet")).join(flags, "key", "left")
    rules = [
        ("counterparty fan-out", F.col("targets") >= 10, 10), ("activity burst", F.col("n") >= 15, 15), ("mostly outbound", (F.col("n_out") / F.col("n") > 0.9) & (F.col("n") >= 5), 10), ("fast movement", F.col("times") > 0, 20),
        ("repeated approvals", F.col("approvals") >= 3, 10), ("mixer or bridge exposure", F.col("exposed"), 25), ("large transfer", F.col("large"), 5), ("bot", F.col("class") == "bot", 15), ("mixer", F.col("class") == "mixer", 30),
    ]
    hit = [(name, F.coalesce(c, F.lit(False)), points) for name, c, points in rules]
    score = F.least(F.lit(100), sum((F.when(c, p).otherwise(0) for _, c, p in hit), F.coalesce("points", F.lit(0)))).cast("int")
    reasons = F.concat_ws(", ", F.when(F.col("points").isNotNull(), "flagged"), *[F.when(c, name) for name, c, _ in hit])
    return out.select("wallet", score.alias("score"), F.when(score >= 70, "high_risk").when(score >= 30, "suspicious").otherwise("safe").alias("level"), reasons.alias("reasons"))


def wallet_clusters(txs: DataFrame) -> DataFrame:
    """(source, kind): hubs (two targets of two transfers each), rapid funding (five targets within a day), and both-way pairs."""
    pair = txs.groupBy(F.col("from_address").alias("source"), F.col("to_address").alias("target")).agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    hub = pair.where("n >= 2").groupBy("source").agg(F.count("*").alias("k")).where("k >= 2").select("source", F.lit("hub").alias("kind"))
    rapid = pair.groupBy("source").agg(F.count("*").alias("k"), F.min("t0").alias("a"), F.max("t1").alias("b")).where("k >= 5 and b - a < 86400").select("source", F.lit("rapid_funding").alias("kind"))
    both = pair.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("n").alias("n")).where("n >= 2 and a <> b").select(F.concat_ws("|", "a", "b").alias("source"), F.lit("bidirectional").alias("kind"))
    return hub.unionByName(rapid).unionByName(both)


def wallet_alerts(risk: DataFrame, txs: DataFrame, clusters: DataFrame, watchlist: DataFrame) -> DataFrame:
    """(wallet, alert): high risk, watched, hub or rapid cluster, and large amounts over a day or more."""
    parts = [risk.where("score >= 70").select("wallet", F.lit("high_risk").alias("alert")), risk.select("wallet").join(watchlist.select(F.col("address").alias("wallet")), "wallet", "left_semi").withColumn("alert", F.lit("watchlist"))]
    parts.append(clusters.where("kind <> 'bidirectional'").select(F.col("source").alias("wallet"), F.concat(F.lit("cluster_"), "kind").alias("alert")))
    span = txs.groupBy("wallet").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.max("value").alias("v")).where("b - a >= 86400 and v > 1").select("wallet", F.lit("sustained_activity").alias("alert"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(span)
    return out.join(risk.select("wallet"), "wallet", "left_semi").distinct()


def screen_flagged(addresses: DataFrame, flagged: DataFrame) -> DataFrame:
    """(chain, address, points): the most points of a flag for the address's chain or for all ("global")."""
    own = addresses.select("chain", "address", F.lower("address").alias("k")).withColumn("on", F.explode(F.array("chain", F.lit("global"))))
    return own.join(flagged.select(F.col("chain").alias("on"), F.lower("address").alias("k"), "points"), ["on", "k"]).groupBy("chain", "address").agg(F.max("points").alias("points"))


def ego_graph(txs: DataFrame, wallet: str) -> DataFrame:
    """(source, target, n) around one wallet; a missing end is ``unknown``."""
    own = txs.where((F.col("from_address") == wallet) | (F.col("to_address") == wallet))
    return own.groupBy(F.coalesce("from_address", F.lit("unknown")).alias("source"), F.coalesce("to_address", F.lit("unknown")).alias("target")).agg(F.count("*").alias("n"))


def collapse_leaves(edges: DataFrame, keep: int) -> DataFrame:
    """(node, leaves): the ``keep`` nodes of most neighbours, each with how many neighbours of its own only it has dropped into a summary."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct()
    degree = both.groupBy("u").agg(F.count("*").alias("d"))
    hubs = degree.orderBy(F.desc("d"), "u").limit(keep).select("u")
    leaf = degree.where("d = 1").join(hubs, "u", "left_anti").select(F.col("u").alias("v"))
    n = both.join(hubs, "u", "left_semi").join(leaf, "v", "left_semi").groupBy("u").agg(F.count("*").alias("n"))
    return hubs.join(n, "u", "left").select(F.col("u").alias("node"), F.coalesce("n", F.lit(0)).alias("leaves"))


def chain_of_custody(entities: DataFrame, stages: dict[str, DataFrame], members: DataFrame) -> DataFrame:
    """(entity, stage, score, via): each stage's best score, by the entity itself before any of its addresses.

    A stage is (key, score), keyed by entity or address; ``members``: (entity, address).
    """
    out = None
    for stage, rows in stages.items():
        direct = entities.select("entity").join(rows.withColumnRenamed("key", "entity"), "entity").select("entity", "score", F.lit(0).alias("p"))
        through = members.join(rows.withColumnRenamed("key", "address"), "address").join(entities.select("entity"), "entity", "left_semi").select("entity", "score", F.lit(1).alias("p"))
        w = Window.partitionBy("entity").orderBy("p", F.desc("score"))
        best = direct.unionByName(through).withColumn("r", F.row_number().over(w)).where("r = 1")
        part = best.select("entity", F.lit(stage).alias("stage"), "score", F.when(F.col("p") == 0, "entity").otherwise("address").alias("via"))
        out = part if out is None else out.unionByName(part)
    return out


def custody_report(custody: DataFrame, hashes: DataFrame, most: int = 50) -> DataFrame:
    """(entity, stages, overall, hashes) of ``chain_of_custody`` rows: stages found in their order, the best score of them, and the first ``most`` distinct ``hashes`` (entity, stage, tx_hash) of those stages."""
    at = F.array_position(F.array(*[F.lit(x) for x in STAGES]), F.col("stage"))
    own = custody.groupBy("entity").agg(F.transform(F.array_sort(F.collect_set(F.struct(at.alias("at"), "stage"))), lambda x: x["stage"]).alias("stages"), F.round(F.max("score"), 4).alias("overall"))
    found = hashes.join(custody.select("entity", "stage"), ["entity", "stage"], "left_semi").select("entity", "tx_hash").distinct()
    first = top_per_group(found, ["entity"], [F.col("tx_hash")], most).groupBy("entity").agg(F.array_sort(F.collect_list("tx_hash")).alias("hashes"))
    return own.join(first, "entity", "left").withColumn("hashes", F.coalesce("hashes", F.array().cast("array<string>")))


def entity_class(txs: DataFrame, found: DataFrame, contracts: DataFrame, most: int = 100) -> DataFrame:
    """(wallet, class): mixer by its detections, contract by its code (``contracts``: address), exchange by counterparties or detections, bot, else user."""
    kinds = found.groupBy("wallet").agg(F.max(F.when(F.col("label") == "tornado_cash", 1)).alias("mixer"), F.max(F.when(F.lower("label").contains("exchange"), 1)).alias("exchange"))
    sides = txs.select("wallet", F.explode(F.array(F.lower(F.coalesce("from_address", F.lit(""))), F.lower(F.coalesce("to_address", F.lit(""))))).alias("peer"))
    peers = sides.groupBy("wallet").agg(F.countDistinct("peer").alias("peers"))
    own = peers.join(kinds, "wallet", "left").join(bot_behavior(txs).select("wallet", "is_bot"), "wallet", "left")
    own = own.join(contracts.select(F.col("address").alias("wallet"), F.lit(1).alias("code")).distinct(), "wallet", "left")
    name = F.when(F.col("mixer") == 1, "mixer").when(F.col("code") == 1, "smart contract").when((F.col("peers") > most) | (F.col("exchange") == 1), "exchange").when(F.col("is_bot"), "bot").otherwise("user wallet")
    return own.select("wallet", name.alias("class"))


def newest(txs: DataFrame, n: int) -> DataFrame:
    """(wallet, place, tx_hash, ts): the ``n`` newest transfers of each wallet."""
    own = txs.withColumn("place", F.row_number().over(Window.partitionBy("wallet").orderBy(F.desc("ts"), "tx_hash")))
    return own.where(F.col("place") <= n).select("wallet", "place", "tx_hash", "ts")


def labelled(txs: DataFrame, methods: dict[str, str]) -> DataFrame:
    """``txs`` with ``label``: what its method does (``methods``: id to swap or approval), else send or receive."""
    known = F.create_map(*[F.lit(x) for kv in methods.items() for x in kv])[F.lower(F.substring("method_id", 1, 10))]
    return with_direction(txs).withColumn("label", F.coalesce(known, F.when(F.col("direction") == "out", "send").otherwise("receive"))).drop("direction")


def scan_chains(chains: dict[str, Callable[[], DataFrame]], scan: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, str]]:
    """(rows, errors): ``scan`` over each chain's transfers, beside its ``chain``; a chain whose table can't be opened is left out and told in errors, and an error if none can.

    A table that opens but whose files are broken fails the job, as rows are read only then.
    """
    parts, errors = [], {}
    for chain, load in chains.items():
        try:
            parts.append(scan(load()).withColumn("chain", F.lit(chain)))
        except AnalysisException as e:
            errors[chain] = str(e)
    if not parts:
        raise RuntimeError(f"no chain could be scanned: {errors}")
    return reduce(DataFrame.unionByName, parts), errors


def explorer_summary(txs: DataFrame, n: int = 10) -> DataFrame:
    """(wallet, n_sent, n_received, sent, received, first_ts, last_ts, newest): a wallet's sums and its ``n`` newest hashes, the newest first."""
    own = with_direction(txs)
    amount = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("value").cast("decimal(18,2)"))).cast("double"), F.lit(0.0))
    sums = own.groupBy("wallet").agg(F.count(F.when(F.col("direction") == "out", 1)).alias("n_sent"), F.count(F.when(F.col("direction") == "in", 1)).alias("n_received"), amount("out").alias("sent"), amount("in").alias("received"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    last = newest(txs, n).groupBy("wallet").agg(F.sort_array(F.collect_list(F.struct("place", "tx_hash"))).alias("s"))
    return sums.join(last.select("wallet", F.transform("s", lambda x: x["tx_hash"]).alias("newest")), "wallet")
