"""Wallet-pair heuristics. Each gives distinct pairs (a, b), a < b; their names are part of the interface."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import EngineConfig
from tracewell.operators.graph import bounded_cycles, path_members
from tracewell.operators.joins import interval_join, pairs_within, similar
from tracewell.sources.storage import materialise

#: Heuristics that can carry a link by themselves.
PRIMARY = ("behavioral_similarity", "contract_interaction", "fan_pattern", "loop_detection", "repeated_flow", "temporal_coordination")
CONTRACT_GROUP, BEHAVIOUR_JACCARD = 12, 0.75


def meaningful(transfers: DataFrame, cfg: EngineConfig, contracts: bool = False, self_transfers: bool = True) -> DataFrame:
    own = transfers.where(F.col("value") >= cfg.min_transfer_value)
    own = own if contracts else own.where("not is_contract_call")
    return own if self_transfers else own.where("from_address <> to_address")


def deposit_address_reuse(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Senders whose deposits to one address were passed on, within a span, to its only target."""
    own = meaningful(transfers, cfg, self_transfers=False)
    sends = own.groupBy(F.col("from_address").alias("node")).agg(F.countDistinct("to_address").alias("n")).where("n = 1").select("node")
    fed = own.groupBy(F.col("to_address").alias("node")).agg(F.countDistinct("from_address").alias("n")).where(F.col("n").between(2, cfg.max_pattern_size)).select("node")
    nodes = sends.join(fed, "node", "left_semi")
    into = own.select(F.col("to_address").alias("node"), F.col("from_address").alias("sender"), F.col("ts").alias("in_ts"), F.col("value").alias("in_value")).join(nodes, "node", "left_semi")
    out = own.select(F.col("from_address").alias("node"), F.col("ts").alias("out_ts"), F.col("value").alias("out_value"))
    i, o = F.col("in_value"), F.col("out_value")
    passed = (o <= i + cfg.forwarding_tolerance) & (similar(i, o, cfg.amount_ratio, cfg.forwarding_tolerance) | (o >= i * (1 - 2 * cfg.amount_ratio)))
    return pairs_within(interval_join(into, out, ["node"], "in_ts", "out_ts", cfg.pass_through_window, "left_semi", passed), ["node"], "sender")


def coordinated_cashout(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Senders of like amounts to one receiver shortly after one transfer; all that follow it are one group."""
    own = meaningful(transfers, cfg, self_transfers=False)
    fits = own.groupBy("to_address").agg(F.countDistinct("from_address").alias("n")).where(F.col("n").between(2, cfg.max_pattern_size)).select("to_address")
    own = own.join(fits, "to_address", "left_semi")
    left = own.select("to_address", F.col("tx_hash").alias("group_tx"), F.col("ts").alias("lts"), F.col("value").alias("lv"))
    right = own.select("to_address", F.col("from_address").alias("sender"), F.col("ts").alias("rts"), F.col("value").alias("rv"))
    group = interval_join(left, right, ["to_address"], "lts", "rts", cfg.cashout_window, also=similar(F.col("lv"), F.col("rv"), cfg.amount_ratio))
    return pairs_within(group, ["to_address", "group_tx"], "sender")


def common_funder(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Recipients of one funder that also pay a common target."""
    flow = meaningful(transfers, cfg, self_transfers=False).select("from_address", "to_address").distinct()
    active = flow.select(F.col("from_address").alias("to_address")).distinct()
    pairs = pairs_within(flow.join(active, "to_address", "left_semi"), ["from_address"], "to_address", 2, cfg.max_pattern_size)
    a = flow.select(F.col("from_address").alias("a"), F.col("to_address").alias("sink"))
    b = flow.select(F.col("from_address").alias("b"), F.col("to_address").alias("sink"))
    return pairs.join(a, "a").join(b, ["b", "sink"], "left_semi").select("a", "b").distinct()


def behavioral_similarity(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """At least ``min_shared_counterparties`` common counterparties, or two at a Jaccard similarity of 0.75.

    Counterparties are put in order, those of few nodes first. Two nodes that share ``least`` have one in common among all but their last ``least`` - 1, so a hub, which
    comes last, brings nodes together only if rarer ones do. What two nodes share is then counted along the one with fewer counterparties. Two common ones reach
    0.75 only if neither has another; such nodes are grouped by their two.
    """
    own = meaningful(transfers, cfg, contracts=True, self_transfers=False)
    near = own.select(F.col("from_address").alias("u"), F.col("to_address").alias("peer")).unionByName(own.select(F.col("to_address").alias("u"), F.col("from_address").alias("peer"))).distinct()
    least = max(2, cfg.min_shared_counterparties)
    common = near.groupBy("peer").agg(F.count("*").alias("often")).where("often >= 2")
    order = Window.partitionBy("u").orderBy("often", "peer")
    # counterparties of one node only are shared by nobody, but count in a node's number
    degree = near.groupBy("u").agg(F.count("*").alias("d"))
    held = materialise(near.join(common, "peer").withColumn("place", F.row_number().over(order)).withColumn("shared", F.count("*").over(Window.partitionBy("u"))), "counterparties")
    prefix = held.where(F.col("place") <= F.col("shared") - (least - 1)).select("u", "peer", "shared")
    a, b = (prefix.select("peer", F.col("u").alias(c), F.col("shared").alias(f"n{c}")) for c in "ab")
    # a has fewer, ties by name
    met = a.join(b, "peer").where((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    both = met.join(held.select(F.col("u").alias("a"), "peer"), "a").join(held.select(F.col("u").alias("b"), "peer"), ["b", "peer"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    found = both.where(F.col("n") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if cfg.min_shared_counterparties <= 2:
        return found
    two = held.join(degree.where("d = 2").select("u"), "u", "left_semi").where("shared = 2").groupBy("u").agg(F.min("peer").alias("p"), F.max("peer").alias("q"))
    return found.unionByName(pairs_within(two, ["p", "q"], "u")).distinct()


def contract_interaction(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Few repeated callers of one contract; and pure depositors with pure withdrawers of it."""
    calls = transfers.where("is_contract_call")
    callers = calls.groupBy("to_address", "from_address").agg(F.count("*").alias("n")).where("n >= 2")
    together = pairs_within(callers, ["to_address"], "from_address", 2, CONTRACT_GROUP)
    contract = calls.select(F.col("to_address").alias("c")).distinct()
    pays = transfers.select(F.col("to_address").alias("c"), F.col("from_address").alias("w")).distinct().join(contract, "c", "left_semi")
    gets = transfers.select(F.col("from_address").alias("c"), F.col("to_address").alias("w")).distinct().join(contract, "c", "left_semi")

    def few(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") <= CONTRACT_GROUP).select("c"), "c", "left_semi")

    pure_in, pure_out = few(pays.join(gets, ["c", "w"], "left_anti")), few(gets.join(pays, ["c", "w"], "left_anti"))
    across = pure_in.join(pure_out.withColumnRenamed("w", "x"), "c").where("w <> x").select(F.least("w", "x").alias("a"), F.greatest("w", "x").alias("b"))
    return together.unionByName(across).distinct()


def repeated_flow(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Pairs with flows both ways or at least two one way."""
    flow = meaningful(transfers, cfg, contracts=True, self_transfers=False).groupBy("from_address", "to_address").agg(F.count("*").alias("n"))
    pair = flow.groupBy(F.least("from_address", "to_address").alias("a"), F.greatest("from_address", "to_address").alias("b")).agg(F.count("*").alias("ways"), F.max("n").alias("n"))
    return pair.where("ways = 2 or n >= 2").select("a", "b")


def temporal_coordination(transfers: DataFrame, cfg: EngineConfig, least: int = 3) -> DataFrame:
    """Senders to one receiver of which at least three fall in one window."""
    own = meaningful(transfers, cfg, self_transfers=False)
    w = Window.partitionBy("to_address").orderBy("ts").rangeBetween(-int(cfg.temporal_window), 0)
    sets = own.select("to_address", F.col("from_address"), F.floor("ts").cast("long").alias("ts")).select(F.array_sort(F.collect_set("from_address").over(w)).alias("s")).where(F.size("s") >= least).distinct()
    each = sets.select("s", F.explode("s").alias("a"))
    return each.select("a", F.explode("s").alias("b")).where("a < b").distinct()


def fan_groups(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(hub, member): the targets of each node that pays at least ``fan_threshold``, and the senders of each that as many pay."""
    flow = meaningful(transfers, cfg).select("from_address", "to_address").distinct()
    out = flow.select(F.concat(F.lit("out:"), "from_address").alias("hub"), F.col("to_address").alias("member"))
    groups = out.unionByName(flow.select(F.concat(F.lit("in:"), "to_address").alias("hub"), F.col("from_address").alias("member")))
    many = groups.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, cfg.fan_threshold)).select("hub")
    return groups.join(many, "hub", "left_semi")


def fan_pattern(transfers: DataFrame, cfg: EngineConfig, among: DataFrame | None = None) -> DataFrame:
    """All targets of a node that pays many, all senders of a node that many pay; with ``among`` (a, b) only the pairs of those, which are looked up and not made."""
    groups = fan_groups(transfers, cfg)
    if among is None:
        return pairs_within(groups, ["hub"], "member")
    met = among.select("a", "b").distinct().join(groups.withColumnRenamed("member", "a"), "a")
    return met.join(groups.withColumnRenamed("member", "b"), ["b", "hub"], "left_semi").select("a", "b").distinct()


def loop_detection(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Members of one short cycle."""
    flow = meaningful(transfers, cfg, self_transfers=False).select(F.col("from_address").alias("a"), F.col("to_address").alias("b")).distinct()
    return path_members(bounded_cycles(flow, cfg.loop_max_depth))


HEURISTICS = {f.__name__: f for f in (deposit_address_reuse, coordinated_cashout, common_funder, behavioral_similarity, contract_interaction, repeated_flow, temporal_coordination, fan_pattern, loop_detection)}


def all_links(transfers: DataFrame, cfg: EngineConfig, names: list[str] | None = None) -> DataFrame:
    """(a, b, name) over the named heuristics, all by default."""
    parts = [HEURISTICS[n](transfers, cfg).withColumn("name", F.lit(n)) for n in names or HEURISTICS]
    return reduce(DataFrame.unionByName, parts).distinct()


def gated_links(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(a, b, name) of all heuristics, for every pair that can pass the gate: of fans, where the gate asks for two heuristics or more, only the pairs that another one gives."""
    if cfg.min_heuristic_support < 2:
        return all_links(transfers, cfg)
    other = materialise(all_links(transfers, cfg, [n for n in HEURISTICS if n != "fan_pattern"]), "links")
    return other.unionByName(fan_pattern(transfers, cfg, other).withColumn("name", F.lit("fan_pattern")))


def gate(links: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(a, b, names) of pairs with enough heuristics, a primary one among them."""
    pairs = links.groupBy("a", "b").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return pairs.where((F.size("names") >= max(1, cfg.min_heuristic_support)) & F.arrays_overlap("names", F.array(*[F.lit(p) for p in PRIMARY])))
