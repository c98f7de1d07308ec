"""Placement: behaviours of receiving entities, backward traces, scores and labels.

``flows``: (src, dst, ts, tx_hash, value), transfers between different entities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import EngineConfig
from tracewell.functions.scalar import clamp, exact_sum, stable_id
from tracewell.operators.graph import connected_components
from tracewell.operators.heuristics import gate
from tracewell.operators.relational import top_per_group, variation, with_entities
from tracewell.operators.strong import strongly_connected
from tracewell.sources.storage import cut, drop, fresh_path, materialise

LEAST, CUTOFF = 0.55, 0.25


def entity_flows(transfers: DataFrame, members: DataFrame) -> DataFrame:
    own = with_entities(transfers, members).where("from_entity <> to_entity")
    return own.select(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst"), "ts", "tx_hash", "value")


def structuring(flows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The best window of like amounts; a window ends at one transfer, of equal times at the later hash.

    A window's counts and moments are those of all transfers up to its end less those up to the last one before its start: running frames over one sort, linear in a
    receiver's transfers, summed once. Moments are of amounts to eight places, exact. Three senders are in a window if the last transfer of the third
    latest one is: times at which senders take turns tell it, again by running frames.
    """
    w = Window.partitionBy("dst")
    order = w.orderBy("t", "tx_hash")
    till, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    before = w.orderBy("t").rangeBetween(Window.unboundedPreceding, -int(cfg.structuring_window * 1_000_000) - 1)
    x = F.when(F.col("value") > 0, F.col("value").cast("decimal(20,8)"))
    cents = (F.col("value").cast("decimal(18,2)") * 100).cast("long")
    # numbered first, so that rows are shuffled and sorted without the wide decimals
    own = flows.select("dst", "src", "tx_hash", F.round(F.col("ts") * 1_000_000).cast("long").alias("t"), "value").withColumn("rk", F.row_number().over(order))
    own = own.select("dst", "src", "tx_hash", "t", "rk", F.when(F.col("value") > 0, 1).otherwise(0).alias("pos"), x.alias("x"), (x * x).cast("decimal(38,12)").alias("xx"), cents.alias("cents"))
    sums = {"n_pos": "pos", "s1": "x", "s2": "xx", "total": "cents"}
    own = own.withColumns({f"all_{k}": F.coalesce(F.sum(c).over(till), F.lit(0)) for k, c in sums.items()})
    own = own.withColumn("out", F.max(F.struct("rk", *[f"all_{k}" for k in sums])).over(before))
    own = own.withColumns({"n": F.col("rk") - F.coalesce("out.rk", F.lit(0))} | {k: F.col(f"all_{k}") - F.coalesce(f"out.all_{k}", F.lit(0)) for k in sums})
    own = own.withColumn("total", F.col("total") / 100)
    last_src, last_t = F.lag("src").over(order), F.lag("t").over(order)
    own = own.withColumns({"last_src": last_src, "last_t": last_t})
    # at the first transfer of a sender's turn: who had the turn before the last one, and when it ended
    turn = F.col("last_src").isNotNull() & (F.col("last_src") != F.col("src"))
    own = own.withColumn("two_back", F.last(F.when(turn, F.struct("last_src", "last_t")), ignorenulls=True).over(earlier))
    third = F.when(turn & (F.col("two_back.last_src") != F.col("src")), F.col("two_back.last_t"))
    own = own.withColumn("third", F.last(third, ignorenulls=True).over(till))
    three = F.coalesce(F.col("third") >= F.col("t") - int(cfg.structuring_window * 1_000_000), F.lit(False))
    mean = F.col("s1").cast("double") / F.greatest("n_pos", F.lit(1))
    # n * sum of squares - square of the sum has no rounding before the root
    spread = (F.col("n_pos").cast("decimal(12,0)") * F.col("s2")).cast("double") - F.col("s1").cast("double") * F.col("s1").cast("double")
    cv = F.when(F.col("n_pos") < 2, 0.0).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0))) / F.col("n_pos") / F.greatest(mean, F.lit(1e-9)))
    fits = own.withColumn("cv", cv).where((F.col("n") >= cfg.structuring_min_tx) & (F.col("n_pos") >= cfg.structuring_min_tx) & (F.col("cv") <= cfg.structuring_max_cv))
    m = float(cfg.structuring_min_tx)
    conf = clamp(0.35 * F.least(F.lit(1.0), F.col("n") / (2 * m)) + 0.35 * (1 - F.least(F.lit(1.0), F.col("cv") / cfg.structuring_max_cv)) + 0.30 * F.least(F.lit(1.0), F.col("total") / max(cfg.high_value, 1.0)) + F.when(three, 0.05).otherwise(0.0))
    best = fits.groupBy(F.col("dst").alias("entity")).agg(F.max(F.struct(F.round(conf, 4).alias("confidence"), (-F.col("rk")).alias("first"))).alias("best"))
    return best.select("entity", F.lit("structuring").alias("behavior"), F.col("best.confidence").alias("confidence")).where(F.col("confidence") >= LEAST)


def smurfing(flows: DataFrame, profiles: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Many senders, most with one transfer, to a young entity; ``profiles``: (entity, first_seen, last_seen)."""
    per = flows.groupBy("dst", "src").agg(F.count("*").alias("n"))
    own = per.groupBy(F.col("dst").alias("entity")).agg(F.count("*").alias("senders"), (F.count(F.when(F.col("n") == 1, 1)) / F.count("*")).alias("single"))
    own = own.join(profiles.select("entity", (F.col("last_seen") - F.col("first_seen")).alias("age")), "entity").where((F.col("senders") >= cfg.smurf_senders) & (F.col("age") <= cfg.smurf_max_age))
    conf = 0.45 * F.least(F.lit(1.0), F.col("senders") / (2.0 * cfg.smurf_senders)) + 0.35 * (1 - F.col("age") / cfg.smurf_max_age) + 0.20 * F.col("single")
    return own.select("entity", F.lit("smurfing").alias("behavior"), F.round(conf, 4).alias("confidence")).where(F.col("confidence") >= LEAST)


def micro_funding(flows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Many tiny transfers that add up."""
    small = flows.where((F.col("value") > 0) & (F.col("value") <= cfg.micro_max))
    own = small.groupBy(F.col("dst").alias("entity")).agg(F.count("*").alias("n"), exact_sum("value").alias("total"), variation(F.col("value")).alias("cv")).where((F.col("n") >= cfg.micro_count) & (F.col("total") >= cfg.micro_total))
    conf = 0.40 * F.least(F.lit(1.0), F.col("n") / (2.0 * cfg.micro_count)) + 0.40 * F.least(F.lit(1.0), F.col("total") / (3 * cfg.micro_total)) + 0.20 * (1 - F.least(F.lit(1.0), F.col("cv") / 0.5))
    return own.select("entity", F.lit("micro_funding").alias("behavior"), F.round(conf, 4).alias("confidence")).where(F.col("confidence") >= LEAST)


def behaviors(flows: DataFrame, profiles: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(entity, behavior, confidence, rank) of all three, best first. They are written one after another, so that only one's shuffles are on disk."""
    every = reduce(DataFrame.unionByName, [cut(x) for x in (structuring(flows, cfg), smurfing(flows, profiles, cfg), micro_funding(flows, cfg))])
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("confidence"), "behavior")))


def highlights(ranked: DataFrame) -> DataFrame:
    """(entity, mode, shown): how many of the best behaviours stand out: none, dominant (1), paired (2) or balanced (3)."""
    own = ranked.groupBy("entity").agg(*[F.max(F.when(F.col("rank") == k, F.col("confidence"))).alias(f"c{k}") for k in (1, 2, 3)])
    close = lambda a, b, gap, ratio: (a - b <= gap) & (b / F.greatest(a, F.lit(1e-9)) >= ratio)
    two = close(F.col("c1"), F.col("c2"), 0.15, 0.82)
    three = two & close(F.col("c1"), F.col("c3"), 0.06, 0.94)
    mode = F.when(F.coalesce(three, F.lit(False)), "balanced").when(F.coalesce(two, F.lit(False)), "paired").otherwise("dominant")
    return own.select("entity", mode.alias("mode"), F.when(mode == "balanced", 3).when(mode == "paired", 2).otherwise(1).alias("shown"))


def flow_pairs(flows: DataFrame) -> DataFrame:
    """(a, b, and n_ab, total_ab, first_ab, n_ba, total_ba, first_ba): the transfers between two entities, each way, one row for both, a <= b."""
    back = F.coalesce(F.col("src") > F.col("dst"), F.col("dst").isNull() & F.col("src").isNotNull())
    own = flows.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("b"), back.alias("back"), "value", "ts")
    ways = []
    for way, here in (("ab", ~F.col("back")), ("ba", F.col("back"))):
        ways += [F.count(F.when(here, 1)).alias(f"n_{way}"), exact_sum(F.when(here, F.col("value"))).alias(f"total_{way}"), F.min(F.when(here, F.col("ts"))).alias(f"first_{way}")]
    return own.groupBy("a", "b").agg(*ways)


def _sides(pairs: DataFrame) -> DataFrame:
    """(entity, peer, n, n_out, total_out, first_out, total_in, n_in) of each entity of each pair; a pair of one entity is one row, its transfers counted both ways."""
    side = lambda me, peer: F.struct(F.col(me).alias("entity"), F.col(peer).alias("peer"), *[F.col(f"{c}_{me}{peer}").alias(f"{c}_out") for c in ("n", "total", "first")], F.col(f"n_{peer}{me}").alias("n_in"), F.col(f"total_{peer}{me}").alias("total_in"))
    one = side("a", "b").withField("n_in", F.col("n_ab")).withField("total_in", F.col("total_ab"))
    each = F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(side("a", "b"), side("b", "a")))
    return pairs.select(F.explode(each).alias("s")).select("s.*").withColumn("n", F.col("n_out") + F.col("n_in"))


def linked_entities(flows: DataFrame) -> DataFrame:
    """(entity, tx_count, degree): transfers with other entities and how many other entities."""
    return _sides(flow_pairs(flows)).groupBy("entity").agg(F.sum("n").alias("tx_count"), F.count("*").alias("degree"))


def source_edges(flows: DataFrame, cfg: EngineConfig, within: DataFrame | None = None) -> DataFrame:
    """(at, up, total, first_ts, strength, many): the edges into each entity that a path can take, written; see ``trace``.

    A path takes an entity's first ``branching`` sources that it doesn't hold and that carry its score over the cut-off. An edge's weight at a depth grows with its
    ``strength`` (share, less for service-like sources) among edges of equal ``many`` (sources with many targets). So an edge is left out for every path
    if ``branching + max_hops`` earlier ones of its kind are as strong: at most ``max_hops`` of their sources are in the path. Edges fall to as many classes by a hash,
    and one is left out if each class has had one as strong.
    """
    spark = flows.sparkSession
    at = {name: fresh_path(spark, name) for name in ("pairs", "edges")}
    pairs = materialise(flow_pairs(flows), "pairs", at["pairs"])
    sides = _sides(pairs)
    linked = sides.groupBy("entity").agg(F.sum("n").alias("tx_count"), F.count("*").alias("degree"), F.count(F.when(F.col("n_out") > 0, 1)).alias("fan_out"), F.count(F.when(F.col("n_in") > 0, 1)).alias("fan_in"), F.round(F.sum("total_in"), 2).alias("total_in"))
    linked = cut(linked)
    into = linked.where("fan_in > 0").select(F.col("entity").alias("at"), "total_in")
    if within is not None:
        linked = linked.join(within, "entity", "left").withColumn("tx_count", F.col("tx_count") + F.coalesce("n", F.lit(0)))
    service = (F.col("tx_count") >= max(20, cfg.service_tx)) | (F.col("degree") >= max(5, cfg.service_degree))
    busy = linked.where("fan_out > 0").select(F.col("entity").alias("up"), service.alias("service"), (F.col("fan_out") > 3).alias("many"))
    edges = sides.where("n_out > 0").select(F.col("entity").alias("up"), F.col("peer").alias("at"), F.col("total_out").alias("total"), F.col("first_out").alias("first_ts"))
    edges = materialise(edges.join(busy, "up"), "edges", at["edges"])
    drop(spark, at["pairs"])
    share = 0.45 + 0.55 * F.least(F.lit(1.0), F.col("total") / F.greatest("total_in", "total", F.lit(1e-9)))
    weighed = edges.join(into, "at").select("at", "up", "total", "first_ts", (share * F.when(F.col("service"), 0.6).otherwise(1.0)).alias("strength"), "many")
    before = Window.partitionBy("at", "many").orderBy("first_ts", F.desc("total"), "up").rowsBetween(Window.unboundedPreceding, -1)
    classes = cfg.branching + cfg.max_hops
    own = F.pmod(F.xxhash64("up"), F.lit(classes))
    least = F.least(*[F.coalesce(F.max(F.when(own == k, F.col("strength"))).over(before), F.lit(-1.0)) for k in range(classes)])
    taken = cut(weighed.withColumn("least", least).where("strength > least").drop("least"))
    drop(spark, at["edges"])
    return taken


def trace(flows: DataFrame, roots: DataFrame, cfg: EngineConfig, within: DataFrame | None = None) -> DataFrame:
    """(root, path, score, end): backward paths from ``roots`` (entity) over the strongest early sources.

    An edge weighs its share of what the entity receives, less with depth, for sources with many targets and for service-like ones (many
    transfers, those ``within`` them (entity, n) included, or many counterparties); a path stops where nothing came in, where its score
    falls under the cut-off, or after ``max_hops``.
    """
    edges = source_edges(flows, cfg, within)
    front = roots.select(F.col("entity").alias("root"), F.array("entity").alias("path"), F.lit(1.0).alias("score"))
    ends = []
    for depth in range(cfg.max_hops):
        step = cut(front.join(edges, F.element_at("path", -1) == F.col("at"), "left"))
        sourced = step.where(F.col("up").isNotNull())
        ends.append(step.where(F.col("up").isNull()).select("root", "path", "score", F.lit("no_incoming").alias("end")))
        weight = clamp(F.col("strength") * 0.95**depth * F.when(F.col("many"), 0.9).otherwise(1.0))
        grown = sourced.withColumn("next", F.round(F.col("score") * weight, 6)).where(~F.array_contains("path", F.col("up")) & (F.col("next") >= CUTOFF))
        grown = top_per_group(grown, ["root", "path"], [F.col("first_ts"), F.desc("total"), F.col("up")], cfg.branching)
        stopped = sourced.select("root", "path", "score").distinct().join(grown.select("root", "path").distinct(), ["root", "path"], "left_anti")
        ends.append(stopped.select("root", "path", "score", F.lit("confidence_cutoff").alias("end")))
        front = grown.select("root", F.concat("path", F.array("up")).alias("path"), F.col("next").alias("score"))
    ends.append(front.select("root", "path", "score", F.lit("max_hops_reached").alias("end")))
    return cut(reduce(DataFrame.unionByName, ends))


def trace_hops(flows: DataFrame, traces: DataFrame, most: int = 20) -> DataFrame:
    """(root, path, hop, source, target, tx_hash): the first ``most`` transfers (by time, hash) of each step of each path, from its origin on."""
    steps = traces.select("root", "path", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("back", "target"), F.size("path").alias("n"))
    steps = steps.select("root", "path", "target", F.expr("path[back + 1]").alias("source"), (F.col("n") - 1 - F.col("back")).alias("hop"))
    pairs = cut(steps.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct())
    shown = top_per_group(flows.join(pairs, ["src", "dst"], "left_semi"), ["src", "dst"], [F.col("ts"), F.col("tx_hash")], most)
    return steps.join(shown.select(F.col("src").alias("source"), F.col("dst").alias("target"), "tx_hash"), ["source", "target"]).select("root", "path", "hop", "source", "target", "tx_hash")


def trace_rows(flows: DataFrame, traces: DataFrame) -> DataFrame:
    """(root, origin, path_index, depth, upstream, downstream, score, is_terminal, reason, value, first_ts, last_ts): a row for each hop of each path, from its origin on.

    Paths of a root are numbered from 1, the best score first, then by path. The last hop, at the root, is terminal and has the reason; a path of one node has one row, at depth 0.
    """
    own = traces.select("root", F.reverse("path").alias("nodes"), "score", F.col("end").alias("reason"))
    own = own.withColumn("path_index", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "nodes")))
    hops = F.when(F.size("nodes") > 1, F.arrays_zip(F.expr("slice(nodes, 1, size(nodes) - 1)").alias("upstream"), F.expr("slice(nodes, 2, size(nodes) - 1)").alias("downstream")))
    alone = F.array(F.struct(F.get("nodes", 0).alias("upstream"), F.lit(None).cast("string").alias("downstream")))
    each = cut(own.select("root", F.get("nodes", 0).alias("origin"), "path_index", F.size("nodes").alias("n"), "score", "reason", F.posexplode(F.coalesce(hops, alone)).alias("depth", "hop")).select("*", "hop.upstream", "hop.downstream"))
    last = F.col("depth") == F.greatest(F.col("n") - 2, F.lit(0))
    # only the pairs of a hop are summed
    pairs = cut(each.select("upstream", "downstream").distinct())
    edges = flows.select(F.col("src").alias("upstream"), F.col("dst").alias("downstream"), "value", "ts").join(pairs, ["upstream", "downstream"], "left_semi")
    edges = edges.groupBy("upstream", "downstream").agg(exact_sum("value").alias("value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    met = each.join(edges, ["upstream", "downstream"], "left")
    return met.select("root", "origin", "path_index", "depth", "upstream", "downstream", "score", last.cast("int").alias("is_terminal"), F.when(last, F.col("reason")).alias("reason"), F.coalesce("value", F.lit(0.0)).alias("value"), "first_ts", "last_ts")


def behavior_profiles(traces: DataFrame, ranked: DataFrame) -> DataFrame:
    """(entity, behavior, confidence, relation, rank) of trace origins: each behaviour's strongest sign, an origin's own whole, those of its roots at 0.92; the best first."""
    linked = traces.select(F.element_at("path", -1).alias("entity"), F.col("root").alias("of")).distinct()
    linked = linked.unionByName(linked.select("entity", F.col("entity").alias("of"))).distinct()
    own = linked.join(ranked.select(F.col("entity").alias("of"), "behavior", F.col("confidence").alias("c")), "of")
    signs = own.withColumn("relation", F.when(F.col("of") == F.col("entity"), "origin").otherwise("downstream"))
    signs = signs.withColumn("confidence", F.round(F.col("c") * F.when(F.col("relation") == "origin", 1.0).otherwise(0.92), 4))
    best = top_per_group(signs, ["entity", "behavior"], [F.desc("confidence"), F.desc("relation")], 1).select("entity", "behavior", "confidence", "relation")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("confidence"), F.desc("behavior"))))


def scores(traces: DataFrame, ranked: DataFrame, profiles: DataFrame, flows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(entity, behavior_score, graph_score, temporal_score, history, score): trace origins by behaviour (own or downstream), place in the graph and time.

    Time is the mean of how much later than the origin each root was first seen. Origins that receive from a suspicious entity have a history and count less.
    """
    best = ranked.groupBy("entity").agg(F.max("confidence").alias("best"))
    paths = traces.select(F.element_at("path", -1).alias("entity"), "root", (F.size("path") - 1).alias("depth"), "score")
    seen = profiles.select("entity", "first_seen")
    graph = paths.groupBy("entity").agg(F.max("depth").alias("depth"), F.round(F.avg("score"), 6).alias("path_score"))
    roots = paths.select("entity", "root").distinct().join(best.select(F.col("entity").alias("root"), F.col("best").alias("below")), "root", "left")
    roots = roots.join(seen.select(F.col("entity").alias("root"), F.col("first_seen").alias("root_seen")), "root").join(seen, "entity")
    later = F.greatest(F.lit(0.0), F.col("root_seen") - F.col("first_seen")).cast("decimal(24,6)")
    roots = roots.groupBy("entity").agg(F.max("below").alias("below"), (F.sum(later).cast("double") / F.count("*")).alias("gap"))
    # most origins receive nothing, so few flows are looked at
    fed = cut(graph.select("entity").join(profiles.where("n_in > 0").select("entity"), "entity", "left_semi"))
    sources = flows.select(F.col("src").alias("up"), F.col("dst").alias("entity")).join(fed, "entity", "left_semi").distinct()
    history = sources.join(best.select(F.col("entity").alias("up")), "up", "left_semi").select("entity").distinct().withColumn("history", F.lit(True))
    own = graph.join(roots, "entity").join(best, "entity", "left").join(profiles.select("entity", "n_in"), "entity").join(history, "entity", "left").where("best is not null or below is not null")
    origin, below = F.coalesce("best", F.lit(0.0)), F.coalesce("below", F.lit(0.0))
    behaviour = clamp(F.greatest(origin, below * F.when(origin > 0, 1.0).otherwise(0.88)))
    first = F.when(F.col("n_in") == 0, 1.0).otherwise(0.7)
    graph_score = clamp(0.45 * first + 0.25 * F.least(F.lit(1.0), F.col("depth") / float(max(1, cfg.max_hops))) + 0.30 * F.col("path_score"))
    temporal = clamp(0.55 * F.least(F.lit(1.0), F.col("gap") / float(max(86400.0, cfg.smurf_max_age))) + 0.45 * first)
    known = F.coalesce("history", F.lit(False))
    total = F.round(clamp((0.4 * behaviour + 0.4 * graph_score + 0.2 * temporal) * F.when(known, 0.8).otherwise(1.0)), 4)
    out = own.select("entity", F.round(behaviour, 4).alias("behavior_score"), F.round(graph_score, 4).alias("graph_score"), F.round(temporal, 4).alias("temporal_score"), known.alias("history"), total.alias("score"))
    return out.where(F.col("score") >= LEAST)


def labels(traces: DataFrame, placed: DataFrame, ranked: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """(entity, label, confidence): origins, suspicious receivers that are none, and what else lies between, at 0.9 of its ``validation`` (entity, confidence)."""
    origins = placed.select("entity", F.lit("placement_origin").alias("label"), F.col("score").alias("confidence"))
    best = ranked.groupBy("entity").agg(F.max("confidence").alias("confidence"))
    receivers = best.join(placed, "entity", "left_anti").select("entity", F.lit("suspicious_receiver").alias("label"), "confidence")
    between = traces.where("size(path) > 2").select(F.explode(F.expr("slice(path, 2, size(path) - 2)")).alias("entity")).distinct()
    between = between.join(placed, "entity", "left_anti").join(best, "entity", "left_anti")
    if validation is None:
        between = between.withColumn("confidence", F.lit(None).cast("double"))
    else:
        between = between.join(validation.select("entity", F.round(F.col("confidence") * 0.9, 4).alias("confidence")), "entity", "left")
    return origins.unionByName(receivers).unionByName(between.select("entity", F.lit("intermediate_node").alias("label"), "confidence"))


#: Confidence in an entity by where it comes from.
VALIDATION = {"existing": 0.82, "enhanced": 0.72, "generated": 0.64, "address_fallback": 0.48}


def resolve_entities(transfers: DataFrame, links: DataFrame, clusters: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(address, entity, entity_type, source_kind, confidence, n_addresses, signals) of every address that transfers.

    Addresses start as their cluster in ``clusters`` (address, cluster_id) or alone. Heuristic pairs ``links`` (a, b, name) that pass the gate merge
    them; so do members of one strongly connected component of at most ``max_pattern_size`` that have another signal too.
    An entity keeps the id of a cluster that it equals; others are named by their members.
    """
    every = transfers.select(F.col("from_address").alias("address")).unionByName(transfers.select(F.col("to_address").alias("address"))).where("address is not null and address <> ''").distinct()
    seeded = materialise(every.join(clusters.select("address", "cluster_id"), "address", "left").withColumn("seed", F.coalesce("cluster_id", F.concat(F.lit("ADDR::"), "address"))), "seeds")

    def by_seed(pairs: DataFrame) -> DataFrame:
        a, b = (seeded.select(F.col("address").alias(c), F.col("seed").alias(f"s{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").where("sa <> sb").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"), "name")

    own = by_seed(links.join(gate(links, cfg), ["a", "b"], "left_semi"))
    flow = transfers.where("from_address <> to_address").select(F.col("from_address").alias("a"), F.col("to_address").alias("b")).distinct()
    strong = strongly_connected(flow)
    small = strong.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n").between(2, max(10, cfg.max_pattern_size))).select("component")
    # strong connectivity needs a second signal, so only pairs that have one are looked up
    side = lambda c: strong.join(small, "component", "left_semi").join(seeded.select(F.col("address").alias("node"), "seed"), "node").select(F.col("seed").alias(c), F.col("component").alias(f"c{c}")).distinct()
    shared = own.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where("ca = cb").select("a", "b").distinct()
    signals = materialise(own.unionByName(shared.withColumn("name", F.lit("strong_connectivity"))).distinct(), "signals")
    accepted = gate(signals, cfg).select("a", "b").unionByName(shared).distinct()
    roots = connected_components(accepted)
    named = seeded.join(roots.withColumnRenamed("node", "seed"), "seed", "left").withColumn("root", F.coalesce("root", "seed"))
    merged = signals.join(accepted, ["a", "b"], "left_semi").join(roots.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.array_sort(F.collect_set("name")).alias("signals"))
    held = seeded.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("held"))
    group = named.groupBy("root").agg(F.count("*").alias("n_addresses"), F.countDistinct("cluster_id").alias("k"), F.min("cluster_id").alias("cluster_id"), stable_id("PCL-", F.collect_list("address")).alias("made"), F.min("address").alias("only"))
    group = group.join(held, "cluster_id", "left").join(merged, "root", "left")
    kind = F.when((F.col("k") == 0) & (F.col("n_addresses") == 1), "address_fallback").when((F.col("k") == 1) & (F.col("held") == F.col("n_addresses")), "existing").when(F.col("k") > 0, "enhanced").otherwise("generated")
    group = group.withColumn("source_kind", kind).withColumn("signals", F.coalesce("signals", F.array().cast("array<string>")))
    entity = F.when(F.col("source_kind") == "address_fallback", F.col("only")).when(F.col("source_kind") == "existing", F.col("cluster_id")).otherwise(F.col("made"))
    base = F.create_map(*[F.lit(x) for kv in VALIDATION.items() for x in kv])[F.col("source_kind")]
    sure = base + F.least(F.lit(0.12), (F.col("n_addresses") - 1) * 0.02) + F.least(F.lit(0.16), F.size("signals") * 0.04)
    group = group.select("root", entity.alias("entity"), F.when(F.col("source_kind") == "address_fallback", "address").otherwise("cluster").alias("entity_type"), "source_kind", F.round(clamp(sure), 4).alias("confidence"), "n_addresses", "signals")
    return named.select("address", "root").join(group, "root").drop("root")
