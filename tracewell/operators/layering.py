"""Layering detectors over seed addresses.

Walks are a bounded number of joins, and one-to-one matching at a bridge is rounds of them. Only walks and communities within a
seed's neighbourhood, of at most NEAR_NODES or SHELL_NODES nodes, run as grouped-map kernels.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import clamp
from tracewell.operators.graph import ego_density
from tracewell.operators.joins import interval_join
from tracewell.sources.storage import cut, materialise

NEAR_NODES, SHELL_NODES = 80, 60
SERVICES = ("mixer", "bridge", "exchange")


def address_labels(transfers: DataFrame, registry: DataFrame, methods: DataFrame, min_tx: int = 200, min_degree: int = 25) -> DataFrame:
    """(address, labels): registered categories, those of methods called on it, and service_like for busy addresses without one."""
    called = transfers.join(methods, "method_id").select(F.col("to_address").alias("address"), "category")
    named = registry.select("address", "category").unionByName(called).distinct()
    sides = transfers.select(F.col("from_address").alias("address"), F.col("to_address").alias("peer")).unionByName(transfers.select(F.col("to_address").alias("address"), F.col("from_address").alias("peer")))
    busy = sides.groupBy("address").agg(F.count("*").alias("n"), F.countDistinct("peer").alias("d")).where((F.col("n") >= min_tx) | (F.col("d") >= min_degree)).select("address")
    busy = busy.join(named.where(F.col("category").isin(*SERVICES)), "address", "left_anti").withColumn("category", F.lit("service_like"))
    return named.unionByName(busy).groupBy("address").agg(F.array_sort(F.collect_set("category")).alias("labels"))


def bridge_candidates(transfers: DataFrame, bridges: DataFrame, tolerance: float, latency: float) -> DataFrame:
    """(bridge, deposit, withdrawal, cost, ...): withdrawals that could be a deposit's, in time and amount."""
    into = transfers.join(bridges.select(F.col("address").alias("to_address")), "to_address", "left_semi").select(F.col("to_address").alias("bridge"), F.col("tx_hash").alias("deposit"), F.col("from_address").alias("source"), F.col("ts").alias("dts"), F.col("value").alias("dv"))
    out = transfers.join(bridges.select(F.col("address").alias("from_address")), "from_address", "left_semi").select(F.col("from_address").alias("bridge"), F.col("tx_hash").alias("withdrawal"), F.col("to_address").alias("target"), F.col("ts").alias("wts"), F.col("value").alias("wv"))
    diff = F.abs(F.col("dv") - F.col("wv")) / F.greatest("dv", F.lit(1e-9))
    met = interval_join(into, out, ["bridge"], "dts", "wts", latency, also=diff <= tolerance)
    return met.withColumn("cost", F.round(diff + (F.col("wts") - F.col("dts")) / latency, 9))


def match_bridges(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs: deposits in order of time (ties: hash) take the cheapest withdrawal left (ties: time, hash).

    In rounds, for any number of transfers at one bridge: each deposit proposes to the cheapest withdrawal open to it, each
    withdrawal holds the earliest proposer, and is closed to later deposits from then on. When no round refuses
    anyone, the pairs are those that deposits in turn would have taken.
    """
    names, left = candidates.columns, materialise(candidates, "bridge-candidates")
    while True:
        choice = Window.partitionBy("bridge", "deposit").orderBy("cost", "wts", "withdrawal")
        order = Window.partitionBy("bridge", "withdrawal").orderBy("dts", "deposit")
        proposed = left.withColumn("r", F.row_number().over(choice)).where("r = 1")
        judged = materialise(proposed.withColumn("h", F.row_number().over(order)), "bridge-proposals")
        if judged.where("h > 1").isEmpty():
            return judged.select(*names)
        held = judged.where("h = 1").select("bridge", "withdrawal", F.struct("dts", "deposit").alias("holder"))
        open_ = left.join(held, ["bridge", "withdrawal"], "left").where(F.col("holder").isNull() | (F.struct("dts", "deposit") <= F.col("holder")))
        left = materialise(open_.select(*names), "bridge-candidates")


def is_fresh(first_seen: Column, observed_at: Column, degree: Column, age: float, most: int = 2) -> Column:
    """An address that was first seen shortly before and has few counterparties; unknown ones are not fresh."""
    return F.coalesce((F.greatest(F.lit(0.0), observed_at - first_seen) <= age) & (F.coalesce(degree, F.lit(0)) <= most), F.lit(False))


def bridge_hopping(pairs: DataFrame, seeds: DataFrame, stats: DataFrame, latency: float, min_pairs: int = 1) -> DataFrame:
    """(seed, confidence, n_pairs): matched pairs with a seed on either side; fresh targets by ``stats`` (address, first_seen, degree) weigh more."""
    own = pairs.join(stats.select(F.col("address").alias("target"), "first_seen", "degree"), "target", "left")
    alike = 1 - F.abs(F.col("dv") - F.col("wv")) / F.greatest("dv", F.lit(1e-9))
    fresh = is_fresh(F.col("first_seen"), F.col("wts"), F.col("degree"), latency)
    conf = 0.40 * alike + 0.30 * F.exp(-(F.col("wts") - F.col("dts")) / latency) + 0.20 + 0.10 * F.when(fresh, 1.0).otherwise(0.45)
    own = own.withColumn("c", F.round(clamp(conf), 4)).withColumn("seed", F.explode(F.array_distinct(F.array("source", "target"))))
    mean = F.avg(F.col("c").cast("decimal(12,4)")).cast("double")
    hit = own.join(seeds.select("seed"), "seed", "left_semi").groupBy("seed").agg(F.round(mean, 4).alias("confidence"), F.count("*").alias("n_pairs"))
    return hit.where((F.col("n_pairs") >= min_pairs) & ~((F.col("confidence") < 0.45) & (F.col("n_pairs") < 2)))


def peeling_chain(
    transfers: DataFrame, seeds: DataFrame, min_hops: int = 3, max_hops: int = 6, decay: float = 0.02, low: float = 0.01, high: float = 0.35, gap: float = 7200.0, exchanges: DataFrame | None = None
) -> DataFrame:
    """(seed, path, hops, fragment_share, confidence): chains that pass most of an amount on and peel a small part off at each hop.

    At each hop the transfers within ``gap`` of the first later one count; the target of most value (ties: earliest, then greatest) is the
    main one. ``exchanges`` (address) at the end of a chain weaken it.
    """
    out = transfers.where("from_address <> to_address").select(F.col("from_address").alias("at"), F.col("to_address").alias("target"), "ts", "value")
    none = F.array().cast("array<double>")
    front = seeds.select("seed", F.array("seed").alias("path"), F.lit(0.0).alias("since"), none.alias("mains"), none.alias("fragments"), none.alias("times"))
    kept = None
    for hop in range(1, max_hops + 1):
        step = front.withColumn("at", F.element_at("path", -1)).join(out, "at").where("ts >= since")
        whole = Window.partitionBy("seed")
        first = step.withColumn("t0", F.min("ts").over(whole)).where(F.col("ts") <= F.col("t0") + gap)
        per = first.groupBy("seed", "path", "mains", "fragments", "times", "target").agg(F.round(F.sum("value"), 8).alias("v"), F.min("ts").alias("t"))
        w = Window.partitionBy("seed").orderBy(F.desc("v"), "t", F.desc("target"))
        ranked = per.withColumns({"r": F.row_number().over(w), "targets": F.count("*").over(whole), "all": F.sum("v").over(whole)}).where("r = 1 and targets >= 2")
        ranked = ranked.withColumn("fragment", (F.col("all") - F.col("v")) / F.greatest("v", F.lit(1e-9)))
        falls = (F.size("mains") == 0) | (F.col("v") <= F.element_at("mains", -1) * (1 - decay)) if hop > 1 else F.lit(True)
        fits = (F.col("v") > 0) & (F.col("fragment") > 0) & F.col("fragment").between(low, high) & ~F.array_contains("path", F.col("target")) & falls
        more = lambda c, x: F.concat(c, F.array(x)).alias(c)
        front = cut(ranked.where(fits).select("seed", more("path", "target"), F.col("t").alias("since"), more("mains", "v"), more("fragments", "fragment"), more("times", "t")))
        if hop >= min_hops:
            done = front.withColumn("hops", F.lit(hop))
            kept = done if kept is None else kept.unionByName(done)
    kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("hops")))).where("r = 1")
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y) / F.greatest(F.size(x), F.lit(1))
    steps = lambda c, f: F.transform(F.arrays_zip(F.slice(c, 1, F.size(c) - 1).alias("x"), F.slice(c, 2, F.size(c)).alias("y")), lambda p: f(p["x"], p["y"]))
    average = mean(F.col("fragments"))
    spread = F.sqrt(mean(F.transform("fragments", lambda x: F.pow(x - average, 2))))
    parts = (
        (0.30, F.least(F.lit(1.0), F.col("hops") / float(min_hops + 1))),
        (0.25, mean(steps("mains", lambda x, y: (y < x).cast("double")))),
        (0.20, clamp(1 - spread / average)),
        (0.15, mean(steps("times", lambda x, y: F.exp(-F.greatest(F.lit(0.0), y - x) / gap)))),
        (0.10, mean(F.transform("fragments", lambda x: 1 / (1 + x)))),
    )
    if exchanges is not None:
        kept = kept.join(exchanges.select(F.col("address").alias("last"), F.lit(0.8).alias("weaker")).distinct(), F.element_at("path", -1) == F.col("last"), "left")
    weaker = F.coalesce("weaker", F.lit(1.0)) if exchanges is not None else F.lit(1.0)
    confidence = F.round(clamp(sum((part * weight for weight, part in parts), F.lit(0.0)) * weaker), 4)
    return kept.select("seed", "path", "hops", F.round(average, 6).alias("fragment_share"), confidence.alias("confidence"))


def follow_on(transfers: DataFrame, interactions: DataFrame, gap: float, tolerance: float, fresh: bool = False, services: DataFrame | None = None) -> DataFrame:
    """(tx_hash, follow): transfers that leave a service soon after one came in, of about the same amount, to an address other than the sender.

    With ``fresh`` the target must have been seen first within ``gap`` before it; targets among ``services`` (address) don't count.
    """
    into = transfers.join(interactions.select(F.col("address").alias("to_address")), "to_address", "left_semi").select(F.col("to_address").alias("node"), "tx_hash", F.col("from_address").alias("source"), F.col("ts").alias("its"), F.col("value").alias("iv"))
    out = transfers.join(interactions.select(F.col("address").alias("from_address")), "from_address", "left_semi")
    if services is not None:
        out = out.join(services.select(F.col("address").alias("to_address")), "to_address", "left_anti")
    if fresh:
        ends = transfers.select(F.col("from_address").alias("to_address"), "ts").unionByName(transfers.select("to_address", "ts"))
        first = ends.join(out.select("to_address").distinct(), "to_address", "left_semi").groupBy("to_address").agg(F.min("ts").alias("first_ts"))
        out = out.join(first, "to_address").where(F.col("ts") - F.col("first_ts") <= gap)
    out = out.select(F.col("from_address").alias("node"), F.col("tx_hash").alias("follow"), F.col("to_address").alias("target"), F.col("ts").alias("ots"), F.col("value").alias("ov"))
    like = F.abs(F.col("iv") - F.col("ov")) <= F.col("iv") * tolerance
    return interval_join(into, out, ["node"], "its", "ots", gap, also=like).where("source <> target").select("tx_hash", "follow")


def mixing_interaction(transfers: DataFrame, seeds: DataFrame, mixers: DataFrame, min_tx: int = 2, gap: float = 21600.0, tolerance: float = 0.05, min_density: float = 0.18) -> DataFrame:
    """(seed, confidence, n): seeds with repeated, concealed or dense dealings with mixers."""
    own = transfers.join(seeds.select(F.col("seed").alias("from_address")), "from_address", "left_semi").join(mixers.select(F.col("address").alias("to_address")), "to_address", "left_semi")
    n = own.groupBy(F.col("from_address").alias("seed")).agg(F.count("*").alias("n"), F.countDistinct("to_address").alias("mixers")).where(F.col("n") >= min_tx)
    denominations = own.groupBy(F.col("from_address").alias("seed"), F.round("value", 3).alias("v")).agg(F.count("*").alias("k")).where("k >= 2").groupBy("seed").agg(F.count("*").alias("denominations"))
    hidden = own.join(follow_on(transfers, mixers, gap, tolerance), "tx_hash").groupBy(F.col("from_address").alias("seed")).agg(F.count("*").alias("concealed"))
    edges = transfers.select(F.col("from_address").alias("a"), F.col("to_address").alias("b")).distinct()
    density = ego_density(edges, mixers.select(F.col("address").alias("node"))).agg(F.max("density").alias("density"))
    w = Window.partitionBy("from_address").orderBy("ts", "tx_hash")
    gaps = own.withColumn("g", F.col("ts") - F.lag("ts").over(w)).groupBy(F.col("from_address").alias("seed")).agg(F.coalesce(F.avg(F.exp(-F.col("g") / gap)), F.lit(0.5)).alias("delay"))
    rows = n.join(denominations, "seed", "left").join(hidden, "seed", "left").join(gaps, "seed").crossJoin(F.broadcast(density)).fillna({"denominations": 0, "concealed": 0, "density": 0.0})
    fire = (F.col("denominations") >= 1) | (F.col("concealed") >= 1) | (F.col("mixers") >= 2) | (F.col("density") >= min_density)
    conf = 0.30 + 0.25 * F.least(F.lit(1.0), F.col("n") / (min_tx + 1.0)) + 0.20 * F.greatest(F.least(F.lit(1.0), F.col("denominations") / 1.0), F.least(F.lit(1.0), F.col("concealed") / 2.0)) + 0.15 * clamp(F.col("density") / min_density) + 0.10 * F.col("delay")
    return rows.where(fire).select("seed", F.round(clamp(conf), 4).alias("confidence"), "n")


def layering_motion(transfers: DataFrame, members: DataFrame, window: float) -> DataFrame:
    """(community, tx_hash) of transfers within a community (address, community) that another one within it follows on from."""
    a = members.select(F.col("address").alias("from_address"), "community")
    b = members.select(F.col("address").alias("to_address"), F.col("community").alias("other"))
    own = transfers.join(a, "from_address").join(b, "to_address").where("community = other")
    left = own.select("community", F.col("to_address").alias("node"), "tx_hash", F.col("ts").alias("lts"))
    right = own.select("community", F.col("from_address").alias("node"), F.col("ts").alias("rts"))
    return interval_join(left, right, ["community", "node"], "lts", "rts", window, "left_semi").select("community", "tx_hash").distinct()


def window_activity(transfers: DataFrame, width: float) -> DataFrame:
    """(window_start, n, total) of windows of ``width`` every half width from the first time, both ends included."""
    ends = transfers.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    half = width / 2
    own = transfers.crossJoin(F.broadcast(ends)).withColumn("k", F.floor((F.col("ts") - F.col("t0")) / half))
    last = F.greatest(F.lit(0), F.floor((F.col("t1") - F.col("t0") - 1e-9) / half))
    hits = own.withColumn("j", F.explode(F.sequence(F.greatest(F.lit(0), F.col("k") - 2), F.least(last, F.col("k")))))
    start = F.col("t0") + F.col("j") * half
    inside = hits.withColumn("window_start", start).where((F.col("ts") >= F.col("window_start")) & (F.col("ts") <= F.col("window_start") + width))
    return inside.groupBy("window_start").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


def personalised_rank(edges: list[tuple[str, str, float]], seed: str, alpha: float = 0.85) -> dict[str, float]:
    """Power iteration towards ``seed`` over weighted edges; dangling mass returns to it."""
    nodes = sorted({seed, *(x for e in edges for x in e[:2])})
    at = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for u, v, w in edges:
        m[at[v], at[u]] += w
    out = m.sum(axis=0)
    m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    jump = np.zeros(len(nodes))
    jump[at[seed]] = 1.0
    x = jump.copy()
    for _ in range(100):
        y = alpha * (m @ x + x[out == 0].sum() * jump) + (1 - alpha) * jump
        done, x = np.abs(y - x).sum() < 1e-6 * len(nodes), y
        if done:
            break
    return dict(zip(nodes, x, strict=True))


def seed_neighbourhoods(transfers: DataFrame, seeds: DataFrame, hops: int, most: int, both_ways: bool = False, without: DataFrame | None = None) -> DataFrame:
    """(seed, transfer columns) of transfers among the ``most`` nearest nodes (ties: by name) that a seed reaches in ``hops`` steps, along transfers or ``both_ways``.

    Addresses in ``without`` (address) other than the seed itself are neither reached nor kept.
    """
    step = transfers.where("from_address <> to_address").select(F.col("from_address").alias("u"), F.col("to_address").alias("v"))
    if both_ways:
        step = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
    step = step.distinct()
    if without is not None:
        step = step.join(without.select(F.col("address").alias("v")).distinct(), "v", "left_anti")
    found = front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    near = Window.partitionBy("seed").orderBy("hop", "node")
    for hop in range(1, hops + 1):
        # a step never needs more than the ``most`` nearest, so a hub does not spread whole
        new = front.join(step, F.col("node") == F.col("u")).select("seed", F.col("v").alias("node")).distinct().join(found, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        front = cut(new.withColumn("r", F.row_number().over(near)).where(F.col("r") <= most).drop("r"))
        found = found.unionByName(front)
    found = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= most)
    a = found.select("seed", F.col("node").alias("from_address"))
    b = found.select("seed", F.col("node").alias("to_address"))
    own = transfers.where("from_address <> to_address").join(a, "from_address").join(b, ["seed", "to_address"]).select("seed", "tx_hash", "from_address", "to_address", "ts", "value")
    if without is not None:
        gone = without.select("address").distinct()
        own = own.join(gone.withColumnRenamed("address", "from_address"), "from_address", "left_anti").join(gone.withColumnRenamed("address", "to_address"), "to_address", "left_anti")
    return own.select("seed", "tx_hash", "from_address", "to_address", "ts", "value")


def high_depth(
    transfers: DataFrame, seeds: DataFrame, max_depth: int = 6, min_depth: int = 4, branching: int = 3, retention: float = 0.55, latency: float = 86400.0, least: float = 0.58, exchanges: DataFrame | None = None
) -> DataFrame:
    """(seed, path, depth, score): up to three long forward walks that keep most of the amount and move quickly, the best first.

    Walks stay among a seed's NEAR_NODES nearest nodes and follow the ``branching`` best transfers of each by rank from the seed, retention
    and delay. ``exchanges`` (address) at the end of a walk weaken it. Python sees one seed's neighbourhood at a time.
    """

    def walks(rows: pd.DataFrame) -> pd.DataFrame:
        seed = rows["seed"].iloc[0]
        by: dict[str, list] = defaultdict(list)
        weight: dict[tuple[str, str], float] = defaultdict(float)
        ends = {r.to_address for r in rows.itertuples(index=False) if r.exchange}
        for r in rows.sort_values(["ts", "tx_hash"]).itertuples(index=False):
            by[r.from_address].append(r)
            weight[r.from_address, r.to_address] += r.value + 1
        rank = personalised_rank([(u, v, w) for (u, v), w in weight.items()], seed)
        top, found = max(rank.values()), []

        def onward(path, last):
            for e in by[path[-1]]:
                kept = 1.0 if last is None else e.value / max(last.value, 1e-9)
                wait = 0.0 if last is None else e.ts - last.ts
                if e.to_address not in path and kept >= retention * (last is not None) and 0 <= wait <= latency:
                    yield rank.get(e.to_address, 0.0) * kept * math.exp(-wait / latency), e.value, e.ts, e

        def walk(path, last):
            options = sorted(onward(path, last), key=lambda x: x[:3], reverse=True)[:branching] if len(path) <= max_depth else []
            for *_, e in options:
                walk([*path, e.to_address], e)
            if not options and len(path) > min_depth:
                found.append(path)

        walk([seed], None)
        out = []
        for path in found:
            hops = [min((e for e in by[u] if e.to_address == v), key=lambda e: (e.ts, e.tx_hash)) for u, v in zip(path, path[1:], strict=False)]
            pairs = list(zip(hops, hops[1:], strict=False))
            kept = np.mean([min(1.0, b.value / max(a.value, 1e-9)) for a, b in pairs]) if pairs else 1.0
            quick = np.mean([math.exp(-max(0.0, b.ts - a.ts) / latency) for a, b in pairs]) if pairs else 1.0
            branches = float(np.mean([len(by[u]) for u in path[:-1]]))
            narrow = min(1.0, max(0.0, 1 - max(0.0, branches - 1) / max(1.0, branching)))
            near = np.mean([rank[v] for v in path]) / max(top, 1e-9)
            score = 0.25 * min(1.0, len(hops) / max_depth) + 0.25 * kept + 0.20 * quick + 0.15 * narrow + 0.15 * near
            score = min(1.0, score) * (0.75 if path[-1] in ends else 1.0)
            if score >= least:
                out.append((seed, ">".join(path), len(hops), round(float(score), 4), branches))
        out.sort(key=lambda r: (-r[3], -r[2], r[4], r[1]))
        return pd.DataFrame([r[:4] for r in out[:3]], columns=["seed", "path", "depth", "score"])

    own = seed_neighbourhoods(transfers, seeds, max_depth, NEAR_NODES)
    if exchanges is None:
        own = own.withColumn("exchange", F.lit(False))
    else:
        own = own.join(exchanges.select(F.col("address").alias("to_address"), F.lit(True).alias("exchange")).distinct(), "to_address", "left").fillna(False, ["exchange"])
    return own.groupBy("seed").applyInPandas(walks, "seed string, path string, depth int, score double")


def _neighbours(weights: dict[tuple[str, str], float]) -> dict[str, dict[str, float]]:
    """Each node's neighbours with weights; what a node has within itself counts twice, once an end."""
    near: dict[str, dict[str, float]] = defaultdict(dict)
    for (u, v), w in sorted(weights.items()):
        near[u][v] = near[u].get(v, 0.0) + w
        near[v][u] = near[v].get(u, 0.0) + w
    return near


def modularity(weights: dict[tuple[str, str], float], groups: list[set[str]]) -> float:
    """The share of weight within ``groups`` less the share that ends of the same weights, dealt out at random, would have there."""
    near = _neighbours(weights)
    whole = sum(sum(x.values()) for x in near.values())
    inside = sum(w for g in groups for u in g for v, w in near[u].items() if v in g)
    return inside / whole - sum((sum(sum(near[u].values()) for u in g) / whole) ** 2 for g in groups)


def local_communities(weights: dict[tuple[str, str], float]) -> list[set[str]]:
    """Communities of an undirected graph by local moves of modularity: nodes in order of name join the neighbouring community of most gain until none moves."""
    near = _neighbours(weights)
    degree = {u: sum(x.values()) for u, x in near.items()}
    whole, own = sum(degree.values()), {u: u for u in near}
    total = dict(degree)
    for _ in range(20):
        moved = False
        for u in sorted(near):
            total[own[u]] -= degree[u]
            links: dict[str, float] = defaultdict(float)
            for v, w in near[u].items():
                if v != u:
                    links[own[v]] += w
            links.setdefault(own[u], 0.0)
            gain = {c: w - total[c] * degree[u] / whole for c, w in links.items()}
            best = min(gain, key=lambda c: (-round(gain[c], 12), c != own[u], c))
            moved |= best != own[u]
            own[u] = best
            total[best] += degree[u]
        if not moved:
            break
    out: dict[str, set[str]] = defaultdict(set)
    for u, c in own.items():
        out[c].add(u)
    return list(out.values())


def louvain(weights: dict[tuple[str, str], float]) -> list[set[str]]:
    """Communities by levels: those of local moves become the nodes of a smaller graph, named by their least members, until a level joins none.

    A level keeps or raises modularity. The order is by name throughout, so the result is the same in every run.
    """
    inside = {u: {u} for e in weights for u in e}
    while True:
        groups = local_communities(weights)
        if len(groups) == len({u for e in weights for u in e}):
            return list(inside.values())
        name = {u: min(g) for g in groups for u in g}
        joined: dict[str, set[str]] = defaultdict(set)
        for u, c in name.items():
            joined[c] |= inside[u]
        level: dict[tuple[str, str], float] = defaultdict(float)
        for (u, v), w in weights.items():
            level[min(name[u], name[v]), max(name[u], name[v])] += w
        inside, weights = dict(joined), dict(level)


def shell_networks(
    transfers: DataFrame, seeds: DataFrame, window: float = 43200.0, min_nodes: int = 4, min_ratio: float = 0.72, min_density: float = 0.28, pass_through: float = 21600.0, min_windows: int = 2, services: DataFrame | None = None
) -> DataFrame:
    """(seed, nodes, windows, density, ratio, motion, confidence): the best group around a seed that trades within itself in several windows.

    In each half-overlapping window the seed's group is, of its connected component and its ``louvain`` community, the one
    with the higher score of value kept inside, density and motion (transfers that are passed on within the group). Groups of
    windows of which half the members agree are one. ``services`` (address) are left out. Python sees the transfers among a seed's
    SHELL_NODES nearest nodes.
    """

    def community(own: list, seed: str) -> tuple | None:
        weights: dict[tuple[str, str], float] = defaultdict(float)
        for r in own:
            weights[min(r.from_address, r.to_address), max(r.from_address, r.to_address)] += 1 + math.log1p(r.value)
        near: dict[str, set[str]] = defaultdict(set)
        for u, v in weights:
            near[u].add(v)
            near[v].add(u)
        if len(near) < min_nodes or len(weights) < min_nodes - 1 or seed not in near:
            return None
        seen, front = {seed}, [seed]
        while front:
            front = [v for u in front for v in near[u] if v not in seen and not seen.add(v)]
        best = None
        for nodes in [*(c for c in louvain(weights) if seed in c), seen]:
            if len(nodes) < min_nodes:
                continue
            inside = [r for r in own if r.from_address in nodes and r.to_address in nodes]
            across = sum(r.value for r in own if (r.from_address in nodes) != (r.to_address in nodes))
            kept = sum(r.value for r in inside)
            ratio, density = kept / max(kept + across, 1e-9), len(inside) / (len(nodes) * (len(nodes) - 1))
            passed = sum(any(x.from_address == r.to_address and 0 <= x.ts - r.ts <= pass_through for x in inside) for r in inside)
            motion = passed / len(inside) if inside else 0.0
            score = 0.45 * ratio + 0.35 * density + 0.20 * motion
            if best is None or score > best[0]:
                best = (score, nodes, ratio, density, motion)
        return best

    def groups(rows: pd.DataFrame) -> pd.DataFrame:
        seed, hits = rows["seed"].iloc[0], []
        t0, t1 = rows["ts"].min(), rows["ts"].max()
        starts = [t0] if t1 - t0 <= window else np.arange(t0, t1 + 1e-9, max(window // 2, 1))
        for s in starts:
            own = list(rows[(rows["ts"] >= s) & (rows["ts"] <= s + window)].itertuples(index=False))
            hit = community(own, seed) if len(own) >= min_nodes else None
            if hit and hit[2] >= min_ratio and hit[3] >= min_density:
                hits.append(hit)
        out: list[dict] = []
        for score, nodes, *rest in sorted(hits, key=lambda h: (-h[0], sorted(h[1]))):
            for g in out:
                if len(g["nodes"] & nodes) / len(g["nodes"] | nodes) >= 0.5:
                    g["nodes"], g["score"] = g["nodes"] | nodes, g["score"] + score
                    g["rest"].append(rest)
                    break
            else:
                out.append({"nodes": set(nodes), "score": score, "rest": [rest]})
        out = [g for g in out if len(g["rest"]) >= min_windows]
        found = []
        if out:
            g = max(out, key=lambda g: g["score"])
            ratio, density, motion = np.mean(g["rest"], axis=0)
            of = lambda x: min(1.0, max(0.0, float(x)))
            conf = 0.30 * of(ratio / min_ratio) + 0.25 * of(density / min_density) + 0.20 * of(len(g["rest"]) / len(starts)) + 0.15 * of(motion / 0.5) + 0.10 * of(len(g["nodes"]) / (min_nodes + 2))
            found.append((seed, ",".join(sorted(g["nodes"])), len(g["rest"]), *(round(float(x), 4) for x in (density, ratio, motion, of(conf)))))
        return pd.DataFrame(found, columns=["seed", "nodes", "windows", "density", "ratio", "motion", "confidence"])

    own = seed_neighbourhoods(transfers, seeds, 2, SHELL_NODES, True, services)
    return own.groupBy("seed").applyInPandas(groups, "seed string, nodes string, windows int, density double, ratio double, motion double, confidence double")


def layering_alerts(hits: DataFrame) -> DataFrame:
    """(seed, confidence, layering_score, methods) from (seed, method, confidence)."""
    own = hits.groupBy("seed").agg(F.max("confidence").alias("confidence"), F.round(F.avg("confidence"), 4).alias("layering_score"), F.sort_array(F.collect_list(F.struct(F.col("confidence").alias("c"), F.col("method").alias("m"))), asc=False).alias("s"))
    return own.select("seed", "confidence", "layering_score", F.array_join(F.transform("s", lambda x: x["m"]), ",").alias("methods"))


def alert_details(hits: DataFrame, seeds: DataFrame, evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """An alert for each of ``seeds`` (seed, placement_score, first_ts, last_ts) that a detector hit, with what the detectors say.

    ``hits``: (seed, method, confidence, summary, hashes array, first_ts, last_ts), one a method; ``evidence`` (seed, evidence_id), bridge ``pairs`` (seed). Methods, their scores and reasons
    go by confidence, then name, the greatest first; confidence is the best, layering_score the mean of the rounded ones; hashes and evidence are sorted, each once; times are those
    of the best hit that has one, else the seed's. Hits of other seeds give nothing.
    """
    own = hits.join(seeds.select("seed"), "seed", "left_semi").withColumn("confidence", F.round("confidence", 4))
    ranked = own.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("confidence", "method", "summary", "first_ts", "last_ts")), asc=False).alias("s"))
    each = own.select("seed", F.explode("hashes").alias("h")).distinct().groupBy("seed").agg(F.array_sort(F.collect_list("h")).alias("hashes"))
    signs = evidence.distinct().groupBy("seed").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence"))
    out = ranked.join(seeds, "seed").join(each, "seed", "left").join(signs, "seed", "left").join(pairs.groupBy("seed").agg(F.count("*").alias("bridge_pairs")), "seed", "left")
    field = lambda name: F.transform("s", lambda x: x[name])
    known = lambda name: F.coalesce(F.get(F.array_compact(field(name)), 0), F.col(name))
    total = F.aggregate(F.transform(field("confidence"), lambda c: F.round(c * 10_000).cast("long")), F.lit(0).cast("long"), lambda t, c: t + c)
    none = F.array().cast("array<string>")
    return out.select(
        "seed", F.get(field("confidence"), 0).alias("confidence"), (F.round(total / F.size("s")) / 10_000).alias("layering_score"), "placement_score", field("method").alias("methods"), F.map_from_arrays(field("method"), field("confidence")).alias("scores"), field("summary").alias("reasons"),
        F.coalesce("hashes", none).alias("hashes"), F.coalesce("evidence", none).alias("evidence"), known("first_ts").alias("first_ts"), known("last_ts").alias("last_ts"), F.size("s").alias("detectors"), F.coalesce("bridge_pairs", F.lit(0)).alias("bridge_pairs"),
    )
