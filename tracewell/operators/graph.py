"""Graph operators as bounded joins over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.small import ONE_TASK, finish_components
from tracewell.sources.storage import cut, materialise


def multigraph(transfers: DataFrame) -> DataFrame:
    """Edges with both ends, once a (from, to, hash)."""
    return transfers.where("coalesce(from_address, '') <> '' and coalesce(to_address, '') <> ''").dropDuplicates(["from_address", "to_address", "tx_hash"])


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) both ways of (a, b) pairs, no self loops."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.where("u <> v").distinct()


def pointer_roots(parent: DataFrame) -> DataFrame:
    """(u, p) with p the root of u's chain, of (u, p) where roots point to themselves: pointers double until none moves."""
    while True:
        for _ in range(2):
            before = parent
            up = before.select(F.col("u").alias("p"), F.col("p").alias("next"))
            parent = before.join(up, "p").select("u", F.col("p").alias("last"), F.col("next").alias("p"))
        parent = materialise(parent, "pointers")
        if parent.where("p <> last").isEmpty():
            return parent.select("u", "p")
        parent = parent.select("u", "p")


def connected_components(edges: DataFrame, max_rounds: int = 64, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of each node of the string or number pairs ``edges`` (a, b); root is the least node reachable.

    Each round hooks every node to its least neighbour, follows the chains to their roots and contracts the edges to
    them. A root that stays for two rounds has taken in at least one node, so a component's nodes halve every
    two rounds; a chain of n nodes in any order needs O(log n) joins. Nodes that occur in self loops only are their own
    root; null ends are ignored; no edges give no rows. Hubs meet a map-side combined ``min`` and joins
    that adaptive execution can split. The last ``one_task`` edges are left to one task.
    """

    def canonical(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    given = edges.select("a", "b").where("a is not null and b is not null")
    current, labels = materialise(canonical(given), "edges"), None
    alone = given.where("a = b").select(F.col("a").alias("node")).distinct()
    for _ in range(max_rounds):
        if not (many := current.count()):
            break
        if many <= one_task:
            parent = materialise(finish_components(current), "roots").select(F.col("node").alias("u"), F.col("root").alias("p"))
        else:
            parent = pointer_roots(undirected(current).groupBy("u").agg(F.least("u", F.min("v")).alias("p")))
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("u").alias("root"), "p")
            labels = materialise(labels.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        if many <= one_task:
            break
        a, b = (parent.select(F.col("u").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        current = materialise(canonical(current.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return alone.select("node", F.col("node").alias("root"))
    return labels.unionByName(alone.join(labels, "node", "left_anti").select("node", F.col("node").alias("root")))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop) of nodes within ``hops`` undirected steps of each seed, at their shortest hop."""
    near = undirected(edges)
    found = seeds.select(F.col("node").alias("seed"), F.col("node"), F.lit(0).alias("hop")).distinct()
    front = found
    for hop in range(1, hops + 1):
        step = front.join(near, F.col("node") == F.col("u")).select("seed", F.col("v").alias("node")).distinct()
        front = cut(step.join(found, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(front)
    return found


def bounded_cycles(edges: DataFrame, longest: int = 6) -> DataFrame:
    """(path, length) of simple directed cycles of 2 to ``longest`` distinct nodes, each from its least node.

    Two half paths meet: one goes out from the least node, one comes back to it, each of at most half the length, written once and used for all lengths that
    need it. Halves whose ends no half of the other kind has are left out before they meet.
    """
    step = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")

    def halves(u: str, v: str, most: int) -> dict[int, DataFrame]:
        on = step.select(F.col(u).alias("u"), F.col(v).alias("v"))
        out = {1: on.where("v > u").select(F.col("u").alias("least"), F.col("v").alias("end"), F.array("u", "v").alias("path"))}
        for n in range(2, most + 1):
            grown = out[n - 1].join(on, F.col("end") == F.col("u")).where((F.col("v") > F.col("least")) & ~F.array_contains("path", F.col("v")))
            out[n] = materialise(grown.select("least", F.col("v").alias("end"), F.concat("path", F.array("v")).alias("path")), "half-paths")
        return out

    there, back = halves("a", "b", (longest + 1) // 2), halves("b", "a", longest // 2)
    found = []
    for n in range(2, longest + 1):
        f, b = (n + 1) // 2, n // 2
        home = back[b].select("least", "end", F.slice("path", 2, b - 1).alias("rest")) if b > 1 else back[b].select("least", "end", F.slice("path", 1, 0).alias("rest"))
        met = there[f].join(home, ["least", "end"]).where(~F.arrays_overlap("path", "rest"))
        found.append(met.select(F.concat("path", F.reverse("rest")).alias("path"), F.lit(n).alias("length")))
    return reduce(DataFrame.unionByName, found)


def path_members(cycles: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of nodes on one cycle."""
    each = cycles.select("path", F.explode("path").alias("a"))
    return each.select("a", F.explode("path").alias("b")).where("a < b").distinct()


#: What of a score reaches neighbours at one, two and three steps.
DECAY = (0.6, 0.3, 0.1)


def propagate(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, risk): 1 for sources (node, score), else the most of score * decay over sources at their shortest step, of nodes within reach.

    Each step keeps the greatest source score a node sees over walks of that length, not which source, so there is a row a node
    and step; a walk longer than the shortest counts less and never wins.
    """
    near = undirected(edges)
    front = sources.groupBy("node").agg(F.max("score").alias("score"))
    found = front.select("node", F.lit(1.0).alias("risk"))
    for decay in DECAY:
        front = cut(front.join(near, F.col("node") == F.col("u")).groupBy(F.col("v").alias("node")).agg(F.max("score").alias("score")))
        found = found.unionByName(front.select("node", (F.col("score") * decay).alias("risk")))
    return found.groupBy("node").agg(F.max("risk").alias("risk"))


def ego_density(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """(node, n, m, density) of each centre's neighbourhood with itself: 2m / n(n-1) undirected edges."""
    near = undirected(edges)
    ego = centres.select(F.col("node").alias("c"), F.col("node")).unionByName(centres.join(near, F.col("node") == F.col("u")).select(F.col("node").alias("c"), F.col("v").alias("node"))).distinct()
    pairs = near.where("u < v")
    inside = pairs.join(ego.select("c", F.col("node").alias("u")), "u").join(ego.select("c", F.col("node").alias("v")), ["c", "v"]).groupBy("c").agg(F.count("*").alias("m"))
    n = ego.groupBy("c").agg(F.count("*").alias("n"))
    m = F.coalesce("m", F.lit(0))
    return n.join(inside, "c", "left").select(F.col("c").alias("node"), "n", m.alias("m"), F.when(F.col("n") < 2, 0.0).otherwise(F.round(2 * m / (F.col("n") * (F.col("n") - 1)), 6)).alias("density"))


def graph_tables(transfers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) for a graph store: nodes (address); edges keyed by ends and hash, the last by block and time where one stands several times;
    counts (loaded, skipped), rows with both ends and without. An end that is null or empty has no edge."""
    both = transfers.where("from_address <> '' and to_address <> ''")
    w = Window.partitionBy("from_address", "to_address", "tx_hash").orderBy(F.col("block_number").desc_nulls_last(), F.col("ts").desc_nulls_last(), F.col("value").desc_nulls_last())
    edges = both.withColumn("r", F.row_number().over(w)).where("r = 1").select("from_address", "to_address", "tx_hash", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("block_number", F.lit(0)).alias("block_number"), "ts", F.coalesce("is_contract_call", F.lit(False)).alias("is_contract_call"))
    nodes = both.select(F.explode(F.array("from_address", "to_address")).alias("address")).distinct()
    whole = F.coalesce((F.col("from_address") != "") & (F.col("to_address") != ""), F.lit(False))
    return nodes, edges, transfers.agg(F.count(F.when(whole, 1)).alias("loaded"), F.count(F.when(~whole, 1)).alias("skipped"))
