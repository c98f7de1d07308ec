"""Strongly connected components of directed edges, in a number of joins that grows with the logarithm of chains and rings.

Three contractions keep which nodes are on one cycle. Pairs with edges both ways are one node. A node with one predecessor joins it, and a node with
one successor that, whole trees at a time: pointers to the roots double, and a ring of such nodes, which no pointer leaves, is a component. Nodes without a
way in or out are on no cycle. What is left, where every node has several ways in and out, is coloured: the least node that reaches each, and that each reaches,
spreads along edges and through the labels of labels, which doubles its reach. Contracted nodes are put back in the opposite order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.graph import connected_components
from tracewell.operators.small import ONE_TASK, finish_strong
from tracewell.sources.storage import materialise


@dataclass
class Forest:
    """Nodes that joined their only neighbour of one side.

    ``roots`` (node, root) of trees, ``levels``: (node, p) with p 1, 2, 4, ... steps up, ``exits`` (node, root, target): edges that leave the tree, or lead to its root.
    """

    roots: DataFrame
    levels: list[DataFrame]
    exits: DataFrame


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select("a", "b").distinct()


def _mapped(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``edges`` between the roots that ``names`` (node, root) gives their ends."""
    a, b = (names.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    met = edges.join(a, "a", "left").join(b, "b", "left")
    return _canonical(met.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))


def _one_way_in(edges: DataFrame) -> tuple[DataFrame, Forest | None, DataFrame | None]:
    """(edges with trees contracted, the trees, (node, component) of rings) for nodes with one predecessor."""
    alone = materialise(edges.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("p")).where("n = 1").select(F.col("b").alias("node"), "p"), "one-way-in")
    if alone.isEmpty():
        return edges, None, None
    many = alone.count()
    # p: 2**k steps up, or the root where that is nearer; low: the least node passed on the way
    step = materialise(alone.join(alone.select(F.col("node").alias("p"), F.lit(True).alias("inner")), "p", "left").select("node", "p", F.coalesce("inner", F.lit(False)).alias("open"), F.least("node", "p").alias("low")), "up")
    levels = [step]
    for _ in range(many.bit_length()):
        if step.where("open").isEmpty():
            break
        above = step.select(F.col("node").alias("p"), F.col("p").alias("pp"), F.col("open").alias("up_open"), F.col("low").alias("up_low"))
        moved = step.join(above, "p", "left")
        still = F.col("open") & F.col("up_open")
        step = materialise(moved.select("node", F.when(F.col("open"), F.col("pp")).otherwise(F.col("p")).alias("p"), still.alias("open"), F.when(F.col("open"), F.least("low", "up_low")).otherwise(F.col("low")).alias("low")), "up")
        levels.append(step)
    # after more steps than there are nodes, who is not at a root goes round a ring, and whom one stands at is on it
    stuck = step.where("open").select("node", "p", "low")
    rings = step.join(stuck.select(F.col("p").alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("component"))
    roots = step.where("not open").select("node", F.col("p").alias("root"))
    # no edge enters a ring or what hangs from it, so no other cycle crosses them
    gone = stuck.select("node")
    left = edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
    outer = left.join(alone.select(F.col("node").alias("b")), "b", "left_anti")
    exits = outer.join(roots.select(F.col("node").alias("a"), "root"), "a").select(F.col("a").alias("node"), "root", F.col("b").alias("target"))
    forest = Forest(roots, [x.where("not open or node <> p").select("node", "p") for x in levels], materialise(exits, "exits"))
    return materialise(_mapped(left, roots), "edges"), forest, rings


def _grown(found: DataFrame, forest: Forest) -> DataFrame:
    """``found`` (node, component), with the nodes of ``forest`` that lie between a root of a component and an edge back into it."""
    root = found.select(F.col("node").alias("root"), F.col("component").alias("of_root"))
    target = found.select(F.col("node").alias("target"), F.col("component").alias("of_target"))
    met = forest.exits.join(root, "root", "left").join(target, "target", "left")
    back = materialise(met.where(F.coalesce("of_root", "root") == F.coalesce("of_target", "target")).select("node").distinct(), "back")
    if back.isEmpty():
        return found
    for level in reversed(forest.levels):
        back = materialise(back.unionByName(level.join(back, "node", "left_semi").select(F.col("p").alias("node"))).distinct(), "back")
    held = forest.roots.join(back, "node", "left_semi").join(root, "root", "left").select("node", "root", F.coalesce("of_root", "root").alias("component"))
    # a root that was on no cycle by itself is on one with these
    own = held.select(F.col("root").alias("node"), "component").distinct().join(found, "node", "left_anti")
    return materialise(found.unionByName(held.select("node", "component")).unionByName(own), "components")


def _trimmed(edges: DataFrame) -> DataFrame:
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, low): the least node that reaches each; what reaches a node's label reaches the node."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    best = materialise(nodes.withColumn("low", F.col("node")), "least")
    while True:
        coming = edges.join(best.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("low").alias("new"))
        step = best.join(coming, "node", "left").select("node", "low", F.least("low", F.coalesce("new", "low")).alias("next"))
        label = step.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        step = materialise(step.join(label, "next").select("node", "low", F.least("next", "beyond").alias("next")), "least")
        best = step.select("node", F.col("next").alias("low"))
        if step.where("next < low").isEmpty():
            return best


def strongly_connected(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of the nodes of directed ``edges`` (a, b) on a cycle of several nodes; component is the least node of it.

    Null ends and self loops are ignored; no edges give no rows. An acyclic chain or a ring of n nodes in any order takes one round of
    log2(n) + 1 joins of pointers; so do trees, and chains with edges both ways. Rounds end when no edges are left, however many that takes; the last
    ``one_task`` edges are left to one task.
    """
    kind = edges.where("false").select(F.col("a").alias("node"), F.col("b").alias("component"))
    current = materialise(_canonical(edges.where("a is not null and b is not null")), "edges")
    done, undo = [], []
    while many := current.count():
        if many <= one_task:
            done.append((len(undo), finish_strong(current)))
            break
        mutual = current.intersect(_turned(current)).where("a < b")
        if not mutual.isEmpty():
            names = materialise(connected_components(mutual, one_task=one_task).select("node", "root"), "mutual")
            undo.append(names)
            current = materialise(_mapped(current, names), "edges")
        for turn in (False, True):
            current, forest, rings = _one_way_in(_turned(current) if turn else current)
            current = _turned(current) if turn else current
            if forest:
                undo.append(forest)
                done.append((len(undo), rings))
        current = materialise(_trimmed(_trimmed(current)), "edges")
        # while contraction takes much away, colouring can wait
        if (left := current.count()) <= one_task or left * 4 < many * 3:
            continue
        reaching, reached = _least_reaching(current), _least_reaching(_turned(current))
        marks = materialise(reaching.withColumnRenamed("low", "f").join(reached.withColumnRenamed("low", "t"), "node"), "marks")
        done.append((len(undo), marks.where("f = t").select("node", F.col("f").alias("component"))))
        a, b = (marks.select(F.col("node").alias(c), F.col("f").alias(f"f{c}"), F.col("t").alias(f"t{c}")) for c in "ab")
        current = materialise(current.join(a, "a").join(b, "b").where("fa = fb and ta = tb and fa <> ta").select("a", "b"), "edges")
    found = kind
    for k in range(len(undo), -1, -1):
        # components that were taken out when k contractions had been made
        found = reduce(DataFrame.unionByName, [c for at, c in done if at == k], found)
        if not k:
            break
        last = undo[k - 1]
        if isinstance(last, Forest):
            found = _grown(found, last)
        else:
            of = found.select(F.col("node").alias("root"), "component")
            inner = last.join(of, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
            found = materialise(inner.unionByName(found.join(last.select("node"), "node", "left_anti")), "components")
    least = found.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("component", "least")
    return found.join(least, "component").select("node", F.col("least").alias("component"))
