"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample: each node halves its share of the sample at the median along the
line between two random members. Every vector is routed to its leaf of each tree. A query keeps one
priority queue over all trees, nearest split first, and opens leaves until it has enough candidates;
those are ranked by the exact inner product, a leaf at a time. How many are enough is measured on the sample:
few where vectors lie in clusters, more than there are where they point anywhere. Of equal vectors only
the ``k`` + 1 of least id are indexed, since no more can be among the nearest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.storage import materialise

#: The sample has at most this many numbers in all. Trees have LEAVES leaves, more once those would hold over BLOCK
#: vectors each; larger leaves, and more than QUERIES queries, are dealt in blocks.
SAMPLE_VALUES, LEAVES, BLOCK, QUERIES = 8_000_000, 128, 4096, 16_384
#: Shares of the vectors that a query may open, the recall on the sample that is enough, and sample vectors and queries to measure it.
SHARES, RECALL, PROBED, ASKED = (0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0, 1.2, 1.6, 2.4), 0.95, 20_000, 200


class Forest:
    """Perfect binary trees of hyperplanes; leaf numbers run over all trees."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = trees
        wanted = math.ceil(math.log2(max(LEAVES, rows / BLOCK)))
        self.depth = min(wanted, math.floor(math.log2(len(sample) / 4))) if len(sample) > 8 else 0
        nodes, dim = (1 << self.depth) - 1, sample.shape[1]
        self.normal = np.zeros((trees, nodes, dim), np.float32)
        self.split = np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            parts = {0: np.arange(len(sample))}
            for node in range(nodes):
                own = parts.pop(node)
                a, b = (sample[rng.choice(own, 1)[0]] if len(own) else rng.normal(size=dim) for _ in range(2))
                line = (a - b).astype(np.float32)
                if not (size := np.linalg.norm(line)):
                    line, size = rng.normal(size=dim).astype(np.float32), 1.0
                line = line / max(size, 1e-12)
                along = sample[own] @ line
                cut = np.float32(np.median(along)) if len(own) else np.float32(0)
                self.normal[t, node], self.split[t, node] = line, cut
                parts[2 * node + 1], parts[2 * node + 2] = own[along <= cut], own[along > cut]

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, tree) -> leaf."""
        out = np.zeros((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", vectors, self.normal[t, node]) - self.split[t, node]
                node = 2 * node + 1 + (along > 0)
            out[:, t] = node - (self.leaves - 1) + t * self.leaves
        return out

    def search(self, vector: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
        """Leaves in the order of the shared queue until they hold ``enough`` vectors (counted in every tree)."""
        margins = self.normal @ vector - self.split if self.depth else np.zeros((self.trees, 0))
        queue, first, found, held = [(0.0, t, 0) for t in range(self.trees)], self.leaves - 1, [], 0
        while queue and held < enough:
            far, t, node = heapq.heappop(queue)
            while node < first:
                m = float(margins[t, node])
                near, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (far + m * m, t, other))
                node = near
            leaf = node - first + t * self.leaves
            if counts[leaf]:
                found.append(leaf)
                held += counts[leaf]
        return found


def enough_share(forest: Forest, sample: np.ndarray, k: int) -> float | None:
    """The least of SHARES at which queries of the sample find RECALL of their ``k`` nearest others in it; None if none does, or the sample is too small to tell."""
    own = sample[:PROBED]
    if len(own) <= k + 1:
        return None
    leaf = forest.route(own.astype(np.float32))
    order = np.argsort(leaf, axis=0, kind="stable")
    counts = np.bincount(leaf.ravel(), minlength=forest.leaves * forest.trees)
    begins = np.concatenate([[0], np.cumsum(counts)])
    members = order.T.ravel()
    asked = np.linspace(0, len(own) - 1, min(ASKED, len(own))).astype(int)
    found = np.zeros(len(SHARES))
    for q in asked:
        score = own @ own[q]
        score[q] = -np.inf
        best = np.argpartition(-score, k)[:k]
        opened = forest.search(own[q].astype(np.float32), counts, math.ceil(SHARES[-1] * len(own)))
        held = np.cumsum(counts[opened])
        first = np.full(len(own), np.iinfo(np.int64).max)
        for i in reversed(range(len(opened))):
            first[members[begins[opened[i]] : begins[opened[i] + 1]]] = i
        for at, share in enumerate(SHARES):
            last = int(np.searchsorted(held, share * len(own)))
            found[at] += np.count_nonzero(first[best] <= last)
    recall = found / (k * len(asked))
    good = np.flatnonzero(recall >= RECALL)
    return SHARES[good[0]] if len(good) else None


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of finite, non-zero vectors, each row once."""
    own = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(table: DataFrame, k: int = 20, every: int = 20, trees: int = 8, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` its ``k`` nearest found.

    score is the inner product in double precision of the original vectors; nearest first, ties to
    the smaller vec_id; a query is no candidate of its own. Vectors of each length are searched among themselves, with a forest of their own. Vectors that
    are null, empty, zero, or hold null or non-finite numbers take no part; rows with a null vec_id neither; wholly
    repeated rows count once. A query stops once the leaves it has opened, over all trees, hold ``share`` times as many
    members as there are vectors; by default as ``enough_share`` measures, and
    where it finds no share that is enough, all vectors are compared. An empty table gives no rows; other columns are ignored.
    """
    vectors = materialise(valid_vectors(table), "vectors")
    lengths = [r["n"] for r in vectors.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    found = [_nearest(vectors.where(F.size("v") == n), n, k, every, trees, share) for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))


def _nearest(vectors: DataFrame, dim: int, k: int, every: int, trees: int, share: float | None) -> DataFrame:
    """The same for valid vectors of one length."""
    spark = vectors.sparkSession
    same = Window.partitionBy("v").orderBy("vec_id")
    indexed = materialise(vectors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r"), "indexed")
    rows = indexed.count()
    # a share of all hashes, so tasks send what is used and little more
    wanted = max(1, SAMPLE_VALUES // dim)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < min(1.0, wanted / rows) * float(1 << 40)
    sample = _matrix(indexed.where(part).select("v").toArrow()["v"])
    forest = Forest(sample.astype(np.float32), rows, trees)
    share = share or enough_share(forest, sample, k)
    if share is None:
        # every leaf of one tree: an exact search
        forest, trees, share = Forest(sample.astype(np.float32), rows, 1), 1, 1.0
    model = spark.sparkContext.broadcast(forest)

    def leaf_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(model.value.leaves * model.value.trees, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(model.value.route(_matrix(b.column(0)).astype(np.float32)).ravel(), minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], names=["leaf", "n"])

    # as many rows as the forest has leaves
    sizes = indexed.select("v").mapInArrow(leaf_counts, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(forest.leaves * trees, np.int64)
    for r in sizes:
        counts[r["leaf"]] = r["n"]
    held, stop = spark.sparkContext.broadcast(counts), max(trees * (k + 1), math.ceil(share * rows))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, leaf = b.column(0).to_numpy(), model.value.route(_matrix(b.column(1)).astype(np.float32))
                at = np.repeat(np.arange(len(ids)), leaf.shape[1])
                blocks = -(-held.value[leaf.ravel()] // BLOCK)
                block = (ids[at] * 0x9E3779B1 % 2147483647) % np.maximum(blocks, 1) * parts
                # once for each block of queries
                at, leaf, block = np.repeat(at, parts), np.repeat(leaf.ravel(), parts), np.repeat(block, parts) + np.tile(np.arange(parts), len(at))
                yield pa.record_batch([pa.array(leaf), pa.array(block), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["leaf", "block", "vec_id", "v"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, leaves, blocks = [], [], []
            for i, v in enumerate(_matrix(b.column(1)).astype(np.float32) if b.num_rows else []):
                for leaf in model.value.search(v, held.value, stop):
                    for block in range(-(-int(held.value[leaf]) // BLOCK)):
                        at.append(i)
                        leaves.append(leaf)
                        blocks.append(block * parts + int(b.column(0)[i].as_py()) // every % parts)
            at = pa.array(at, pa.int64())
            yield pa.record_batch([pa.array(leaves, pa.int64()), pa.array(blocks, pa.int64()), b.column(0).take(at), b.column(1).take(at)], names=["leaf", "block", "vec_id", "v"])

    def rank_leaf(keys: tuple[pa.Scalar, ...], asked: pa.Table, there: pa.Table) -> pa.Table:
        q, ids, out = asked["vec_id"].to_numpy(), there["vec_id"].to_numpy(), []
        order = np.argsort(ids)
        ids, m = ids[order], _matrix(there["v"])[order] if len(ids) else None
        vectors = _matrix(asked["v"])
        for a in range(0, len(q) if len(ids) else 0, 256):
            # one order of summing whatever else is in the leaf
            score = np.einsum("ij,kj->ik", vectors[a : a + 256], m)
            # the k + 1 best, ties to the smaller id, so k are left without the query's own
            best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
            out.append((np.repeat(q[a : a + 256], best.shape[1]), ids[best].ravel(), np.take_along_axis(score, best, 1).ravel()))
        parts = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table([pa.array(p) for p in parts], names=["asked", "vec_id", "score"])

    asked = vectors.where(F.col("vec_id") % every == 0)
    # equal queries are searched once
    first = materialise(asked.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v"), "queries")
    parts = max(1, math.ceil(first.count() / QUERIES))
    kind = "leaf long, block long, vec_id long, v array<double>"
    met = first.mapInArrow(probes, kind).groupBy("leaf", "block").cogroup(indexed.mapInArrow(members, kind).groupBy("leaf", "block"))
    found = met.applyInArrow(rank_leaf, "asked long, vec_id long, score double").groupBy("asked", "vec_id").agg(F.max("score").alias("score"))
    by_score = lambda key: Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(by_score("asked"))).where(F.col("r") <= k + 1).drop("r")
    who = asked.join(first.select(F.col("vec_id").alias("asked"), "v"), "v").select(F.col("vec_id").alias("query_id"), "asked")
    pairs = who.join(found, "asked").where("query_id <> vec_id")
    return pairs.withColumn("rank", F.row_number().over(by_score("query_id"))).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
