"""What the placement queries put on disk, and traces over pruned edges against plain ones."""

import random
import time
from collections import defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tracewell.config import EngineConfig
from tracewell.operators import placement as P
from tracewell.plans import detection as D
from tracewell.registry import queries
from tracewell.sources.storage import cut

FLOWS = "src string, dst string, ts double, tx_hash string, value double"


def executions(spark):
    """Shuffled rows of each SQL statement so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    rows = {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    out = {}
    for e in (found.apply(i) for i in range(found.size())):
        ids = e.stages().iterator()
        out[e.executionId()] = 0
        while ids.hasNext():
            out[e.executionId()] += rows.get(ids.next(), 0)
    return out


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    each = (files.apply(i) for i in range(files.size()))
    return {x.getName(): x.length() for x in each if x.getName().startswith("shuffle_")}


def left_over(spark, before):
    """Bytes of shuffle files that are new and stay; they go without a wait for the job that wrote them."""
    until = time.time() + 10
    while (new := sum(n for k, n in shuffle_files(spark).items() if k not in before)) and time.time() < until:
        time.sleep(0.2)
    return new


def test_written_tables_leave_no_shuffles(spark):
    before = shuffle_files(spark)
    cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert not left_over(spark, before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("name", "behaviors_by_run trace_hops trace_rows placement_scores placement_labels integration_feedback placement_detail placement_summary placement_list stored_placement_summary stored_placement_list stored_placement_detail".split())
def test_no_statement_shuffles_the_flows_twice(spark, name):
    flows = D._flows(spark, SF).count()
    known, before = set(executions(spark)), shuffle_files(spark)
    found = queries()[name](spark, SF)
    # the first row of a sorted table has a shuffle of its own, of a row a partition
    assert left_over(spark, before) < 10_000
    found.collect()
    assert max(n for e, n in executions(spark).items() if e not in known) < 1.5 * flows


def plain_traces(rows, roots, cfg):
    """The paths, all edges looked at."""
    edges, peers, count = defaultdict(lambda: [0.0, 1e18]), defaultdict(set), defaultdict(int)
    for s, d, t, _, v in rows:
        e = edges[s, d]
        e[0], e[1] = e[0] + v, min(e[1], t)
        for me, peer in ((s, d), (d, s)):
            peers[me].add(peer)
            count[me] += 1
    total, fan, into = defaultdict(float), defaultdict(int), defaultdict(list)
    for (s, d), (v, t) in edges.items():
        total[d] += v
        fan[s] += 1
        into[d].append((t, -round(v, 2), s))
    out = []

    def walk(root, path, score, depth):
        if depth == cfg.max_hops:
            out.append((root, ">".join(path), score, "max_hops_reached"))
            return
        if not into[path[-1]]:
            out.append((root, ">".join(path), score, "no_incoming"))
            return
        taken = []
        for _, v, s in sorted(into[path[-1]]):
            w = 0.45 + 0.55 * min(1, -v / max(round(total[path[-1]], 2), -v, 1e-9))
            w = w * (0.6 if count[s] >= max(20, cfg.service_tx) or len(peers[s]) >= max(5, cfg.service_degree) else 1.0) * 0.95**depth * (0.9 if fan[s] > 3 else 1.0)
            if s not in path and round(score * min(1, w), 6) >= P.CUTOFF:
                taken.append((s, round(score * min(1, w), 6)))
        for s, next_score in taken[: cfg.branching]:
            walk(root, [*path, s], next_score, depth + 1)
        if not taken:
            out.append((root, ">".join(path), score, "confidence_cutoff"))

    for r in roots:
        walk(r, [r], 1.0, 0)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_traces_over_pruned_edges(spark, seed):
    rng = random.Random(seed)
    hubs, small = [f"h{i}" for i in range(9)], [f"s{i}" for i in range(150)]
    rows = []
    for i in range(2500):
        d = rng.choice(hubs)
        s = rng.choice([h for h in hubs if h != d]) if rng.random() < 0.15 else rng.choice(small)
        # later transfers may be larger, and times and amounts have ties
        rows.append((s, d, float(rng.randrange(300)), f"t{i}", float(rng.choice([1, 2, 5, 300 if rng.random() < 0.05 else 3, rng.randrange(1, 20)]))))
    cfg = EngineConfig(max_hops=3, branching=2, service_tx=60, service_degree=12)
    flows = spark.createDataFrame(rows, FLOWS)
    got = P.trace(flows, spark.createDataFrame([(h,) for h in hubs], "entity string"), cfg)
    assert sorted(map(tuple, got.withColumn("path", F.array_join("path", ">")).collect())) == plain_traces(rows, hubs, cfg)


def test_few_edges_of_a_hub_are_kept(spark):
    rng = random.Random(5)
    flows = spark.createDataFrame([(f"s{i}", "hub", float(rng.randrange(10**6)), f"t{i}", float(rng.randrange(1, 10**5))) for i in range(20000)], FLOWS)
    assert P.source_edges(flows, EngineConfig()).count() < 1000


def test_pairs_both_ways_alone_and_without_a_name(spark):
    rows = [("a", "b", 3.0, "1", 5.0), ("b", "a", 1.0, "2", 2.0), ("b", "a", 2.0, "3", 1.0), ("c", "c", 1.0, "4", 1.0), (None, "a", 1.0, "5", 9.0), ("a", None, 1.0, "6", 9.0)]
    got = {r.entity: (r.tx_count, r.degree) for r in P.linked_entities(spark.createDataFrame(rows, FLOWS)).collect()}
    assert got == {"a": (5, 2), "b": (3, 1), "c": (2, 1), None: (2, 1)}
    into = {(r.at, r.up): r.total for r in P.source_edges(spark.createDataFrame(rows, FLOWS), EngineConfig()).collect()}
    assert into == {("b", "a"): 5.0, ("a", "b"): 3.0, ("c", "c"): 1.0}
