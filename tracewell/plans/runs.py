"""Pages that read stored runs: placement and layering results are saved as runs, and a page shows the last whole one."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tracewell.operators import layering as LO
from tracewell.operators import placement as P
from tracewell.operators import reports as A
from tracewell.operators.etl import keep_latest
from tracewell.plans import detection as D
from tracewell.plans import layering as L
from tracewell.plans.base import ORACLES, query
from tracewell.sources.storage import cut, fresh_path, short_shuffles
from tracewell.sources.tables import RunStore
from tracewell.sources.transfers import event_transfers, purchase_transfers

#: The first run sees flows before this time, the second all.
CUT = datetime.datetime(2024, 1, 16, tzinfo=datetime.UTC)
DAY = [datetime.datetime(2024, 2, d) for d in (1, 2, 3)]


def _broken(store: RunStore, run: str, table: str, rows) -> None:
    """What a run leaves that failed after its first table."""
    with short_shuffles(store.spark):
        rows.write.parquet(f"{store.path}/{table}/run_id={run}")


def placement_runs_of(spark, sf_dir) -> RunStore:
    """Behaviours of two runs, placements and traces of the second, and a third that failed midway."""
    store, flows = RunStore(spark, fresh_path(spark, "placement-runs")), cut(D._flows(spark, sf_dir))
    profiles, ranked = D._behaved(flows.where(F.col("ts") < CUT.timestamp()))
    store.save("PLR-1", DAY[0], {"behaviors": ranked, "profiles": profiles})
    profiles, traces, ranked, placed = D._placed_of(flows)
    store.save("PLR-2", DAY[1], {"behaviors": ranked, "profiles": profiles, "traces": traces, "placements": placed})
    _broken(store, "PLR-3", "placements", placed.limit(1))
    _broken(store, "PLR-3", "behaviors", ranked.limit(1))
    return store


@query(ORACLES["placement_list"])
def stored_placement_list(spark, sf_dir):
    store = placement_runs_of(spark, sf_dir)
    return store.read("placements", store.latest()).where("score >= 0.6").orderBy(F.desc("score"), "entity").limit(20).select("entity", "score", "behavior_score", "graph_score", "temporal_score")


@query(ORACLES["placement_summary"])
def stored_placement_summary(spark, sf_dir):
    store = placement_runs_of(spark, sf_dir)
    placed, ranked = store.read("placements", store.latest()), store.read("behaviors", store.latest())
    totals = placed.agg(F.count("*").alias("placements")).crossJoin(ranked.agg(F.countDistinct("entity").alias("suspicious")))
    return placed.orderBy(F.desc("score"), "entity").limit(5).select("entity", "score").crossJoin(F.broadcast(totals))


@query(ORACLES["placement_detail"])
def stored_placement_detail(spark, sf_dir):
    """The best placement of the last run, its paths and the behaviours of their roots, joined on run and entity."""
    store = placement_runs_of(spark, sf_dir)
    last = cut(store.latest())
    one = cut(store.read("placements", last).orderBy(F.desc("score"), "entity").limit(1))
    own = cut(store.read("traces", last).withColumn("entity", F.element_at("path", -1)).join(one.select("run_id", "entity"), ["run_id", "entity"], "left_semi"))
    rows = own.select(F.lit("trace").alias("part"), F.col("root").alias("name"), F.array_join(F.reverse("path"), ">").alias("text"), "score")
    named = store.read("behaviors", last).join(own.select("run_id", F.col("root").alias("entity")).distinct(), ["run_id", "entity"], "left_semi").select(F.lit("behavior").alias("part"), F.col("entity").alias("name"), F.col("behavior").alias("text"), F.col("confidence").alias("score"))
    return rows.unionByName(named).unionByName(one.select(F.lit("score").alias("part"), F.col("entity").alias("name"), F.lit("placement_origin").alias("text"), "score"))


def _until(statement: str) -> str:
    """A statement over flows, of those before CUT."""
    return statement.replace("flow AS (", "flow AS (SELECT * FROM (", 1).replace("JOIN orders ON l_orderkey = o_orderkey)", f"JOIN orders ON l_orderkey = o_orderkey) WHERE ts < {CUT.timestamp()})", 1)


_BY_RUN = f"WITH {D.FLOW}, {D.RANKED} SELECT '{{}}' AS run_id, entity, behavior, confidence, n_in, first_seen FROM ranked JOIN prof USING (entity)"


@query(f"SELECT * FROM ({_until(_BY_RUN.format('PLR-1'))}) UNION ALL SELECT * FROM ({_BY_RUN.format('PLR-2')})")
def behaviors_by_run(spark, sf_dir):
    """Behaviours of all whole runs beside the profiles of the same run and entity."""
    store = placement_runs_of(spark, sf_dir)
    return store.read("behaviors").join(store.read("profiles"), ["run_id", "entity"]).select("run_id", "entity", "behavior", "confidence", "n_in", "first_seen")


def layering_run_of(spark, sf_dir) -> RunStore:
    """Hits, alerts and bridge pairs of all five detectors as one run, and a later one that failed."""
    store, hits = RunStore(spark, fresh_path(spark, "layering-runs")), cut(L._layering_hits(spark, sf_dir))
    pairs = LO.match_bridges(L._candidates(spark, sf_dir))
    ends = event_transfers(spark, sf_dir).select(F.col("tx_hash").alias("deposit"), F.col("from_address").alias("seed"))
    store.save("LYR-1", DAY[0], {"hits": hits, "alerts": LO.layering_alerts(hits), "pairs": pairs.join(ends, "deposit").groupBy("seed").agg(F.count("*").alias("n"))})
    _broken(store, "LYR-2", "hits", hits.limit(1))
    return store


@query()
def layering_run_list(spark, sf_dir):
    """The 20 best alerts of the last run, of all five detectors."""
    store = layering_run_of(spark, sf_dir)
    return store.read("alerts", store.latest()).where("confidence >= 0.5").orderBy(F.desc("confidence"), "seed").limit(20).drop("run_id")


@query()
def layering_run_summary(spark, sf_dir):
    store = layering_run_of(spark, sf_dir)
    own = store.read("hits", store.latest())
    return own.groupBy("method").agg(F.countDistinct("seed").alias("n"), F.max("confidence").alias("best"))


@query()
def layering_run_narratives(spark, sf_dir):
    store = layering_run_of(spark, sf_dir)
    last = cut(store.latest())
    hits = store.read("hits", last).select(F.col("seed").alias("entity"), "method", F.col("confidence").alias("score"))
    flows = D._flows(spark, sf_dir)
    placed = P.behaviors(flows, D._profiles(flows), D.CFG).join(D._trios(spark, sf_dir), "entity").select(F.col("address").alias("entity"), "behavior", "rank")
    return A.narrative(A.ranked_methods(hits), placed, store.read("pairs", last).select(F.col("seed").alias("entity"), "n"))


@query()
def layering_run_transfers(spark, sf_dir):
    """The newest transfers of the 20 best alerts' seeds, each with the strongest method of its seed."""
    store = layering_run_of(spark, sf_dir)
    last = cut(store.latest())
    best = cut(store.read("alerts", last).orderBy(F.desc("confidence"), "seed").limit(20).select("seed"))
    first = keep_latest(store.read("hits", last).join(best, "seed", "left_semi"), ["seed"], ["confidence", "method"]).select(F.col("seed").alias("address"), "method")
    shown = cut(A.edges_of(purchase_transfers(spark, sf_dir), best.withColumnRenamed("seed", "address"), 100).select("tx_hash", "from_address", "to_address"))
    sides = shown.select("tx_hash", "from_address", "to_address", F.explode(F.array("from_address", "to_address")).alias("address"))
    return sides.join(first, "address").select("tx_hash", "from_address", "to_address", F.col("address").alias("seed"), "method")
