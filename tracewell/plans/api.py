"""Queries behind the application's pages: lists, details, search on the graph, owner lists, wallet pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import layering as LO
from tracewell.operators import placement as P
from tracewell.operators import reports as A
from tracewell.operators import wallet as W
from tracewell.operators.etl import keep_latest
from tracewell.operators.relational import role_union
from tracewell.plans import detection as D
from tracewell.plans import layering as L
from tracewell.plans.base import ORACLES, query, table
from tracewell.sources.storage import cut
from tracewell.sources.transfers import EV, HV, event_transfers, purchase_transfers

#: Three users a cluster; a supplier owns the user of its number, and a nation's suppliers are one owner.
MEM = "mem AS (SELECT DISTINCT 'U' || user_id AS address, 'C-' || (user_id // 3) AS cluster_id FROM events), own AS (SELECT s_nationkey AS owner_id, s_name AS name, 'U' || s_suppkey AS address, s_acctbal FROM supplier)"


def _members(spark, sf_dir):
    return D._trios(spark, sf_dir).withColumnRenamed("entity", "cluster_id")


def _owned(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("owner_id"), F.col("s_name").alias("name"), F.concat(F.lit("U"), "s_suppkey").alias("address"), "s_acctbal")


# clusters: list, detail, activity, owners
CLUSTERS = f"""{EV}, {MEM}, act AS (SELECT cluster_id, count(*) AS tx_count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM (SELECT from_address AS address, value FROM ev UNION ALL SELECT to_address, value FROM ev) JOIN mem USING (address) GROUP BY 1),
 cl AS (SELECT cluster_id, count(*) AS size, min(own.name) AS owner, array_to_string(list_sort(list(mem.address)), ',') AS addresses FROM mem LEFT JOIN own USING (address) GROUP BY 1 HAVING count(*) >= 2)"""


def _clusters(spark, sf_dir):
    own = _members(spark, sf_dir)
    act = role_union(event_transfers(spark, sf_dir)).join(own, "address").groupBy("cluster_id").agg(F.count("*").alias("tx_count"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("volume"))
    listed = own.join(_owned(spark, sf_dir).select("address", "name"), "address", "left").groupBy("cluster_id").agg(F.countDistinct("address").alias("size"), F.min("name").alias("owner"), F.array_join(F.array_sort(F.collect_set("address")), ",").alias("addresses"))
    return listed.where("size >= 2").join(act, "cluster_id", "left")


@query(f"WITH {CLUSTERS} SELECT cl.*, tx_count, volume FROM cl LEFT JOIN act USING (cluster_id)")
def cluster_list(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(f"WITH {CLUSTERS} SELECT cl.*, tx_count, volume FROM cl LEFT JOIN act USING (cluster_id) WHERE cluster_id = 'C-3'")
def cluster_detail(spark, sf_dir):
    return _clusters(spark, sf_dir).where("cluster_id = 'C-3'")


@query(f"WITH {CLUSTERS} SELECT count(*) AS clusters, sum(size) AS addresses, sum(tx_count) AS tx_count, CAST(sum(CAST(volume AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM cl LEFT JOIN act USING (cluster_id)")
def cluster_activity_total(spark, sf_dir):
    return _clusters(spark, sf_dir).agg(F.count("*").alias("clusters"), F.sum("size").alias("addresses"), F.sum("tx_count").alias("tx_count"), F.sum(F.col("volume").cast("decimal(18,2)")).cast("double").alias("volume"))


@query(f"WITH {MEM} SELECT owner_id, name, own.address, cluster_id FROM own LEFT JOIN mem USING (address) WHERE lower(own.address) = lower('u12') ORDER BY owner_id LIMIT 1")
def owner_by_address(spark, sf_dir):
    one = _owned(spark, sf_dir).where(F.lower("address") == F.lower(F.lit("u12"))).orderBy("owner_id").limit(1)
    return one.join(_members(spark, sf_dir), "address", "left").select("owner_id", "name", "address", "cluster_id")


#: A list to be added: each customer's nation claims the user that its key ends in.
NEW = "new AS (SELECT c_nationkey AS owner_id, 'U' || (c_custkey // 10) AS address, c_acctbal > 9000 AS is_primary FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_acctbal DESC, c_custkey) = 1), held AS (SELECT owner_id, address, s_acctbal > 0 AS is_primary FROM own)"


def _new_owners(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("k", F.floor(F.col("c_custkey") / 10))
    one = keep_latest(c, ["k"], ["c_acctbal", "c_custkey"])
    return one.select(F.col("c_nationkey").alias("owner_id"), F.concat(F.lit("U"), "k").alias("address"), (F.col("c_acctbal") > 9000).alias("is_primary"))


def _held(spark, sf_dir):
    return _owned(spark, sf_dir).select("owner_id", "address", (F.col("s_acctbal") > 0).alias("is_primary"))


@query(f"WITH {MEM}, {NEW} SELECT new.address, new.owner_id, held.owner_id AS held_by FROM new JOIN held USING (address) WHERE new.owner_id <> held.owner_id")
def owner_conflicts(spark, sf_dir):
    return A.owner_conflicts(_held(spark, sf_dir), _new_owners(spark, sf_dir))


@query(f"WITH {MEM}, {NEW} SELECT * FROM new UNION ALL SELECT * FROM held WHERE address NOT IN (SELECT address FROM new)")
def owner_insert_forced(spark, sf_dir):
    return A.insert_owners(_held(spark, sf_dir), _new_owners(spark, sf_dir), force=True)


@query(f"WITH {MEM}, {NEW} SELECT * FROM held UNION ALL SELECT * FROM new WHERE address NOT IN (SELECT address FROM held)")
def owner_insert(spark, sf_dir):
    return A.insert_owners(_held(spark, sf_dir), _new_owners(spark, sf_dir))


@query(f"""WITH {MEM}, d AS (SELECT cluster_id, list_sort(list(address)) AS a FROM mem GROUP BY 1) SELECT cluster_id, a[(('0x' || substr(sha1(cluster_id), 1, 8))::BIGINT % len(a)) + 1] AS address, 'LEV-' || upper(substr(sha1(cluster_id || '|peeling_chain|1'), 1, 12)) AS evidence_id FROM d""")
def cluster_representatives(spark, sf_dir):
    own = _members(spark, sf_dir).groupBy("cluster_id").agg(F.array_sort(F.collect_set("address")).alias("a"))
    return own.select("cluster_id", A.representative(F.col("cluster_id"), F.col("a")).alias("address"), A.evidence_id(F.col("cluster_id"), F.lit("peeling_chain"), F.lit(1)).alias("evidence_id"))


@query("""SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END, r_name], lambda x: coalesce(x, '') <> ''), ', ') AS location
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def owner_locations(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return own.select("s_suppkey", A.location(F.when(F.col("s_acctbal") >= 0, F.col("s_name")), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("n_name")), F.col("r_name")).alias("location"))


@query(f"""WITH {MEM}, nm AS (SELECT address AS key, name FROM own WHERE s_acctbal > 3000 UNION ALL SELECT 'C-' || n_nationkey, n_name FROM nation)
SELECT cluster_id AS entity, coalesce(any_value(d.name), arg_min(v.name, v.key)) AS name FROM mem LEFT JOIN nm d ON d.key = cluster_id LEFT JOIN nm v ON v.key = address GROUP BY 1""")
def entity_names(spark, sf_dir):
    names = _owned(spark, sf_dir).where("s_acctbal > 3000").select(F.col("address").alias("key"), "name").unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("C-"), "n_nationkey").alias("key"), F.col("n_name").alias("name")))
    return A.named_entities(D._trios(spark, sf_dir), names)


@query(f"""WITH {MEM}, other AS (SELECT 'U' || user_id AS address, 'E' || (min(event_id) % 40) AS entity FROM events GROUP BY user_id)
SELECT cluster_id, entity, shared FROM (SELECT cluster_id, entity, count(DISTINCT address) AS shared FROM mem JOIN other USING (address) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY shared DESC, entity) = 1""")
def max_overlap(spark, sf_dir):
    other = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("k")).select(F.concat(F.lit("U"), "user_id").alias("address"), F.concat(F.lit("E"), F.col("k") % 40).alias("entity"))
    return A.best_entity(_members(spark, sf_dir), other)


@query(f"""WITH {MEM}, old AS (SELECT DISTINCT 'C-' || (o_custkey // 20) AS cluster_id FROM orders), big AS (SELECT cluster_id FROM mem GROUP BY 1 HAVING count(*) >= 3)
SELECT 'kept' AS what, cluster_id FROM big UNION ALL SELECT 'stale', cluster_id FROM old WHERE cluster_id NOT IN (SELECT cluster_id FROM big) UNION ALL SELECT 'released', address FROM mem WHERE cluster_id NOT IN (SELECT cluster_id FROM big)""")
def cluster_sync(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.concat(F.lit("C-"), F.floor(F.col("o_custkey") / 20)).alias("cluster_id")).distinct()
    kept, stale, addresses = A.sync_clusters(old, _members(spark, sf_dir), 3)
    named = lambda df, what, c="cluster_id": df.select(F.lit(what).alias("what"), F.col(c).alias("cluster_id"))
    return named(kept, "kept").unionByName(named(stale, "stale")).unionByName(named(addresses.where("cluster_id is null"), "released", "address"))


# placement: runs are days of events
RUNS = "runs AS (SELECT 'PLR-' || strftime(max(ts), '%Y%m%d') AS run_id, max(ts) AS completed_at, count(*) AS n, CASE WHEN count(*) % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY date_trunc('day', ts))"


def _runs(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.max("ts").alias("completed_at"), F.count("*").alias("n"))
    return own.select(F.concat(F.lit("PLR-"), F.date_format("completed_at", "yyyyMMdd")).alias("run_id"), "completed_at", "n", F.when(F.col("n") % 5 == 0, "failed").otherwise("completed").alias("status"))


@query(f"WITH {RUNS} SELECT run_id, n, status FROM runs WHERE status = 'completed' ORDER BY completed_at DESC LIMIT 10")
def placement_runs(spark, sf_dir):
    return _runs(spark, sf_dir).where("status = 'completed'").orderBy(F.desc("completed_at")).limit(10).select("run_id", "n", "status")


@query(f"WITH {RUNS} SELECT run_id, n FROM runs WHERE status = 'completed' AND completed_at <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY completed_at DESC LIMIT 1")
def placement_run_until(spark, sf_dir):
    return _runs(spark, sf_dir).where("status = 'completed' and completed_at <= timestamp'2024-01-20 00:00:00'").orderBy(F.desc("completed_at")).limit(1).select("run_id", "n")


@query(f"WITH {D.SCORED} SELECT entity, score, behavior_score, graph_score, temporal_score FROM placed WHERE score >= 0.6 ORDER BY score DESC, entity LIMIT 20")
def placement_list(spark, sf_dir):
    return D._placed(spark, sf_dir)[2].where("score >= 0.6").orderBy(F.desc("score"), "entity").limit(20).select("entity", "score", "behavior_score", "graph_score", "temporal_score")


@query(f"WITH {D.SCORED} SELECT entity, score, (SELECT count(*) FROM placed) AS placements, (SELECT count(DISTINCT entity) FROM ranked) AS suspicious FROM placed ORDER BY score DESC, entity LIMIT 5")
def placement_summary(spark, sf_dir):
    _, ranked, placed = D._placed(spark, sf_dir)
    totals = placed.agg(F.count("*").alias("placements")).crossJoin(ranked.agg(F.countDistinct("entity").alias("suspicious")))
    return placed.orderBy(F.desc("score"), "entity").limit(5).select("entity", "score").crossJoin(F.broadcast(totals))


DETAIL = f"{D.SCORED}, one AS (SELECT entity FROM placed ORDER BY score DESC, entity LIMIT 1)"


@query(f"""WITH {DETAIL} SELECT 'trace' AS part, root AS name, array_to_string(list_reverse(path), '>') AS text, score FROM traces WHERE path[-1] IN (SELECT entity FROM one)
 UNION ALL SELECT 'behavior', root, behavior, confidence FROM (SELECT DISTINCT root FROM traces WHERE path[-1] IN (SELECT entity FROM one)) JOIN ranked ON root = entity UNION ALL SELECT 'score', entity, 'placement_origin', score FROM placed WHERE entity IN (SELECT entity FROM one)""")
def placement_detail(spark, sf_dir):
    """The best placement: its score, the paths that end at it, from the origin on, and the behaviours of their roots."""
    traces, ranked, placed = D._placed(spark, sf_dir)
    one = cut(placed.orderBy(F.desc("score"), "entity").limit(1))
    own = cut(traces.join(one.select(F.col("entity").alias("e")), F.element_at("path", -1) == F.col("e"), "left_semi"))
    rows = own.select(F.lit("trace").alias("part"), F.col("root").alias("name"), F.array_join(F.reverse("path"), ">").alias("text"), "score")
    named = ranked.join(own.select(F.col("root").alias("entity")).distinct(), "entity", "left_semi").select(F.lit("behavior").alias("part"), F.col("entity").alias("name"), F.col("behavior").alias("text"), F.col("confidence").alias("score"))
    return rows.unionByName(named).unionByName(one.select(F.lit("score").alias("part"), F.col("entity").alias("name"), F.lit("placement_origin").alias("text"), "score"))


# layering: hits of the two detectors that have a statement
HITS = f"hits AS (SELECT seed, 'mixing_interaction' AS method, confidence FROM ({ORACLES['mixing']}) UNION ALL SELECT seed, 'peeling_chain', confidence FROM ({ORACLES['peeling_chain']}))"


def _hits(spark, sf_dir):
    mixed = L.mixing(spark, sf_dir).select("seed", F.lit("mixing_interaction").alias("method"), "confidence")
    return cut(mixed.unionByName(L.peeling_chain(spark, sf_dir).select("seed", F.lit("peeling_chain").alias("method"), "confidence")))


@query(f"WITH {HITS} SELECT seed, max(confidence) AS confidence, array_to_string(list(method ORDER BY confidence DESC, method DESC), ',') AS methods FROM hits GROUP BY 1 HAVING max(confidence) >= 0.5 ORDER BY 2 DESC, 1 LIMIT 20")
def layering_list(spark, sf_dir):
    own = _hits(spark, sf_dir).groupBy("seed").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_list(F.struct("confidence", "method")), asc=False).alias("s"))
    return own.where("confidence >= 0.5").orderBy(F.desc("confidence"), "seed").limit(20).select("seed", "confidence", F.array_join(F.transform("s", lambda x: x["method"]), ",").alias("methods"))


@query(f"WITH {HITS} SELECT method, count(*) AS n, max(confidence) AS best FROM hits GROUP BY 1")
def layering_summary(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


_SAYS = """CASE m[1] WHEN 'peeling_chain' THEN 'Peeling chains dominate this entity, with value repeatedly shaved into smaller follow-on transfers.' ELSE 'Mixing and anonymity-tool interaction is the dominant layering signal around this entity.' END
 || CASE WHEN len(m) > 1 AND c[2] >= 0.45 AND c[2] >= 0.72 * c[1] THEN ' ' || CASE m[2] WHEN 'peeling_chain' THEN 'Peeling chains' ELSE 'Mixing & anonymity tool interaction' END || ' also scores strongly enough to reinforce the same alert.' ELSE '' END
 || CASE WHEN b IS NOT NULL THEN ' Placement seeding for this entity was already linked to ' || array_to_string([replace(x, '_', ' ') FOR x IN b], ', ') || '.' ELSE '' END
 || CASE WHEN pairs = 1 THEN ' 1 bridge-linked transfer pair supports the trace.' WHEN pairs > 1 THEN ' ' || pairs || ' bridge-linked transfer pairs support the trace.' ELSE '' END || ' ' || reason"""


@query(f"""WITH {D.FLOW}, {D.RANKED}, {HITS}, r AS (SELECT seed, list(method ORDER BY confidence DESC, method DESC) AS m, list(confidence ORDER BY confidence DESC, method DESC) AS c FROM hits GROUP BY 1),
 b AS (SELECT address AS seed, list(behavior ORDER BY rank) AS b FROM ranked JOIN mem USING (entity) WHERE rank <= 2 GROUP BY 1), n AS (SELECT seed, len(m) AS n FROM r), pr AS (SELECT from_address AS seed, count(*) AS pairs FROM ev WHERE to_address = 'U3' AND value >= 100 GROUP BY 1)
SELECT seed AS entity, {_SAYS.replace("|| reason", "|| CASE n WHEN 1 THEN 'Seen by 1 detector' ELSE 'Seen by ' || n || ' detectors' END")} AS text FROM r LEFT JOIN b USING (seed) LEFT JOIN pr USING (seed) JOIN n USING (seed)""")
def layering_narratives(spark, sf_dir):
    """Texts on the entities of two detectors, with their trios' behaviours, large transfers to U3 as bridge pairs, and a reason."""
    hits = _hits(spark, sf_dir).select(F.col("seed").alias("entity"), "method", F.col("confidence").alias("score"))
    flows = D._flows(spark, sf_dir)
    placed = P.behaviors(flows, D._profiles(flows), D.CFG).join(D._trios(spark, sf_dir), "entity").select(F.col("address").alias("entity"), "behavior", "rank")
    bridged = event_transfers(spark, sf_dir).where("to_address = 'U3' and value >= 100").groupBy(F.col("from_address").alias("entity")).agg(F.count("*").alias("n"))
    seen = hits.groupBy("entity").agg(F.count("*").alias("k"))
    reasons = seen.select("entity", F.array(F.lit(" "), F.concat(F.lit("Seen by "), F.col("k"), F.when(F.col("k") == 1, " detector").otherwise(" detectors"))).alias("reasons"))
    ranked = A.ranked_methods(hits)
    return A.narrative(ranked, placed, bridged.join(ranked.select("entity"), "entity", "left_semi"), reasons)


@query(f"WITH {HV}, {HITS}, one AS (SELECT seed FROM hits ORDER BY confidence DESC, seed LIMIT 1) SELECT tx_hash, from_address, to_address FROM hv WHERE from_address IN (SELECT seed FROM one) OR to_address IN (SELECT seed FROM one) ORDER BY block_number DESC LIMIT 100")
def layering_detail_transfers(spark, sf_dir):
    one = _hits(spark, sf_dir).orderBy(F.desc("confidence"), "seed").limit(1).select(F.col("seed").alias("address"))
    return A.edges_of(purchase_transfers(spark, sf_dir), one, 100).select("tx_hash", "from_address", "to_address")


_TOLD = "hv JOIN hits ON seed = from_address AND CASE method WHEN 'peeling_chain' THEN value >= 200 ELSE value < 200 END"


@query(f"""WITH {HV}, {HITS}, h AS (SELECT seed, method, list_sort(list(DISTINCT tx_hash)) AS hs, min(ts) AS a, max(ts) AS b FROM {_TOLD} GROUP BY 1, 2), seeds AS (SELECT from_address AS seed, min(ts) AS sa, max(ts) AS sb, max(value) / 1000 AS p FROM ev GROUP BY 1),
 one AS (SELECT hits.*, hs, a, b FROM hits LEFT JOIN h USING (seed, method)), e AS (SELECT from_address AS seed, count(*) AS n FROM hv WHERE to_address = 'U3' GROUP BY 1)
SELECT seed, round(max(confidence), 4) AS confidence, round(sum(round(confidence * 10000)::BIGINT)::DOUBLE / count(*)) / 10000 AS layering_score, any_value(p) AS placement_score, string_agg(method || '=' || round(confidence * 10000)::BIGINT, ',' ORDER BY round(confidence, 4) DESC, method DESC) AS scores,
 string_agg('seen by ' || method, '; ' ORDER BY round(confidence, 4) DESC, method DESC) AS reasons, array_to_string(list_sort(list_distinct(flatten(list(coalesce(hs, []))))), ',') AS hashes,
 coalesce(first(a ORDER BY round(confidence, 4) DESC, method DESC) FILTER (a IS NOT NULL), any_value(sa)) AS first_ts, coalesce(first(b ORDER BY round(confidence, 4) DESC, method DESC) FILTER (b IS NOT NULL), any_value(sb)) AS last_ts, count(*) AS detectors, coalesce(any_value(n), 0) AS bridge_pairs
 FROM one JOIN seeds USING (seed) LEFT JOIN e USING (seed) GROUP BY 1""")
def layering_alert_details(spark, sf_dir):
    """Alerts of two detectors with reasons, transfers, times and payments to U3 as bridge pairs; large purchases support a peeling chain, others mixing."""
    hits, hv, ev = _hits(spark, sf_dir), cut(purchase_transfers(spark, sf_dir)), event_transfers(spark, sf_dir)
    told = hv.join(hits.select(F.col("seed").alias("from_address"), "method"), "from_address").where((F.col("method") == "peeling_chain") == (F.col("value") >= 200))
    told = told.groupBy(F.col("from_address").alias("seed"), "method").agg(F.collect_set("tx_hash").alias("hashes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    seeds = ev.groupBy(F.col("from_address").alias("seed")).agg((F.max("value") / 1000).alias("placement_score"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    said = hits.join(told, ["seed", "method"], "left").withColumn("summary", F.concat(F.lit("seen by "), "method"))
    pairs = hv.where("to_address = 'U3'").select(F.col("from_address").alias("seed"))
    own = LO.alert_details(said, seeds, hits.select("seed", F.col("method").alias("evidence_id")), pairs)
    scores = F.array_join(F.transform("methods", lambda m: F.concat(m, F.lit("="), F.round(F.col("scores")[m] * 10_000).cast("long"))), ",")
    return own.select("seed", "confidence", "layering_score", "placement_score", scores.alias("scores"), F.array_join("reasons", "; ").alias("reasons"), F.array_join("hashes", ",").alias("hashes"), "first_ts", "last_ts", "detectors", "bridge_pairs")


@query(f"""WITH c AS ({ORACLES["chain_of_custody"]}), h AS (SELECT DISTINCT 'C-' || (user_id % 20) AS entity, CASE event_type WHEN 'purchase' THEN 'placement' WHEN 'click' THEN 'layering' ELSE 'integration' END AS stage, 'E' || event_id AS tx_hash FROM events),
 t AS (SELECT entity, array_to_string(list_sort(list(DISTINCT tx_hash))[1:50], ',') AS hashes FROM h SEMI JOIN c USING (entity, stage) GROUP BY 1)
SELECT entity, string_agg(stage, '>' ORDER BY CASE stage WHEN 'placement' THEN 1 WHEN 'layering' THEN 2 ELSE 3 END) AS stages, round(max(score), 4) AS overall, coalesce(any_value(hashes), '') AS hashes FROM c LEFT JOIN t USING (entity) GROUP BY 1""")
def custody_report(spark, sf_dir):
    """Entities with the stages that were found, the best score and their first transfers; purchases support placement, clicks layering, the rest integration."""
    stage = F.when(F.col("event_type") == "purchase", "placement").when(F.col("event_type") == "click", "layering").otherwise("integration")
    hashes = table(spark, sf_dir, "events").select(F.concat(F.lit("C-"), F.col("user_id") % 20).alias("entity"), stage.alias("stage"), F.concat(F.lit("E"), "event_id").alias("tx_hash"))
    own = W.custody_report(cut(L.chain_of_custody(spark, sf_dir)), hashes)
    return own.select("entity", F.array_join("stages", ">").alias("stages"), "overall", F.array_join("hashes", ",").alias("hashes"))


# integration and risk
@query(f"WITH {HV}, {D.FIRED}, a AS (SELECT address, round(least(1.0, avg(score) + least(0.30, 0.15 * (count(*) - 1))), 4) AS score, list_sort(list(DISTINCT signal)) AS signals FROM fired GROUP BY 1), t AS (SELECT * FROM a WHERE score >= 0.35 ORDER BY score DESC, address LIMIT 50) SELECT address, score, array_to_string(signals, ',') AS signals FROM t WHERE list_contains(signals, 'convergence')")
def integration_list(spark, sf_dir):
    """The 50 best alerts, and of those the ones with a signal: the filter comes after the limit, as on the page."""
    from tracewell.operators import integration as I

    best = I.alerts(purchase_transfers(spark, sf_dir), D.CFG).orderBy(F.desc("score"), "address").limit(50)
    return best.where(F.array_contains(F.split("signals", ","), "convergence")).select("address", "score", "signals")


@query(f"WITH RECURSIVE {D.RISK}, a AS (SELECT entity, array_to_string(list_sort(list(address))[1:20], ',') AS addresses FROM mem GROUP BY 1) SELECT entity, risk, addresses FROM risk JOIN a USING (entity) WHERE risk >= 0.3 ORDER BY risk DESC, entity LIMIT 25")
def risk_entities(spark, sf_dir):
    own = D._trios(spark, sf_dir).groupBy("entity").agg(F.array_join(F.slice(F.array_sort(F.collect_set("address")), 1, 20), ",").alias("addresses"))
    return D._scored(spark, sf_dir).where("risk >= 0.3").join(own, "entity").orderBy(F.desc("risk"), "entity").limit(25).select("entity", "risk", "addresses")


@query(f"WITH RECURSIVE {D.RISK}, x AS (SELECT entity, unnest([struct_pack(k := 'label', v := label), struct_pack(k := 'behavior', v := behavior), struct_pack(k := 'propagation', v := propagation), struct_pack(k := 'temporal', v := temporal), struct_pack(k := 'exposure', v := exposure), struct_pack(k := 'integration', v := integration)]) AS f FROM risk WHERE entity = 'C-3') SELECT entity, f.k AS factor, f.v AS score FROM x")
def risk_entity_detail(spark, sf_dir):
    one = D._scored(spark, sf_dir).where("entity = 'C-3'")
    return one.unpivot(["entity"], ["label", "behavior", "propagation", "temporal", "exposure", "integration"], "factor", "score")


@query(f"WITH {EV}, wl AS (SELECT 'U' || s_suppkey AS address FROM supplier WHERE s_acctbal < 0) SELECT tx_hash, address, block_number FROM (SELECT tx_hash, from_address AS address, block_number FROM ev UNION ALL SELECT tx_hash, to_address, block_number FROM ev) WHERE address IN (SELECT address FROM wl) ORDER BY block_number DESC, address LIMIT 50")
def poi_alerts(spark, sf_dir):
    from tracewell.operators.risk import screen

    watch = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("U"), "s_suppkey").alias("address"), F.lit(2.0).alias("expires_at"))
    ev = event_transfers(spark, sf_dir)
    hits = screen(ev, watch, 1.0).join(ev.select("tx_hash", "block_number"), "tx_hash")
    return hits.orderBy(F.desc("block_number"), "address").limit(50).select("tx_hash", "address", "block_number")


# the graph: walks from a node, from a search, and what touches a set of addresses
PATH = """walk AS (SELECT 'U1' AS start, ['U1'] AS nodes, CAST([] AS VARCHAR[]) AS hashes, CAST(0 AS DECIMAL(18,2)) AS total, true AS keeps
 UNION ALL SELECT start, list_append(nodes, v), list_append(hashes, tx_hash), CAST(total + CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,2)), keeps AND value >= 110 FROM walk JOIN step ON nodes[-1] = u WHERE len(hashes) < 3 AND NOT list_contains(hashes, tx_hash))"""


@query(f"WITH RECURSIVE {HV}, step AS (SELECT from_address AS u, to_address AS v, tx_hash, value FROM hv UNION ALL SELECT to_address, from_address, tx_hash, value FROM hv WHERE from_address <> to_address), {PATH} SELECT start, array_to_string(nodes, '>') AS nodes, array_to_string(hashes, '>') AS hashes, CAST(total AS DOUBLE) AS total FROM walk WHERE keeps AND len(hashes) > 0")
def path_match(spark, sf_dir):
    return _shown(A.paths(_edges(spark, sf_dir), _start(spark, "U1"), 3, directed=False, least=110.0))


@query(f"WITH RECURSIVE {HV}, step AS (SELECT from_address AS u, to_address AS v, tx_hash, value FROM hv), {PATH.replace('AND value >= 110', '').replace('len(hashes) < 3', 'len(hashes) < 4')} SELECT start, array_to_string(nodes, '>') AS nodes, array_to_string(hashes, '>') AS hashes, CAST(total AS DOUBLE) AS total FROM walk WHERE len(hashes) > 0 ORDER BY len(hashes), array_to_string(hashes, '>') LIMIT 20")
def path_exploration(spark, sf_dir):
    return _shown(A.paths(_edges(spark, sf_dir), _start(spark, "U1"), 4, most=20))


@query(f"WITH RECURSIVE {HV}, step AS (SELECT from_address AS u, to_address AS v, tx_hash, value FROM hv UNION ALL SELECT to_address, from_address, tx_hash, value FROM hv), hit AS (SELECT DISTINCT u FROM step WHERE contains(u, '11') ORDER BY u LIMIT 5),"
       f" {PATH.replace(chr(39) + 'U1' + chr(39) + ' AS start, [' + chr(39) + 'U1' + chr(39) + '] AS nodes', 'u AS start, [u] AS nodes').replace('true AS keeps', 'true AS keeps FROM hit').replace('AND value >= 110', '').replace('len(hashes) < 3', 'len(hashes) < 2')} SELECT start, array_to_string(nodes, '>') AS nodes, array_to_string(hashes, '>') AS hashes, CAST(total AS DOUBLE) AS total FROM walk WHERE len(hashes) > 0")
def path_search(spark, sf_dir):
    edges = cut(_edges(spark, sf_dir))
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).where(F.col("node").contains("11")).distinct()
    return _shown(A.paths(edges, nodes.orderBy("node").limit(5), 2, directed=False))


def _edges(spark, sf_dir):
    return purchase_transfers(spark, sf_dir).select(F.col("from_address").alias("a"), F.col("to_address").alias("b"), "tx_hash", "value")


def _start(spark, node):
    return spark.createDataFrame([(node,)], "node string")


def _shown(found):
    return found.select("start", F.array_join("nodes", ">").alias("nodes"), F.array_join("hashes", ">").alias("hashes"), "total")


@query(f"WITH {EV} SELECT tx_hash, block_number FROM ev WHERE from_address IN ('U1', 'U2', 'U3') OR to_address IN ('U1', 'U2', 'U3') ORDER BY block_number DESC LIMIT 200")
def one_hop_edges(spark, sf_dir):
    who = spark.createDataFrame([("U1",), ("U2",), ("U3",)], "address string")
    return A.edges_of(event_transfers(spark, sf_dir), who).select("tx_hash", "block_number")


@query(f"WITH {EV} SELECT tx_hash, value FROM ev WHERE value >= 50 ORDER BY block_number DESC, value DESC LIMIT 500")
def edge_filter_cap(spark, sf_dir):
    return event_transfers(spark, sf_dir).where("value >= 50").orderBy(F.desc("block_number"), F.desc("value")).limit(500).select("tx_hash", "value")


# wallets
@query(f"""WITH {L.WTX}, p AS (SELECT wallet, count(DISTINCT x) AS peers FROM (SELECT wallet, unnest([lower(coalesce(from_address, '')), lower(coalesce(to_address, ''))]) AS x FROM wtx) GROUP BY 1),
 b AS (SELECT wallet, count(*) AS n, max(ts) - min(ts) AS d FROM wtx GROUP BY 1), t AS (SELECT wallet, max(k) AS k FROM (SELECT wallet, to_address, count(*) AS k FROM wtx GROUP BY 1, 2) GROUP BY 1),
 m AS (SELECT DISTINCT wallet FROM wtx WHERE to_address = 'U0')
SELECT wallet, CASE WHEN wallet IN (SELECT wallet FROM m) THEN 'mixer' WHEN wallet IN (SELECT 'U' || s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 'smart contract' WHEN peers > 90 THEN 'exchange' WHEN n >= 10 AND (CASE WHEN d > 0 THEN n / (d / 60) ELSE 0 END > 5 OR k / n > 0.8) THEN 'bot' ELSE 'user wallet' END AS class
 FROM p JOIN b USING (wallet) JOIN t USING (wallet)""")
def entity_class(spark, sf_dir):
    txs = L._wallet_txs(spark, sf_dir)
    found = txs.where("to_address = 'U0'").select("wallet", F.lit("tornado_cash").alias("label"))
    code = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("U"), "s_suppkey").alias("address"))
    return W.entity_class(txs, found, code, 90)


@query(f"WITH {L.WTX} SELECT wallet, row_number() OVER w AS place, tx_hash, ts FROM wtx WINDOW w AS (PARTITION BY wallet ORDER BY ts DESC, tx_hash) QUALIFY row_number() OVER w <= 5")
def explorer_newest(spark, sf_dir):
    return W.newest(L._wallet_txs(spark, sf_dir), 5)


@query("""SELECT o_custkey AS wallet, 'o' || o_orderkey AS tx_hash, CAST(sum(CASE WHEN l_suppkey % 7 = o_custkey % 7 THEN l_quantity ELSE 0 END)::BIGINT / 100000000 AS DOUBLE) AS value, CASE WHEN count(CASE WHEN l_suppkey % 7 = o_custkey % 7 THEN 1 END) > 0 THEN 'in' ELSE 'out' END AS direction
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def utxo_transfers(spark, sf_dir):
    """Orders as transactions: the customer's weekday group is the wallet's output script, lines are outputs, the customer pays."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.concat(F.lit("g"), F.col("l_suppkey") % 7).alias("address"), F.col("l_quantity").cast("long").alias("value"))).alias("vout"))
    raw = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.concat(F.lit("G"), F.col("o_custkey") % 7).alias("wallet"), F.concat(F.lit("o"), "o_orderkey").alias("txid"), F.array(F.concat(F.lit("g"), F.col("o_custkey") % 7)).alias("vin"), "vout", "o_custkey")
    found = A.utxo_transfers(raw)
    return found.join(raw.select(F.col("txid").alias("tx_hash"), "o_custkey"), "tx_hash").select(F.col("o_custkey").alias("wallet"), "tx_hash", "value", "direction")


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '0x' || sha1(text) WHEN 1 THEN 'bc1' || replace(replace(sha1(text), '0', 'q'), '1', 'z') ELSE text END AS a FROM documents WHERE text IS NOT NULL) SELECT DISTINCT a AS address, CASE WHEN starts_with(a, '0x') THEN 'ethereum' ELSE 'bitcoin' END AS chain FROM p WHERE doc_id % 3 < 2""")
def feed_addresses(spark, sf_dir):
    h = F.sha1("text")
    k = F.col("doc_id") % 3
    made = F.when(k == 0, F.concat(F.lit("listed: 0x"), h, F.lit(" (XBT)"))).when(k == 1, F.concat(F.lit("alt. address bc1"), F.translate(h, "01", "qz"), F.lit("; more"))).otherwise(F.regexp_replace("text", "[13]|bc1|0x", "_"))
    return A.feed_addresses(table(spark, sf_dir, "documents").where("text is not null").select(made.alias("remarks")), "remarks")


@query(f"WITH {HV}, n AS (SELECT from_address || '>' || to_address AS k, count(*) AS n FROM hv GROUP BY 1), s AS (SELECT from_address AS address, count(*) AS sent, count(DISTINCT to_address) AS peers, max(value) AS most FROM hv GROUP BY 1) SELECT address, sent, peers, most FROM s")
def client_wallet_stats(spark, sf_dir):
    return purchase_transfers(spark, sf_dir).groupBy(F.col("from_address").alias("address")).agg(F.count("*").alias("sent"), F.countDistinct("to_address").alias("peers"), F.max("value").alias("most"))


@query()
def resolved_entities(spark, sf_dir):
    """Entities of the purchase graph; clusters known before are trios of suppliers' users."""
    from tracewell.operators import heuristics as H
    from tracewell.plans.clustering import CFG

    hv = purchase_transfers(spark, sf_dir)
    known = _members(spark, sf_dir).join(_owned(spark, sf_dir).where("s_acctbal > 8000").select("address"), "address", "left_semi")
    links = cut(H.all_links(hv, CFG))
    found = P.resolve_entities(hv, links, known, CFG)
    return found.withColumn("signals", F.array_join("signals", ","))
