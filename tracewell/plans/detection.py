"""Integration, placement and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.config import EngineConfig
from tracewell.operators import integration as I
from tracewell.operators import placement as P
from tracewell.operators import relational as R
from tracewell.operators import risk as K
from tracewell.operators.graph import propagate
from tracewell.plans.base import ORACLES, QUERIES, query, table
from tracewell.sources.storage import cut
from tracewell.sources.transfers import EV, HV, epoch, event_transfers, purchase_transfers

CFG = EngineConfig(
    convergence_senders=3, reaggregation_inputs=2, dormancy_seconds=86400 * 2, structuring_window=43200, structuring_min_tx=3, structuring_max_cv=0.3, high_value=200,
    smurf_senders=5, smurf_max_age=86400 * 365 * 40, micro_max=20, micro_count=40, micro_total=300, service_tx=430, service_degree=400,
)
_C = "greatest(0.0, least(1.0, {}))".format
_D = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"

SIGNAL_SQL = {
    "convergence": f"""SELECT address, 'convergence' AS signal, round(0.6 * {_C('n / 15.0')} + 0.4 * {_C('total / 50.0')}, 4) AS score FROM (SELECT to_address AS address, count(DISTINCT from_address) AS n, {_D} AS total FROM hv GROUP BY 1) WHERE n >= {CFG.convergence_senders}""",
    "dormancy": f"""SELECT address, 'dormancy' AS signal, round(0.55 * {_C('gap / 86400 / 90')} + 0.45 * {_C('v / 10')}, 4) AS score FROM (
 WITH seen AS (SELECT address, min(ts) AS first_seen FROM (SELECT to_address AS address, ts FROM hv UNION ALL SELECT from_address, ts FROM hv) GROUP BY 1),
 o AS (SELECT from_address AS address, value, ts - coalesce(lag(ts) OVER w, first_seen) AS gap, row_number() OVER w AS k FROM hv JOIN seen ON from_address = address WINDOW w AS (PARTITION BY from_address ORDER BY ts, tx_hash)),
 t AS (SELECT address, gap, k AS k0 FROM o QUALIFY row_number() OVER (PARTITION BY address ORDER BY gap DESC, k) = 1)
 SELECT address, max(t.gap) AS gap, {_D} AS v FROM o JOIN t USING (address) WHERE t.gap >= {CFG.dormancy_seconds} AND k >= k0 AND k < k0 + 3 GROUP BY 1) WHERE v >= {CFG.activation_value}""",
    "terminal_node": """SELECT address, 'terminal_node' AS signal, round(0.7 * CASE WHEN starts_with(address, '{exit}') THEN 0.85 ELSE 0.5 END + 0.3 * greatest(0.0, least(1.0, total / 20)), 4) AS score
 FROM (SELECT to_address AS address, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM hv GROUP BY 1) WHERE total >= 0.01 AND address NOT IN (SELECT from_address FROM hv WHERE value > 0)""",
    "reaggregation": f"""SELECT address, 'reaggregation' AS signal, round(0.35 * {_C('n / 16.0')} + 0.40 * {_C('(ratio - 0.7) / 0.3')} + 0.25 * {_C('(ao - ai) / greatest(ai, 0.001) / 10')}, 4) AS score FROM (
 SELECT i.address, n, ti, tout, ai, ao, tout / greatest(ti, 1e-9) AS ratio FROM (SELECT to_address AS address, count(*) AS n, {_D} AS ti, avg(value) FILTER (value > 0) AS ai FROM hv GROUP BY 1) i
 JOIN (SELECT from_address AS address, {_D} AS tout, avg(value) FILTER (value > 0) AS ao FROM hv GROUP BY 1) o USING (address)) WHERE n >= {CFG.reaggregation_inputs} AND ti >= 0.1 AND tout >= 0.1 AND ratio >= {CFG.reaggregation_ratio} AND ao > ai""",
}
_LEAST = {"terminal_node": 0.35}


def _signal(name: str):
    def run(spark, sf_dir):
        # known exits of the event graph: users whose number begins with 7
        more = {"exits": ("u7",)} if name == "terminal_node" else {}
        return getattr(I, name)(purchase_transfers(spark, sf_dir), CFG, **more)

    return run


for _n, _q in SIGNAL_SQL.items():
    QUERIES[_n] = _signal(_n)
    ORACLES[_n] = f"WITH {HV} SELECT * FROM ({_q.replace('{exit}', 'U7')}) WHERE score >= {_LEAST.get(_n, 0.3)}"

FIRED = "fired AS (" + " UNION ALL ".join(f"SELECT * FROM ({q.replace('{exit}', '0xd551234')}) WHERE score >= {_LEAST.get(n, 0.3)}" for n, q in SIGNAL_SQL.items()) + ")"
UP = "up AS (SELECT DISTINCT from_address AS address, CAST((CAST(substr(from_address, 2) AS INT) % 10) / 10.0 AS DOUBLE) AS layering, CAST((CAST(substr(from_address, 2) AS INT) % 4) / 4.0 AS DOUBLE) AS placement FROM hv)"


@query(f"""WITH {HV}, {FIRED}, {UP}, a AS (SELECT address, avg(score) AS mean, max(score) AS confidence, count(*) AS k, array_to_string(list_sort(list(DISTINCT signal)), ',') AS signals FROM fired GROUP BY 1)
SELECT * FROM (SELECT a.address, round({_C('mean + least(0.30, 0.15 * (k - 1)) + CASE WHEN layering > 0.5 THEN 0.10 ELSE 0 END + CASE WHEN placement > 0.5 THEN 0.05 ELSE 0 END')}, 4) AS score, confidence, k AS n_signals, signals FROM a LEFT JOIN up USING (address)) WHERE score >= 0.35""")
def integration_alerts(spark, sf_dir):
    hv = purchase_transfers(spark, sf_dir)
    n = F.substring("address", 2, 9).cast("int")
    up = hv.select(F.col("from_address").alias("address")).distinct().select("address", (n % 10 / 10.0).alias("layering"), (n % 4 / 4.0).alias("placement"))
    return I.alerts(hv, CFG, up)


#: Three users an entity; flows are all transfers between different ones, and what customers, who receive nothing, pay to suppliers, who own the users of their number.
MEM = "mem AS (SELECT DISTINCT 'U' || user_id AS address, 'C-' || (user_id // 3) AS entity FROM events)"
FLOW = f"""{EV}, {MEM}, flow AS (SELECT a.entity AS src, b.entity AS dst, ts, tx_hash, value FROM ev JOIN mem a ON from_address = a.address JOIN mem b ON to_address = b.address WHERE a.entity <> b.entity
  UNION ALL SELECT 'K' || o_custkey, 'C-' || (l_suppkey // 3), epoch(l_shipdate), concat_ws('-', 'D', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch(l_shipdate)::BIGINT, l_quantity::BIGINT), l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 prof AS (SELECT entity, min(ts) AS first_seen, max(ts) AS last_seen, count(CASE WHEN r = 'in' THEN 1 END) AS n_in FROM (SELECT src AS entity, ts, 'out' AS r FROM flow UNION ALL SELECT dst, ts, 'in' FROM flow) GROUP BY 1)"""


def _entity(user):
    return F.concat(F.lit("C-"), F.floor(user / 3))


def _trios(spark, sf_dir):
    user = table(spark, sf_dir, "events").select("user_id").distinct()
    return user.select(F.concat(F.lit("U"), "user_id").alias("address"), _entity(F.col("user_id")).alias("entity"))


def _flows(spark, sf_dir):
    within = P.entity_flows(event_transfers(spark, sf_dir), _trios(spark, sf_dir))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    ts = epoch(F.col("l_shipdate"))
    name = F.concat_ws("-", F.lit("D"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ts.cast("long"), F.col("l_quantity").cast("long"))
    return within.unionByName(lines.select(F.concat(F.lit("K"), "o_custkey").alias("src"), _entity(F.col("l_suppkey")).alias("dst"), ts.alias("ts"), name.alias("tx_hash"), F.col("l_quantity").alias("value")))


def _profiles(flows):
    both = flows.select(F.col("src").alias("entity"), "ts", F.lit("out").alias("r")).unionByName(flows.select(F.col("dst").alias("entity"), "ts", F.lit("in").alias("r")))
    return both.groupBy("entity").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.when(F.col("r") == "in", 1)).alias("n_in"))


_CV = "CASE WHEN count(CASE WHEN value > 0 THEN 1 END) < 2 THEN 0 ELSE stddev_pop(CASE WHEN value > 0 THEN value END) / greatest(avg(CASE WHEN value > 0 THEN value END), 1e-9) END"
_M = CFG.structuring_min_tx
BEHAVIOUR_SQL = {
    "structuring": f"""SELECT dst AS entity, 'structuring' AS behavior, confidence FROM (WITH k AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY ts, tx_hash) AS k FROM flow),
 w AS (SELECT r.dst, r.k AS rk, l.value, l.src FROM k r JOIN k l ON l.dst = r.dst AND l.k <= r.k AND r.ts - l.ts <= {CFG.structuring_window}),
 g AS (SELECT dst, rk, count(*) AS n, count(CASE WHEN value > 0 THEN 1 END) AS pos, {_CV} AS cv, {_D} AS total, count(DISTINCT src) AS senders FROM w GROUP BY 1, 2),
 f AS (SELECT dst, rk, round({_C(f"0.35 * least(1.0, n / {2 * _M}.0) + 0.35 * (1 - least(1.0, cv / {CFG.structuring_max_cv})) + 0.30 * least(1.0, total / {max(CFG.high_value, 1)}) + CASE WHEN senders >= 3 THEN 0.05 ELSE 0 END")}, 4) AS confidence
 FROM g WHERE n >= {_M} AND pos >= {_M} AND cv <= {CFG.structuring_max_cv}) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY dst ORDER BY confidence DESC, rk) = 1) WHERE confidence >= 0.55""",
    "smurfing": f"""SELECT entity, 'smurfing' AS behavior, confidence FROM (SELECT entity, round(0.45 * least(1.0, senders / {2.0 * CFG.smurf_senders}) + 0.35 * (1 - age / {CFG.smurf_max_age}) + 0.20 * single, 4) AS confidence FROM (
 SELECT dst AS entity, count(*) AS senders, count(CASE WHEN n = 1 THEN 1 END) / count(*) AS single FROM (SELECT dst, src, count(*) AS n FROM flow GROUP BY 1, 2) GROUP BY 1)
 JOIN (SELECT entity, last_seen - first_seen AS age FROM prof) USING (entity) WHERE senders >= {CFG.smurf_senders} AND age <= {CFG.smurf_max_age}) WHERE confidence >= 0.55""",
    "micro_funding": f"""SELECT entity, 'micro_funding' AS behavior, confidence FROM (SELECT entity, round(0.40 * least(1.0, n / {2.0 * CFG.micro_count}) + 0.40 * least(1.0, total / {3.0 * CFG.micro_total}) + 0.20 * (1 - least(1.0, cv / 0.5)), 4) AS confidence
 FROM (SELECT dst AS entity, count(*) AS n, {_D} AS total, {_CV} AS cv FROM flow WHERE value > 0 AND value <= {CFG.micro_max} GROUP BY 1) WHERE n >= {CFG.micro_count} AND total >= {CFG.micro_total}) WHERE confidence >= 0.55""",
}
for _n, _q in BEHAVIOUR_SQL.items():
    ORACLES[_n] = f"WITH {FLOW} {_q}"
RANKED = "ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY confidence DESC, behavior) AS rank FROM (" + " UNION ALL ".join(f"({q})" for q in BEHAVIOUR_SQL.values()) + "))"


def structuring(spark, sf_dir):
    return P.structuring(_flows(spark, sf_dir), CFG)


def smurfing(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    return P.smurfing(flows, _profiles(flows), CFG)


def micro_funding(spark, sf_dir):
    return P.micro_funding(_flows(spark, sf_dir), CFG)


QUERIES |= {f.__name__: f for f in (structuring, smurfing, micro_funding)}


def _behaved(flows):
    """Profiles and behaviours of written flows, written too."""
    profiles = cut(_profiles(flows))
    return profiles, cut(P.behaviors(flows, profiles, CFG))


def _ranked(spark, sf_dir):
    return _behaved(cut(_flows(spark, sf_dir)))[1]


@query(f"WITH {FLOW}, {RANKED} SELECT * FROM ranked")
def behaviors_ranked(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query(f"""WITH {FLOW}, {RANKED}, c AS (SELECT entity, max(confidence) FILTER (rank = 1) AS c1, max(confidence) FILTER (rank = 2) AS c2, max(confidence) FILTER (rank = 3) AS c3 FROM ranked GROUP BY 1),
 m AS (SELECT entity, CASE WHEN coalesce(c1 - c2 <= 0.15 AND c2 / greatest(c1, 1e-9) >= 0.82 AND c1 - c3 <= 0.06 AND c3 / greatest(c1, 1e-9) >= 0.94, false) THEN 'balanced' WHEN coalesce(c1 - c2 <= 0.15 AND c2 / greatest(c1, 1e-9) >= 0.82, false) THEN 'paired' ELSE 'dominant' END AS mode FROM c)
SELECT entity, mode, CASE mode WHEN 'balanced' THEN 3 WHEN 'paired' THEN 2 ELSE 1 END AS shown FROM m""")
def behavior_highlights(spark, sf_dir):
    return P.highlights(_ranked(spark, sf_dir))


def _trace_sql() -> str:
    """The traces hop by hop."""
    w = "greatest(0.0, least(1.0, (0.45 + 0.55 * least(1.0, total / greatest(total_in, total, 1e-9))) * CASE WHEN tx_count >= 430 OR degree >= 400 THEN 0.6 ELSE 1.0 END * {d} * CASE WHEN fan_out > 3 THEN 0.9 ELSE 1.0 END))"
    parts, ends = [
        f"edges AS (SELECT src AS up, dst AS rcv, {_D} AS total, min(ts) AS first_ts FROM flow GROUP BY 1, 2), tin AS (SELECT rcv, round(sum(total), 2) AS total_in FROM edges GROUP BY 1), fan AS (SELECT up, count(*) AS fan_out FROM edges GROUP BY 1), busy AS (SELECT entity AS up, sum(n) AS tx_count, count(*) AS degree FROM (SELECT entity, peer, count(*) AS n FROM (SELECT src AS entity, dst AS peer FROM flow UNION ALL SELECT dst, src FROM flow) GROUP BY 1, 2) GROUP BY 1), we AS (SELECT * FROM edges JOIN tin USING (rcv) JOIN fan USING (up) JOIN busy USING (up))",
        "f0 AS (SELECT DISTINCT entity AS root, [entity] AS path, CAST(1.0 AS DOUBLE) AS score FROM ranked)",
    ], []
    for d in range(CFG.max_hops):
        parts.append(f"s{d} AS MATERIALIZED (SELECT root, path, score, up, first_ts, total, round(score * {w.format(d=repr(0.95**d))}, 6) AS nxt FROM f{d} LEFT JOIN we ON path[-1] = rcv)")
        parts.append(f"g{d} AS MATERIALIZED (SELECT * FROM s{d} WHERE up IS NOT NULL AND NOT list_contains(path, up) AND nxt >= {P.CUTOFF} QUALIFY row_number() OVER (PARTITION BY root, path ORDER BY first_ts, total DESC, up) <= {CFG.branching})")
        parts.append(f"f{d + 1} AS (SELECT root, list_append(path, up) AS path, nxt AS score FROM g{d})")
        ends.append(f"SELECT root, path, score, 'no_incoming' AS \"end\" FROM s{d} WHERE up IS NULL")
        ends.append(f"SELECT DISTINCT root, path, score, 'confidence_cutoff' FROM s{d} WHERE up IS NOT NULL AND (root, path) NOT IN (SELECT (root, path) FROM g{d})")
    ends.append(f"SELECT root, path, score, 'max_hops_reached' FROM f{CFG.max_hops}")
    return ", ".join(parts) + ", traces AS MATERIALIZED (" + " UNION ALL ".join(ends) + ")"


TRACED = f"{FLOW}, {RANKED}, {_trace_sql()}"


def _traced(flows):
    """Profiles, behaviours and traces of written flows."""
    profiles, ranked = _behaved(flows)
    return profiles, ranked, P.trace(flows, ranked.select("entity").distinct(), CFG)


def _traces(spark, sf_dir):
    flows = cut(_flows(spark, sf_dir))
    return flows, *_traced(flows)[1:]


@query(f"""WITH {TRACED} SELECT root, array_to_string(path, '>') AS path, score, "end" FROM traces""")
def trace_paths(spark, sf_dir):
    return _traces(spark, sf_dir)[2].withColumn("path", F.array_join("path", ">"))


@query(f"""WITH {TRACED}, p AS (SELECT root, list_reverse(path) AS nodes, score, "end" AS reason, row_number() OVER (PARTITION BY root ORDER BY score DESC, list_reverse(path)) AS path_index FROM traces),
 h AS (SELECT root, nodes, score, reason, path_index, unnest(range(0, greatest(len(nodes) - 1, 1))) AS depth FROM p), e AS (SELECT src, dst, {_D} AS value, min(ts) AS first_ts, max(ts) AS last_ts FROM flow GROUP BY 1, 2)
SELECT root, nodes[1] AS origin, path_index, depth, nodes[depth + 1] AS upstream, nodes[depth + 2] AS downstream, score, (depth = greatest(len(nodes) - 2, 0))::INT AS is_terminal, CASE WHEN depth = greatest(len(nodes) - 2, 0) THEN reason END AS reason,
 coalesce(value, 0.0) AS value, first_ts, last_ts FROM h LEFT JOIN e ON src = nodes[depth + 1] AND dst = nodes[depth + 2]""")
def trace_rows(spark, sf_dir):
    flows, _, traces = _traces(spark, sf_dir)
    return P.trace_rows(flows, traces)


SCORED = f"""{TRACED}, best AS (SELECT entity, max(confidence) AS best FROM ranked GROUP BY 1), pt AS (SELECT path[-1] AS entity, root, len(path) - 1 AS depth, score FROM traces),
 gr AS (SELECT entity, max(depth) AS depth, round(avg(score), 6) AS ps FROM pt GROUP BY 1),
 rt AS (SELECT p.entity, max(b.best) AS below, sum(CAST(greatest(0, r.first_seen - o.first_seen) AS DECIMAL(24,6)))::DOUBLE / count(*) AS gap FROM (SELECT DISTINCT entity, root FROM pt) p LEFT JOIN best b ON root = b.entity JOIN prof r ON root = r.entity JOIN prof o ON p.entity = o.entity GROUP BY 1),
 hist AS (SELECT DISTINCT dst AS entity FROM flow WHERE src IN (SELECT entity FROM best)),
 parts AS (SELECT entity, {_C("greatest(coalesce(best, 0), coalesce(below, 0) * CASE WHEN coalesce(best, 0) > 0 THEN 1.0 ELSE 0.88 END)")} AS b,
  {_C(f"0.45 * CASE WHEN n_in = 0 THEN 1.0 ELSE 0.7 END + 0.25 * least(1.0, depth / {CFG.max_hops}.0) + 0.30 * ps")} AS g, {_C(f"0.55 * least(1.0, gap / {float(max(86400, CFG.smurf_max_age))}) + 0.45 * CASE WHEN n_in = 0 THEN 1.0 ELSE 0.7 END")} AS t, entity IN (SELECT entity FROM hist) AS history
  FROM gr JOIN rt USING (entity) LEFT JOIN best USING (entity) JOIN prof USING (entity) WHERE best IS NOT NULL OR below IS NOT NULL),
 placed AS MATERIALIZED (SELECT * FROM (SELECT entity, round(b, 4) AS behavior_score, round(g, 4) AS graph_score, round(t, 4) AS temporal_score, history, round({_C("(0.4 * b + 0.4 * g + 0.2 * t) * CASE WHEN history THEN 0.8 ELSE 1.0 END")}, 4) AS score FROM parts) WHERE score >= 0.55)"""


def _placed_of(flows):
    """Profiles, traces, behaviours and placements of written flows."""
    profiles, ranked, traces = _traced(flows)
    return profiles, traces, ranked, cut(P.scores(traces, ranked, profiles, flows, CFG))


def _placed(spark, sf_dir):
    return _placed_of(cut(_flows(spark, sf_dir)))[1:]


@query(f"WITH {SCORED} SELECT * FROM placed")
def placement_scores(spark, sf_dir):
    return _placed(spark, sf_dir)[2]


@query(f"""WITH {SCORED}, sus AS (SELECT entity, max(confidence) AS confidence FROM ranked GROUP BY 1) SELECT entity, 'placement_origin' AS label, score AS confidence FROM placed
 UNION ALL SELECT entity, 'suspicious_receiver', confidence FROM sus WHERE entity NOT IN (SELECT entity FROM placed)
 UNION ALL SELECT DISTINCT entity, 'intermediate_node', CAST(NULL AS DOUBLE) FROM (SELECT unnest(path[2:-2]) AS entity FROM traces WHERE len(path) > 2) WHERE entity NOT IN (SELECT entity FROM placed) AND entity NOT IN (SELECT entity FROM sus)""")
def placement_labels(spark, sf_dir):
    traces, ranked, placed = _placed(spark, sf_dir)
    return P.labels(traces, placed, ranked)


@query(f"""WITH {TRACED}, l AS (SELECT DISTINCT path[-1] AS entity, root AS src FROM traces UNION SELECT DISTINCT path[-1], path[-1] FROM traces),
 sign AS (SELECT l.entity, behavior, round(confidence * CASE WHEN src = l.entity THEN 1.0 ELSE 0.92 END, 4) AS confidence, CASE WHEN src = l.entity THEN 'origin' ELSE 'downstream' END AS relation FROM l JOIN ranked ON src = ranked.entity),
 best AS (SELECT * FROM sign QUALIFY row_number() OVER (PARTITION BY entity, behavior ORDER BY confidence DESC, relation DESC) = 1)
SELECT *, row_number() OVER (PARTITION BY entity ORDER BY confidence DESC, behavior DESC) AS rank FROM best""")
def behavior_profiles(spark, sf_dir):
    _, ranked, traces = _traces(spark, sf_dir)
    return P.behavior_profiles(traces, ranked)


@query(f"""WITH {TRACED}, st AS (SELECT root, path, unnest(range(1, len(path))) AS i FROM traces WHERE len(path) > 1), hp AS (SELECT root, path, len(path) - i AS hop, path[i + 1] AS source, path[i] AS target FROM st),
 tx AS (SELECT src, dst, tx_hash FROM flow QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY ts, tx_hash) <= 20)
SELECT root, array_to_string(path, '>') AS path, hop, source, target, tx_hash FROM hp JOIN tx ON src = source AND dst = target""")
def trace_hops(spark, sf_dir):
    flows, _, traces = _traces(spark, sf_dir)
    return P.trace_hops(flows, traces).withColumn("path", F.array_join("path", ">"))


@query(f"""WITH {FLOW}, {RANKED} SELECT 'behavior' AS kind, behavior AS name, count(*) AS n FROM ranked GROUP BY 2 UNION ALL SELECT 'rank', CAST(rank AS VARCHAR), count(*) FROM ranked GROUP BY 2""")
def run_summary(spark, sf_dir):
    ranked = cut(_ranked(spark, sf_dir))
    return ranked.groupBy(F.lit("behavior").alias("kind"), F.col("behavior").alias("name")).agg(F.count("*").alias("n")).unionByName(ranked.groupBy(F.lit("rank").alias("kind"), F.col("rank").cast("string").alias("name")).agg(F.count("*").alias("n")))


# risk: factors of entities, each from a whole table by a stated rule; the statements hold the weights as literals
LABEL_SQL = """lab AS (SELECT 'C-' || (s_suppkey // 3) AS entity, ['sanctioned', 'Sanction', 'scam', 'fraud', 'mixer', 'mixing', 'darknet', 'ransomware', 'hack', 'exploit', 'high_risk', 'watchlist', 'exchange', 'merchant', 'unknown', 'company'][s_nationkey % 16 + 1] AS category,
  CASE WHEN s_acctbal < 0 THEN 'scam' WHEN s_acctbal < 5000 THEN 'merchant' ELSE 'person' END AS entity_type FROM supplier),
 w AS (SELECT * FROM (VALUES ('sanctioned', 1.00), ('sanction', 1.00), ('scam', 0.95), ('fraud', 0.92), ('mixer', 0.90), ('mixing', 0.90), ('darknet', 0.88), ('ransomware', 0.88), ('hack', 0.82), ('exploit', 0.82), ('high_risk', 0.75),
  ('watchlist', 0.55), ('exchange', 0.15), ('merchant', 0.05), ('unknown', 0.00)) t(name, weight)),
 labelled AS (SELECT entity, max(coalesce(c.weight, e.weight, 0))::DOUBLE AS label FROM lab LEFT JOIN w c ON lower(category) = c.name LEFT JOIN w e ON entity_type = e.name GROUP BY 1)"""
BEHAVIOUR_SQL_RISK = """bh AS (SELECT DISTINCT 'C-' || (user_id // 3) AS entity, ['funneling', 'immediate_utilization', 'micro_funding', 'high_depth_transaction_chaining', 'structuring', 'smurfing', 'peeling_chain', 'bridge_hopping', 'shell_wallet_network', 'mixing_interaction', 'coordinated_cashout', 'loop_detection', 'other'][least(12, floor(value / 40))::INT + 1] AS behavior FROM events),
 bw AS (SELECT * FROM (VALUES ('loop_detection', 0.40), ('coordinated_cashout', 0.40), ('mixing_interaction', 0.35), ('shell_wallet_network', 0.35), ('bridge_hopping', 0.30), ('peeling_chain', 0.30), ('smurfing', 0.25), ('structuring', 0.25), ('high_depth_transaction_chaining', 0.25),
  ('micro_funding', 0.15), ('immediate_utilization', 0.10), ('funneling', 0.10)) t(behavior, weight)),
 behaved AS (SELECT entity, round(1 - exp(-sum(coalesce(weight, 0))::DOUBLE), 6) AS behavior FROM bh LEFT JOIN bw USING (behavior) GROUP BY 1)"""
SIGNAL_SQL_RISK = """sg AS (SELECT 'C-' || (user_id // 3) AS entity, CASE event_type WHEN 'view' THEN 'terminal_node' WHEN 'click' THEN 'convergence' WHEN 'purchase' THEN 'value_reaggregation' WHEN 'signup' THEN 'dormancy' ELSE 'reaggregation' END AS signal, floor(max(value)) / 500 AS score FROM events GROUP BY 1, 2),
 iw AS (SELECT * FROM (VALUES ('terminal_node', 0.30), ('convergence', 0.25), ('value_reaggregation', 0.20), ('dormancy', 0.15), ('asset_transformation', 0.10)) t(signal, weight)),
 integrated AS (SELECT entity, greatest(0.0, least(1.0, sum((coalesce(weight, 0) * greatest(0.0, least(1.0, score)))::DECIMAL(12,6))::DOUBLE)) AS integration FROM sg LEFT JOIN iw USING (signal) GROUP BY 1)"""
_BURST = """CASE WHEN n > 50 AND d < 3600 THEN 0.25 WHEN n > 20 AND d < 1800 THEN 0.15 WHEN n > 10 AND d < 3600 THEN 0.10 ELSE 0 END + CASE WHEN v > 10 AND d < 3600 THEN 0.25 WHEN v > 5 AND d < 7200 THEN 0.15 WHEN v > 1 AND d < 14400 THEN 0.05 ELSE 0 END"""
_LIFE = "count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v, max(epoch(ts)) - min(epoch(ts)) AS d FROM events"


def _listed(names, index):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (index + 1).cast("int"))


@query(f"WITH {LABEL_SQL} SELECT * FROM labelled")
def label_score(spark, sf_dir):
    """Suppliers own the users of their number; the category goes by nation."""
    kinds = ["sanctioned", "Sanction", "scam", "fraud", "mixer", "mixing", "darknet", "ransomware", "hack", "exploit", "high_risk", "watchlist", "exchange", "merchant", "unknown", "company"]
    other = F.when(F.col("s_acctbal") < 0, "scam").when(F.col("s_acctbal") < 5000, "merchant").otherwise("person")
    return K.label_score(table(spark, sf_dir, "supplier").select(_entity(F.col("s_suppkey")).alias("entity"), _listed(kinds, F.col("s_nationkey") % 16).alias("category"), other.alias("entity_type")))


@query(f"WITH {BEHAVIOUR_SQL_RISK} SELECT * FROM behaved")
def behavior_score(spark, sf_dir):
    """A behaviour for each step of 40 in the value of an entity's events."""
    kinds = ["funneling", "immediate_utilization", "micro_funding", "high_depth_transaction_chaining", "structuring", "smurfing", "peeling_chain", "bridge_hopping", "shell_wallet_network", "mixing_interaction", "coordinated_cashout", "loop_detection", "other"]
    rows = table(spark, sf_dir, "events").select(_entity(F.col("user_id")).alias("entity"), F.least(F.lit(12), F.floor(F.col("value") / 40)).alias("k")).distinct()
    return K.behavior_score(rows.select("entity", _listed(kinds, F.col("k")).alias("behavior")))


def _stats(spark, sf_dir, entity):
    t = F.col("ts").cast("timestamp").cast("double")
    return table(spark, sf_dir, "events").groupBy(entity.alias("entity")).agg(F.count("*").alias("tx_count"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.min(t).alias("first_ts"), F.max(t).alias("last_ts"))


@query(f"SELECT entity, {_BURST} AS temporal FROM (SELECT 'H' || floor(epoch(ts) / 3600)::BIGINT AS entity, {_LIFE} GROUP BY 1)")
def temporal_score(spark, sf_dir):
    """Each hour's events as an entity."""
    return K.temporal_score(_stats(spark, sf_dir, F.concat(F.lit("H"), F.floor(F.col("ts").cast("timestamp").cast("double") / 3600))))


@query(f"WITH {SIGNAL_SQL_RISK} SELECT * FROM integrated")
def integration_score(spark, sf_dir):
    """A signal for each type of event, as strong as its greatest value; the detector's own name for value_reaggregation has no weight."""
    kind = F.when(F.col("event_type") == "view", "terminal_node").when(F.col("event_type") == "click", "convergence").when(F.col("event_type") == "purchase", "value_reaggregation").when(F.col("event_type") == "signup", "dormancy").otherwise("reaggregation")
    rows = table(spark, sf_dir, "events").groupBy(_entity(F.col("user_id")).alias("entity"), kind.alias("signal")).agg((F.floor(F.max("value")) / 500).alias("score"))
    return K.integration_score(rows)


#: Propagation over the purchase graph of entities, from those whose label weighs 0.9 or more.
PROP = f"""{HV}, pe AS (SELECT DISTINCT 'C-' || (CAST(substr(from_address, 2) AS INT) // 3) AS a, 'C-' || (CAST(substr(to_address, 2) AS INT) // 3) AS b FROM hv), pn AS (SELECT a AS u, b AS v FROM pe WHERE a <> b UNION SELECT b, a FROM pe WHERE a <> b),
 ps AS (SELECT entity AS s, label AS score FROM labelled WHERE label >= 0.9),
 h AS (SELECT s AS seed, s AS node, 0 AS hop FROM ps UNION SELECT seed, v, hop + 1 FROM h JOIN pn ON node = u WHERE hop < 3),
 prop AS (SELECT node, max(CASE hop WHEN 0 THEN 1.0 WHEN 1 THEN score * 0.6 WHEN 2 THEN score * 0.3 ELSE score * 0.1 END)::DOUBLE AS risk FROM (SELECT seed, node, min(hop) AS hop FROM h GROUP BY 1, 2) JOIN ps ON seed = s GROUP BY 1)"""


def _propagated(spark, sf_dir):
    name = lambda c: _entity(F.substring(c, 2, 18).cast("long"))
    edges = purchase_transfers(spark, sf_dir).select(name("from_address").alias("a"), name("to_address").alias("b")).distinct()
    return propagate(edges, label_score(spark, sf_dir).where("label >= 0.9").select(F.col("entity").alias("node"), F.col("label").alias("score")))


@query(f"WITH RECURSIVE {LABEL_SQL}, {PROP} SELECT node, risk FROM prop")
def propagation(spark, sf_dir):
    return _propagated(spark, sf_dir)


RISK = f"""{LABEL_SQL}, {BEHAVIOUR_SQL_RISK}, {SIGNAL_SQL_RISK}, {PROP}, {MEM}, fl AS (SELECT a.entity AS src, b.entity AS dst, value FROM ev JOIN mem a ON from_address = a.address JOIN mem b ON to_address = b.address WHERE a.entity <> b.entity),
 es AS (SELECT dst AS entity, CAST(coalesce(sum(CASE WHEN src IN (SELECT s FROM ps) THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS risky, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM fl GROUP BY 1),
 ex AS (SELECT entity, CASE WHEN total < 0.01 THEN 0 ELSE round(risky / greatest(total, 1e-9), 6) END AS exposure FROM es),
 te AS (SELECT entity, {_BURST} AS temporal FROM (SELECT 'C-' || (user_id // 3) AS entity, {_LIFE} GROUP BY 1)),
 f AS (SELECT entity, coalesce(label, 0)::DOUBLE AS label, coalesce(behavior, 0)::DOUBLE AS behavior, coalesce(prop.risk, 0)::DOUBLE AS propagation, coalesce(temporal, 0)::DOUBLE AS temporal, coalesce(exposure, 0)::DOUBLE AS exposure, coalesce(integration, 0)::DOUBLE AS integration
  FROM (SELECT DISTINCT entity FROM mem) LEFT JOIN labelled USING (entity) LEFT JOIN behaved USING (entity) LEFT JOIN te USING (entity) LEFT JOIN integrated USING (entity) LEFT JOIN ex USING (entity) LEFT JOIN prop ON entity = node),
 risk AS (SELECT *, round({_C("0.25 * label + 0.20 * behavior + 0.15 * propagation + 0.10 * temporal + 0.10 * exposure + 0.20 * integration")}, 6) AS risk FROM f)"""


def _scored(spark, sf_dir):
    label, own = label_score(spark, sf_dir), _trios(spark, sf_dir)
    parts = [label, behavior_score(spark, sf_dir), integration_score(spark, sf_dir), K.temporal_score(_stats(spark, sf_dir, _entity(F.col("user_id"))))]
    parts.append(R.exposure(event_transfers(spark, sf_dir), own, label.where("label >= 0.9").select("entity")).select("entity", "exposure"))
    parts.append(_propagated(spark, sf_dir).select(F.col("node").alias("entity"), F.col("risk").alias("propagation")))
    return K.risk_scores(own, *parts)


@query(f"WITH RECURSIVE {RISK} SELECT * FROM risk")
def risk_scores(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(f"""WITH RECURSIVE {RISK} SELECT entity, risk, coalesce(CASE WHEN risk >= 0.8 THEN true WHEN risk < 0.7 THEN false ELSE CAST(substr(entity, 3) AS INT) % 2 = 0 END, false)
 AND (label >= 0.4)::INT + (behavior >= 0.4)::INT + (propagation >= 0.4)::INT + (temporal >= 0.4)::INT + (exposure >= 0.4)::INT + (integration >= 0.4)::INT >= 2 AS is_poi FROM risk""")
def poi_hysteresis(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return K.poi_status(scored, scored.select("entity", (F.substring("entity", 3, 9).cast("int") % 2 == 0).alias("was_poi")))


#: A sanction label, one more behaviour and an integration signal, with propagation counted double.
SIM = f"""{RISK}, n AS (SELECT *, greatest(label, 1.0) AS l2, {_C("1 - exp(-(CASE WHEN behavior < 1 THEN -ln(greatest(1 - behavior, 1e-9)) ELSE 3.0 END + 0.35))")} AS b2, {_C("integration + 0.25")} AS i2 FROM risk),
 sim AS (SELECT *, {_C("0.25 * l2 + 0.20 * b2 + 0.30 * propagation + 0.10 * temporal + 0.10 * exposure + 0.20 * i2")} AS total FROM n)"""
_CHANGED = " || ".join(f"CASE WHEN abs(round({b} - {a}, 4)) > 0.001 THEN '{name}=' || (round(round({b} - {a}, 4) * 10000))::BIGINT || ';' ELSE '' END" for name, a, b in (("behavior", "behavior", "b2"), ("integration", "integration", "i2"), ("label", "label", "l2")))


def _simulated(spark, sf_dir):
    return K.simulate(_scored(spark, sf_dir), add_label="sanctioned", toggle_behavior="mixing_interaction", add_integration="convergence", weights={"propagation": 0.30})


@query(f"""WITH RECURSIVE {SIM} SELECT entity, risk, round(total, 4) AS new_risk, round(round(total, 4) - risk, 4) AS difference, round(l2, 4) AS label, round(b2, 4) AS behavior, round(propagation, 4) AS propagation, round(temporal, 4) AS temporal, round(exposure, 4) AS exposure, round(i2, 4) AS integration,
 {_CHANGED} AS changed, total >= 0.8 AND (l2 >= 0.4)::INT + (b2 >= 0.4)::INT + (propagation >= 0.4)::INT + (temporal >= 0.4)::INT + (exposure >= 0.4)::INT + (i2 >= 0.4)::INT >= 2 AS would_be_poi,
 (l2 >= 0.4)::INT + (b2 >= 0.4)::INT + (propagation >= 0.4)::INT + (temporal >= 0.4)::INT + (exposure >= 0.4)::INT + (i2 >= 0.4)::INT AS strong FROM sim""")
def simulate(spark, sf_dir):
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("changed")), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] * 10000).cast("long").cast("string"), F.lit(";"))), "")
    return _simulated(spark, sf_dir).withColumn("changed", shown)


@query(f"""WITH RECURSIVE {SIM}, log AS (SELECT entity, 'simulate_risk' AS action, round(risk, 4) AS current, round(total, 4) AS simulated, CAST(regexp_extract(entity, '[0-9]+') AS INT) % 7 AS "at" FROM sim)
SELECT entity, action, current, simulated, "at", row_number() OVER (ORDER BY "at", entity) AS place FROM (SELECT * FROM log ORDER BY "at" DESC, entity DESC LIMIT 50)""")
def risk_audit(spark, sf_dir):
    """The end of the log of one simulation of every entity, a day of the week each."""
    log = K.audit_rows(_simulated(spark, sf_dir), "sanctioned", "analyst", F.regexp_extract("entity", "[0-9]+", 0).cast("int") % 7)
    return K.audit_tail(log).drop("override", "user")


@query(f"""WITH {EV}, e AS (SELECT 'C-' || (CAST(substr(from_address, 2) AS INT) // 3) AS entity, block_number AS "at", value FROM ev WHERE value IS NOT NULL),
 f AS (SELECT entity, "at", least(1.0, value / 150.0) AS label, least(1.0, value / 300.0) AS behavior, ("at" % 10) / 10.0 AS propagation, 0.0 AS temporal, ("at" % 5) / 5.0 AS exposure, least(1.0, value / 100.0) AS integration FROM e),
 r AS (SELECT *, round({_C('0.4 * label + 0.2 * behavior + 0.1 * propagation + 0.1 * exposure + 0.2 * integration')} * 1.2, 6) AS risk, (label >= 0.4)::INT + (behavior >= 0.4)::INT + (propagation >= 0.4)::INT + (exposure >= 0.4)::INT + (integration >= 0.4)::INT AS strong FROM f),
 d AS (SELECT *, CASE WHEN risk < 0.70 OR strong < 2 THEN false WHEN risk >= 0.80 THEN true END AS decided FROM r)
SELECT entity, "at", risk, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY entity ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS is_poi FROM d""")
def poi_history(spark, sf_dir):
    """Persons of interest over time: each event scores its user's trio anew."""
    return K.poi_history(poi_scores(spark, sf_dir))


def poi_scores(spark, sf_dir):
    """(entity, at, six factors, risk) of each event."""
    ev = event_transfers(spark, sf_dir).where("value is not null")
    at, v = F.col("block_number"), F.col("value")
    own = ev.select(
        _entity(F.substring("from_address", 2, 9).cast("int")).alias("entity"), at.alias("at"), F.least(F.lit(1.0), v / 150.0).alias("label"), F.least(F.lit(1.0), v / 300.0).alias("behavior"), (at % 10 / 10.0).alias("propagation"),
        F.lit(0.0).alias("temporal"), (at % 5 / 5.0).alias("exposure"), F.least(F.lit(1.0), v / 100.0).alias("integration"),
    )
    total = 0.4 * F.col("label") + 0.2 * F.col("behavior") + 0.1 * F.col("propagation") + 0.1 * F.col("exposure") + 0.2 * F.col("integration")
    return own.withColumn("risk", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) * 1.2, 6))


@query(f"""WITH {EV}, wl AS (SELECT 'U' || user_id AS address, epoch(ts) AS added_at, epoch(ts) + 86400.0 * (event_id % 9 - 1) AS expires_at FROM events WHERE event_type = 'signup'),
 t AS (SELECT tx_hash, from_address AS address, 'from' AS side, ts AS "at" FROM ev UNION ALL SELECT tx_hash, to_address, 'to', ts FROM ev),
 m AS (SELECT tx_hash, t.address, side, "at", arg_max(expires_at, (added_at, expires_at)) AS until FROM t JOIN wl ON wl.address = t.address AND added_at <= "at" GROUP BY ALL) SELECT tx_hash, address, side FROM m WHERE until > m."at" """)
def watchlist_over_time(spark, sf_dir):
    """A sign-up puts a user on the list for up to a week."""
    return K.screen_over_time(event_transfers(spark, sf_dir), watch_entries(spark, sf_dir))


def watch_entries(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select(F.concat(F.lit("U"), "user_id").alias("address"), epoch(F.col("ts")).alias("added_at"), (epoch(F.col("ts")) + 86400.0 * (F.col("event_id") % 9 - 1)).alias("expires_at"))


@query(f"""WITH {EV}, wl AS (SELECT DISTINCT 'U' || user_id AS address, 1700000000 + 86400.0 * (user_id % 14 - 7) AS expires_at FROM events WHERE user_id % 10 = 0), ok AS (SELECT address FROM wl WHERE expires_at > 1700000000)
SELECT tx_hash, from_address AS address, 'from' AS side FROM ev WHERE from_address IN (SELECT address FROM ok) UNION ALL SELECT tx_hash, to_address, 'to' FROM ev WHERE to_address IN (SELECT address FROM ok)""")
def watchlist_screening(spark, sf_dir):
    ev = event_transfers(spark, sf_dir)
    users = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 10 = 0").select("user_id").distinct()
    return K.screen(ev, users.select(F.concat(F.lit("U"), "user_id").alias("address"), (1700000000 + 86400.0 * (F.col("user_id") % 14 - 7)).alias("expires_at")), 1700000000.0)


@query(f"WITH {SCORED} SELECT entity, round(least(1.0, score + round(least(0.15, 0.15 * i), 4)), 4) AS score, round(least(0.15, 0.15 * i), 4) AS boost FROM (SELECT *, (CAST(regexp_extract(entity, '[0-9]+') AS INT) % 11) / 10.0 AS i FROM (SELECT entity, score FROM placed)) WHERE i >= 0.6")
def integration_feedback(spark, sf_dir):
    placed = _placed(spark, sf_dir)[2].select("entity", "score")
    return K.feedback(placed, placed.select("entity", (F.regexp_extract("entity", "[0-9]+", 0).cast("int") % 11 / 10.0).alias("integration")))
