"""Pair heuristics, gated clusters, evidence, indicators and owners."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tracewell.config import EngineConfig
from tracewell.operators import clustering as C
from tracewell.operators import heuristics as H
from tracewell.operators.graph import bounded_cycles, connected_components, ego_density, k_hop
from tracewell.plans.base import QUERIES, ORACLES, query, table
from tracewell.sources.storage import cut, fresh_path
from tracewell.sources.tables import RunStore
from tracewell.sources.transfers import EV, HV, event_transfers, purchase_transfers

#: Event times are hours apart, so spans are days.
CFG = EngineConfig(min_shared_counterparties=2, temporal_window=21600, fan_threshold=3, cashout_window=86400, pass_through_window=86400 * 30, amount_ratio=0.3, loop_max_depth=6)


def _meant(src: str, contracts: bool = False, self_transfers: bool = False) -> str:
    return f"(SELECT * FROM {src} WHERE value >= {CFG.min_transfer_value}{'' if contracts else ' AND NOT is_contract_call'}{'' if self_transfers else ' AND from_address <> to_address'})"


def _similar(a: str, b: str, tol: float = 0.0) -> str:
    return f"({a} >= 0 AND {b} >= 0 AND abs({a} - {b}) <= greatest({tol}, greatest({a}, {b}, 1e-9) * {CFG.amount_ratio}))"


def _pairs(rows: str, key: str, member: str, least: int = 2, most: int | None = None) -> str:
    cap = "" if most is None else f" AND count(*) <= {most}"
    return f"""(WITH g AS (SELECT DISTINCT {key}, {member} AS m FROM ({rows})), s AS (SELECT {key} FROM g GROUP BY ALL HAVING count(*) >= {least}{cap})
 SELECT DISTINCT x.m AS a, y.m AS b FROM g x SEMI JOIN s USING ({key}) JOIN g y USING ({key}) WHERE x.m < y.m)"""


def heuristic_sql(name: str, src: str) -> str:
    m, mc = _meant(src), _meant(src, contracts=True)
    if name == "deposit_address_reuse":
        seed = f"""SELECT i.to_address AS node, i.from_address AS sender FROM {m} i
 JOIN (SELECT from_address AS node FROM {m} GROUP BY 1 HAVING count(DISTINCT to_address) = 1) u ON i.to_address = u.node
 JOIN (SELECT to_address AS node FROM {m} GROUP BY 1 HAVING count(DISTINCT from_address) BETWEEN 2 AND {CFG.max_pattern_size}) f ON i.to_address = f.node
 WHERE EXISTS (SELECT 1 FROM {m} o WHERE o.from_address = i.to_address AND o.ts BETWEEN i.ts AND i.ts + {CFG.pass_through_window} AND o.value <= i.value + {CFG.forwarding_tolerance}
 AND ({_similar('i.value', 'o.value', CFG.forwarding_tolerance)} OR o.value >= i.value * (1 - 2 * {CFG.amount_ratio})))"""
        return _pairs(seed, "node", "sender")
    if name == "coordinated_cashout":
        rows = f"""SELECT l.to_address || '|' || l.tx_hash AS grp, r.from_address AS sender FROM {m} l JOIN {m} r ON l.to_address = r.to_address AND r.ts BETWEEN l.ts AND l.ts + {CFG.cashout_window} AND {_similar('l.value', 'r.value')}
 WHERE l.to_address IN (SELECT to_address FROM {m} GROUP BY 1 HAVING count(DISTINCT from_address) BETWEEN 2 AND {CFG.max_pattern_size})"""
        return _pairs(rows, "grp", "sender")
    if name == "common_funder":
        p = _pairs(f"SELECT * FROM {m} WHERE to_address IN (SELECT from_address FROM {m})", "from_address", "to_address", 2, CFG.max_pattern_size)
        return f"(SELECT a, b FROM {p} p WHERE EXISTS (SELECT 1 FROM {m} x JOIN {m} y ON x.to_address = y.to_address WHERE x.from_address = p.a AND y.from_address = p.b))"
    if name == "behavioral_similarity":
        near = f"(SELECT DISTINCT u, peer FROM (SELECT from_address AS u, to_address AS peer FROM {mc} UNION ALL SELECT to_address, from_address FROM {mc}))"
        return f"""(WITH near AS {near}, d AS (SELECT u, count(*) AS d FROM near GROUP BY 1), s AS (SELECT x.u AS a, y.u AS b, count(*) AS n FROM near x JOIN near y USING (peer) WHERE x.u < y.u GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT a, b FROM s JOIN d da ON a = da.u JOIN d db ON b = db.u WHERE n >= {CFG.min_shared_counterparties} OR n / (da.d + db.d - n) >= {H.BEHAVIOUR_JACCARD})"""
    if name == "contract_interaction":
        calls = f"(SELECT * FROM {src} WHERE is_contract_call)"
        one = _pairs(f"SELECT to_address, from_address FROM {calls} GROUP BY 1, 2 HAVING count(*) >= 2", "to_address", "from_address", 2, H.CONTRACT_GROUP)
        return f"""(WITH c AS (SELECT DISTINCT to_address AS c FROM {calls}), p AS (SELECT DISTINCT to_address AS c, from_address AS w FROM {src} WHERE to_address IN (SELECT c FROM c)),
 g AS (SELECT DISTINCT from_address AS c, to_address AS w FROM {src} WHERE from_address IN (SELECT c FROM c)), pi AS (SELECT * FROM p EXCEPT SELECT * FROM g), po AS (SELECT * FROM g EXCEPT SELECT * FROM p)
 SELECT a, b FROM {one} UNION SELECT least(pi.w, po.w), greatest(pi.w, po.w) FROM pi JOIN po USING (c) WHERE pi.w <> po.w
 AND c IN (SELECT c FROM pi GROUP BY 1 HAVING count(*) <= {H.CONTRACT_GROUP}) AND c IN (SELECT c FROM po GROUP BY 1 HAVING count(*) <= {H.CONTRACT_GROUP}))"""
    if name == "repeated_flow":
        return f"""(SELECT a, b FROM (SELECT least(from_address, to_address) AS a, greatest(from_address, to_address) AS b, n FROM (SELECT from_address, to_address, count(*) AS n FROM {mc} GROUP BY 1, 2))
 GROUP BY 1, 2 HAVING count(*) = 2 OR max(n) >= 2)"""
    if name == "temporal_coordination":
        return f"""(WITH t AS (SELECT to_address AS r, from_address AS s, floor(ts) AS t FROM {m}), w AS (SELECT DISTINCT e.r, e.t, x.s FROM (SELECT DISTINCT r, t FROM t) e JOIN t x ON x.r = e.r AND x.t BETWEEN e.t - {CFG.temporal_window} AND e.t),
 k AS (SELECT r, t FROM w GROUP BY 1, 2 HAVING count(*) >= 3) SELECT DISTINCT x.s AS a, y.s AS b FROM w x SEMI JOIN k USING (r, t) JOIN w y USING (r, t) WHERE x.s < y.s)"""
    if name == "fan_pattern":
        ms = _meant(src, self_transfers=True)
        return f"(SELECT * FROM {_pairs(f'SELECT * FROM {ms}', 'from_address', 'to_address', CFG.fan_threshold)} UNION SELECT * FROM {_pairs(f'SELECT * FROM {ms}', 'to_address', 'from_address', CFG.fan_threshold)})"
    cycles = _cycles(m)
    return f"(WITH RECURSIVE {cycles} SELECT DISTINCT x AS a, y AS b FROM (SELECT unnest(p) AS x, p FROM closed), (SELECT 1) JOIN LATERAL (SELECT unnest(p) AS y) ON true WHERE x < y)"


def _cycles(m: str) -> str:
    return f"""step AS (SELECT DISTINCT from_address AS u, to_address AS v FROM {m}), walk AS (SELECT [u, v] AS p FROM step WHERE v > u
 UNION ALL SELECT list_append(p, v) FROM walk JOIN step ON p[-1] = u WHERE v > p[1] AND NOT list_contains(p, v) AND len(p) < {CFG.loop_max_depth}),
 closed AS (SELECT p, len(p) AS length FROM walk JOIN step ON p[-1] = u AND v = p[1])"""


_SOURCES = {"deposit_address_reuse": "hv", "coordinated_cashout": "ev", "common_funder": "hv", "behavioral_similarity": "hv", "contract_interaction": "ev", "repeated_flow": "ev", "temporal_coordination": "ev", "fan_pattern": "hv", "loop_detection": "hv"}


def _rows(spark, sf_dir, src):
    if src == "hv":
        return purchase_transfers(spark, sf_dir)
    return event_transfers(spark, sf_dir)


def _register(name: str, src: str) -> None:
    def run(spark, sf_dir):
        return H.HEURISTICS[name](_rows(spark, sf_dir, src), CFG)

    QUERIES[name] = run
    prefix = {"hv": HV, "ev": EV}[src]
    ORACLES[name] = f"WITH {prefix} SELECT a, b FROM {heuristic_sql(name, src)}"


for _name, _src in _SOURCES.items():
    _register(_name, _src)

#: The cluster queries use all heuristics.
_USED = list(_SOURCES)
LINKS = "links AS MATERIALIZED (" + " UNION ".join(f"SELECT a, b, '{n}' AS name FROM {heuristic_sql(n, 'hv')}" for n in _USED) + ")"
_PRIMARY = ", ".join(f"'{p}'" for p in H.PRIMARY)
GATED = f"{HV}, {LINKS}, gated AS MATERIALIZED (SELECT a, b, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM links GROUP BY 1, 2 HAVING count(DISTINCT name) >= 2 AND bool_or(name IN ({_PRIMARY})))"
CLUSTERED = f"""{GATED}, near AS (SELECT a AS u, b AS v FROM gated UNION SELECT b, a FROM gated), reach AS (SELECT DISTINCT u, u AS v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u),
 roots AS MATERIALIZED (SELECT u AS address, min(v) AS root, count(*) AS size FROM reach GROUP BY 1),
 members AS MATERIALIZED (SELECT address, 'C-' || upper(substr(sha1(array_to_string(list_sort(list(address) OVER (PARTITION BY root)), '|')), 1, 12)) AS cluster_id, size FROM roots)"""


def _gate_cfg():
    return EngineConfig(**{**CFG.__dict__, "min_heuristic_support": 2})


def _links(spark, sf_dir):
    return H.all_links(purchase_transfers(spark, sf_dir), CFG, _USED)


def _gated(spark, sf_dir):
    return H.gate(H.gated_links(purchase_transfers(spark, sf_dir), _gate_cfg()), _gate_cfg())


def _members(spark, sf_dir):
    return C.build_clusters(_gated(spark, sf_dir), CFG)


@query(f"WITH RECURSIVE {GATED} SELECT * FROM gated")
def pair_gate(spark, sf_dir):
    return _gated(spark, sf_dir).withColumn("names", F.array_join("names", ","))


@query(f"WITH RECURSIVE {CLUSTERED} SELECT * FROM members")
def clusters(spark, sf_dir):
    return _members(spark, sf_dir)


@query(f"""WITH RECURSIVE {CLUSTERED} SELECT x.cluster_id, name, count(*) AS n, least(1.0, round(count(*) / max(x.size), 6)) AS confidence
 FROM links JOIN members x ON a = x.address JOIN members y ON b = y.address WHERE x.cluster_id = y.cluster_id GROUP BY 1, 2""")
def cluster_evidence(spark, sf_dir):
    return C.evidence(_links(spark, sf_dir), _members(spark, sf_dir))


_D = "CAST(coalesce(sum(CASE WHEN {} THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DOUBLE)"


@query(f"""WITH RECURSIVE {CLUSTERED}, j AS (SELECT hv.*, x.cluster_id AS ca, y.cluster_id AS cb FROM hv LEFT JOIN members x ON from_address = x.address LEFT JOIN members y ON to_address = y.address),
 t AS (SELECT *, ca AS cluster_id FROM j WHERE ca IS NOT NULL UNION ALL SELECT *, cb FROM j WHERE cb IS NOT NULL AND cb IS DISTINCT FROM ca)
SELECT cluster_id, count(*) AS tx_count, count(CASE WHEN ca = cb THEN 1 END) AS internal_tx, count(CASE WHEN is_contract_call THEN 1 END) AS contract_calls, (SELECT count(*) FROM members m WHERE m.cluster_id = t.cluster_id) AS size, {_D.format('ca = cb')} AS internal_volume, {_D.format('true')} AS total_volume, {_D.format('cb = cluster_id')} AS total_in, {_D.format('ca = cluster_id')} AS total_out,
 min(ts) AS first_ts, max(ts) AS last_ts, round({_D.format('cb = cluster_id')} - {_D.format('ca = cluster_id')}, 2) AS net, max(ts) - min(ts) AS span FROM t GROUP BY 1""")
def cluster_indicators(spark, sf_dir):
    return C.indicators(purchase_transfers(spark, sf_dir), _members(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLUSTERED}, o AS (SELECT c_nationkey AS owner_id, 'U' || (c_custkey // 10) AS address, c_custkey % 4 = 0 AS is_primary FROM customer),
 per AS (SELECT cluster_id, owner_id, count(*) AS n, max(is_primary::INT) AS p, min(address) AS any_address, min(CASE WHEN is_primary THEN address END) AS main FROM members JOIN o USING (address) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS n2, lead(p) OVER w AS p2 FROM per WINDOW w AS (PARTITION BY cluster_id ORDER BY n DESC, p DESC, owner_id))
SELECT cluster_id, CASE WHEN r.r IS NULL THEN 'unlabeled' WHEN n = n2 AND p = p2 THEN 'conflict' ELSE 'matched' END AS status,
 CASE WHEN coalesce(n = n2 AND p = p2, false) THEN NULL ELSE owner_id END AS owner_id, CASE WHEN coalesce(n = n2 AND p = p2, false) THEN NULL ELSE coalesce(main, any_address) END AS address
FROM (SELECT DISTINCT cluster_id FROM members) LEFT JOIN (SELECT * FROM r WHERE r = 1) r USING (cluster_id)""")
def owner_labels(spark, sf_dir):
    return C.owner_labels(_members(spark, sf_dir), _owners(spark, sf_dir))


def _owners(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner_id"), F.concat(F.lit("U"), F.floor(F.col("c_custkey") / 10)).alias("address"), (F.col("c_custkey") % 4 == 0).alias("is_primary"))


_SAYS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {
    "behavioral_similarity": "Addresses sharing >= N common counterparties are likely controlled by the same entity.",
    "coordinated_cashout": "Addresses cashing out similar amounts to the same collector in a short window are grouped as likely jointly controlled.",
    "common_funder": "Addresses funded by the same source and later converging on the same outbound counterparty are grouped as likely jointly controlled.",
    "contract_interaction": "Addresses interacting with the same smart contracts are grouped. Deposit->Contract->Withdraw cycles are linked as shared contract usage.",
    "deposit_address_reuse": "Addresses using the same forwarding deposit address are grouped as likely belonging to one operator or exchange account.",
    "fan_pattern": "Addresses on the receiving end of a fan-out (or sending end of a fan-in) are grouped as likely related.",
    "loop_detection": "Addresses forming circular transaction flows are grouped as likely coordinated or jointly controlled.",
    "temporal_coordination": "Addresses transacting within a short time window toward the same destination are flagged as coordinated.",
    "repeated_flow": "Addresses with repeated value transfers between each other are grouped as likely related entities.",
}.items())


@query(f"""WITH RECURSIVE {CLUSTERED}, o AS (SELECT c_nationkey AS owner_id, 'U' || (c_custkey // 10) AS address, c_custkey % 4 = 0 AS is_primary FROM customer),
 known AS (SELECT DISTINCT 'U' || user_id AS address FROM events WHERE event_type = 'signup'), m AS (SELECT address, cluster_id FROM known JOIN members USING (address)), big AS (SELECT cluster_id, count(*) AS size FROM m GROUP BY 1 HAVING count(*) >= 2),
 mm AS (SELECT * FROM m SEMI JOIN big USING (cluster_id)), per AS (SELECT cluster_id, owner_id, count(*) AS n, max(is_primary::INT) AS p, min(address) AS any_address, min(CASE WHEN is_primary THEN address END) AS main FROM mm JOIN o USING (address) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER w AS r, coalesce(n = lead(n) OVER w AND p = lead(p) OVER w, false) AS tie FROM per WINDOW w AS (PARTITION BY cluster_id ORDER BY n DESC, p DESC, owner_id)),
 inner_sum AS (SELECT x.cluster_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM hv JOIN members x ON from_address = x.address JOIN members y ON to_address = y.address WHERE x.cluster_id = y.cluster_id GROUP BY 1),
 ev_rows AS (SELECT x.cluster_id, name, count(*) AS n, least(1.0, round(count(*) / max(x.size), 6)) AS confidence FROM links JOIN members x ON a = x.address JOIN members y ON b = y.address WHERE x.cluster_id = y.cluster_id GROUP BY 1, 2)
SELECT 'cluster' AS part, cluster_id AS key, CASE WHEN r IS NULL THEN 'unlabeled' WHEN tie THEN 'conflict' ELSE 'matched' END || '/normal' AS text, CASE WHEN tie THEN NULL ELSE coalesce(main, any_address) END AS other, size AS n, coalesce(v, 0) AS amount FROM big LEFT JOIN (SELECT * FROM r WHERE r = 1) USING (cluster_id) LEFT JOIN inner_sum USING (cluster_id)
UNION ALL SELECT 'address', address, cluster_id, NULL, NULL, NULL FROM known LEFT JOIN mm USING (address)
UNION ALL SELECT 'evidence', cluster_id, CASE name {_SAYS} END || ' (signals: ' || n || ')', name, NULL, confidence FROM ev_rows SEMI JOIN big USING (cluster_id)
UNION ALL SELECT 'stale', cluster_id, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT cluster_id FROM members ANTI JOIN big USING (cluster_id))""")
def cluster_persist(spark, sf_dir):
    """A clustering run saved over the accounts that signed up, as one run, and read back: clusters with owners, every account's cluster, evidence, clusters that are gone."""
    hv, found = cut(purchase_transfers(spark, sf_dir)), cut(_members(spark, sf_dir))
    known = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.concat(F.lit("U"), "user_id").alias("address"))
    store = RunStore(spark, fresh_path(spark, "cluster-runs"))
    tables = C.persisted(found, C.evidence(_links(spark, sf_dir), found), C.indicators(hv, found), known, _owners(spark, sf_dir), found, _gate_cfg())
    store.save("CLR-1", datetime.datetime(2024, 2, 1), tables)
    last = cut(store.latest())
    clusters, addresses, evidence, stale = (store.read(n, last) for n in ("clusters", "addresses", "evidence", "stale"))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda part, key, text, other, n, amount: [F.lit(part).alias("part"), F.col(key).alias("key"), text.alias("text"), other.alias("other"), n.alias("n"), amount.alias("amount")]
    out = clusters.select(*row("cluster", "cluster_id", F.concat_ws("/", "label_status", "risk_level"), F.col("matched_owner_address"), F.col("size"), F.col("total_balance")))
    out = out.unionByName(addresses.select(*row("address", "address", F.col("cluster_id"), none("string"), none("long"), none("double"))))
    out = out.unionByName(evidence.select(*row("evidence", "cluster_id", F.col("text"), F.col("heuristic"), none("long"), F.col("confidence"))))
    return out.unionByName(stale.select(*row("stale", "cluster_id", none("string"), none("string"), none("long"), none("double"))))


_FLOW = "SELECT DISTINCT from_address AS a, to_address AS b FROM hv"


def _flow(spark, sf_dir):
    return purchase_transfers(spark, sf_dir).select(F.col("from_address").alias("a"), F.col("to_address").alias("b")).distinct()


@query(f"WITH RECURSIVE {HV}, {_cycles('hv')} SELECT array_to_string(p, '>') AS path, length FROM closed")
def cycles(spark, sf_dir):
    return bounded_cycles(_flow(spark, sf_dir), CFG.loop_max_depth).withColumn("path", F.array_join("path", ">"))


@query(f"WITH RECURSIVE {HV}, f AS ({_FLOW}), near AS (SELECT a AS u, b AS v FROM f WHERE a <> b UNION SELECT b, a FROM f WHERE a <> b), reach AS (SELECT DISTINCT u, u AS v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u) SELECT u AS node, min(v) AS root FROM reach GROUP BY 1")
def components(spark, sf_dir):
    return connected_components(_flow(spark, sf_dir))


@query(f"""WITH RECURSIVE {HV}, f AS ({_FLOW}), near AS (SELECT a AS u, b AS v FROM f UNION SELECT b, a FROM f), seeds AS (SELECT DISTINCT a AS s FROM f WHERE a IN ('U1', 'U2', 'U3', 'U10')),
 r AS (SELECT s AS seed, s AS node, 0 AS hop FROM seeds UNION SELECT seed, v, hop + 1 FROM r JOIN near ON node = u WHERE hop < 3) SELECT seed, node, min(hop) AS hop FROM r GROUP BY 1, 2""")
def khop(spark, sf_dir):
    flow = _flow(spark, sf_dir)
    seeds = flow.select(F.col("a").alias("node")).where(F.col("node").isin("U1", "U2", "U3", "U10")).distinct()
    return k_hop(flow, seeds, 3)


@query(f"""WITH {HV}, f AS ({_FLOW}), near AS (SELECT a AS u, b AS v FROM f UNION SELECT b, a FROM f), ego AS (SELECT DISTINCT u AS c, u AS x FROM near UNION SELECT u, v FROM near),
 n AS (SELECT c, count(*) AS n FROM ego GROUP BY 1), m AS (SELECT p.c, count(*) AS m FROM near JOIN ego p ON u = p.x JOIN ego q ON v = q.x AND p.c = q.c WHERE u < v GROUP BY 1)
SELECT c AS node, n, coalesce(m, 0) AS m, CASE WHEN n < 2 THEN 0 ELSE round(2 * coalesce(m, 0) / (n * (n - 1)), 6) END AS density FROM n LEFT JOIN m USING (c)""")
def ego_densities(spark, sf_dir):
    flow = _flow(spark, sf_dir)
    return ego_density(flow, flow.select(F.col("a").alias("node")).unionByName(flow.select(F.col("b").alias("node"))).distinct())
