"""Layering, wallet and custody queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalar import exact_sum
from tracewell.operators import layering as L
from tracewell.operators import relational as R
from tracewell.operators import wallet as W
from tracewell.operators.etl import keep_latest
from tracewell.plans.base import query, table
from tracewell.sources.storage import cut
from tracewell.sources.transfers import EV, HV, TR, event_transfers, purchase_transfers, trade_transfers

#: Services of the event graph.
SERVICES = [("U0", "mixer"), ("U1", "mixer"), ("U2", "bridge"), ("U3", "exchange")]
_SVC = "svc AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in SERVICES) + ") t(address, category))"
GAP = 86400 * 2


def _services(spark):
    return spark.createDataFrame(SERVICES, "address string, category string")


def _of(spark, kind):
    return _services(spark).where(F.col("category") == kind).select("address")


def _seeds(spark, sf_dir):
    return purchase_transfers(spark, sf_dir).select(F.col("from_address").alias("seed")).distinct()


@query(f"""WITH {EV}, {_SVC}, named AS (SELECT * FROM svc UNION SELECT DISTINCT to_address, 'bridge' FROM ev WHERE method_id = 'signup'), sides AS (SELECT from_address AS address, to_address AS peer FROM ev UNION ALL SELECT to_address, from_address FROM ev),
 busy AS (SELECT address, 'service_like' AS category FROM sides WHERE address NOT IN (SELECT address FROM named WHERE category IN ('mixer', 'bridge', 'exchange')) GROUP BY 1 HAVING count(*) >= 200 OR count(DISTINCT peer) >= 25)
SELECT address, array_to_string(list_sort(list(DISTINCT category)), ',') AS labels FROM (SELECT * FROM named UNION ALL SELECT * FROM busy) GROUP BY 1""")
def address_labels(spark, sf_dir):
    methods = spark.createDataFrame([("signup", "bridge")], "method_id string, category string")
    return L.address_labels(event_transfers(spark, sf_dir), _services(spark), methods).withColumn("labels", F.array_join("labels", ","))


_CAND = f"""SELECT i.to_address AS bridge, i.tx_hash AS deposit, o.tx_hash AS withdrawal, round(abs(i.value - o.value) / greatest(i.value, 1e-9) + (o.ts - i.ts) / {GAP}.0, 9) AS cost FROM ev i JOIN ev o ON i.to_address = o.from_address AND o.ts BETWEEN i.ts AND i.ts + {GAP}
 AND abs(i.value - o.value) / greatest(i.value, 1e-9) <= 0.2 WHERE i.to_address IN ('U1', 'U2')"""


def _candidates(spark, sf_dir):
    both = spark.createDataFrame([("U1",), ("U2",)], "address string")
    return L.bridge_candidates(event_transfers(spark, sf_dir), both, 0.2, GAP)


@query(f"WITH {EV} {_CAND}")
def bridge_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("bridge", "deposit", "withdrawal", "cost")


@query()
def bridge_pairs(spark, sf_dir):
    return L.match_bridges(_candidates(spark, sf_dir)).select("bridge", "deposit", "withdrawal", "cost")


@query()
def bridge_hopping(spark, sf_dir):
    return L.bridge_hopping(L.match_bridges(_candidates(spark, sf_dir)), _seeds(spark, sf_dir), R.address_degree(event_transfers(spark, sf_dir)), GAP)


def _peel_sql() -> str:
    """Hop by hop: the targets of the first day's transfers after the last hop, and the main one of them."""
    parts = ["f0 AS (SELECT DISTINCT from_address AS seed, [from_address] AS path, CAST(0 AS DOUBLE) AS since, CAST([] AS DOUBLE[]) AS mains, CAST([] AS DOUBLE[]) AS frags, CAST([] AS DOUBLE[]) AS times FROM hv)"]
    for k in range(6):
        falls = "true" if k == 0 else "v <= mains[-1] * 0.98"
        parts.append(f"s{k} AS (SELECT f.*, to_address AS target, ts, value, min(ts) OVER (PARTITION BY seed) AS t0 FROM f{k} f JOIN ev ON from_address = path[-1] AND from_address <> to_address AND ts >= since)")
        parts.append(f"p{k} AS (SELECT seed, any_value(path) AS path, any_value(mains) AS mains, any_value(frags) AS frags, any_value(times) AS times, target, round(sum(value), 8) AS v, min(ts) AS t FROM s{k} WHERE ts <= t0 + 86400 GROUP BY seed, target)")
        parts.append(f"r{k} AS MATERIALIZED (SELECT *, (sum(v) OVER w - v) / greatest(v, 1e-9) AS frag, count(*) OVER w AS n FROM p{k} WINDOW w AS (PARTITION BY seed) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY v DESC, t, target DESC) = 1)")
        parts.append(f"f{k + 1} AS MATERIALIZED (SELECT seed, list_append(path, target) AS path, t AS since, list_append(mains, v) AS mains, list_append(frags, frag) AS frags, list_append(times, t) AS times FROM r{k} WHERE n >= 2 AND frag BETWEEN 0.01 AND 5 AND NOT list_contains(path, target) AND {falls})")
    return ", ".join(parts)


@query(f"""WITH {HV}, {_peel_sql()}, done AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT *, {k} AS hops FROM f{k}" for k in range(2, 7))}) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hops DESC) = 1),
 x AS (SELECT *, list_avg(frags) AS m FROM done)
SELECT seed, array_to_string(path, '>') AS path, hops, round(m, 6) AS fragment_share, round(least(1.0, 0.30 * least(1.0, hops / 3.0) + 0.25 * 1.0 + 0.20 * greatest(0.0, 1 - sqrt(list_avg([power(f - m, 2) FOR f IN frags])) / m)
 + 0.15 * list_avg([exp(-(times[i + 1] - times[i]) / 86400) FOR i IN range(1, len(times))]) + 0.10 * list_avg([1 / (1 + f) FOR f IN frags])), 4) AS confidence FROM x""")
def peeling_chain(spark, sf_dir):
    return L.peeling_chain(event_transfers(spark, sf_dir), _seeds(spark, sf_dir), gap=86400.0, min_hops=2, high=5.0).withColumn("path", F.array_join("path", ">"))


@query(f"""WITH {EV}, {_SVC}, mx AS (SELECT address FROM svc WHERE category = 'mixer'), own AS (SELECT * FROM ev WHERE to_address IN (SELECT address FROM mx) AND from_address IN (SELECT from_address FROM ev WHERE method_id = 'purchase' AND value >= 100 AND from_address <> to_address)),
 n AS (SELECT from_address AS seed, count(*) AS n, count(DISTINCT to_address) AS mixers FROM own GROUP BY 1 HAVING count(*) >= 2), dn AS (SELECT seed, count(*) AS denominations FROM (SELECT from_address AS seed, round(value, 3) AS v FROM own GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1),
 fo AS (SELECT i.tx_hash FROM ev i JOIN ev o ON i.to_address = o.from_address AND o.ts BETWEEN i.ts AND i.ts + {GAP} AND abs(i.value - o.value) <= i.value * 0.05 WHERE i.to_address IN (SELECT address FROM mx) AND i.from_address <> o.to_address),
 hd AS (SELECT from_address AS seed, count(*) AS concealed FROM own JOIN fo USING (tx_hash) GROUP BY 1), gp AS (SELECT from_address AS seed, ts - lag(ts) OVER (PARTITION BY from_address ORDER BY ts, tx_hash) AS g FROM own), dl AS (SELECT seed, coalesce(avg(exp(-g / {GAP}.0)), 0.5) AS delay FROM gp GROUP BY 1),
 near AS (SELECT DISTINCT from_address AS u, to_address AS v FROM ev WHERE from_address <> to_address UNION SELECT DISTINCT to_address, from_address FROM ev WHERE from_address <> to_address), ego AS (SELECT address AS c, address AS x FROM mx UNION SELECT u, v FROM near WHERE u IN (SELECT address FROM mx)),
 en AS (SELECT c, count(*) AS n FROM ego GROUP BY 1), em AS (SELECT p.c, count(*) AS m FROM near JOIN ego p ON u = p.x JOIN ego q ON v = q.x AND p.c = q.c WHERE u < v GROUP BY 1), ed AS (SELECT max(round(2 * m / (n * (n - 1)), 6)) AS density FROM en JOIN em USING (c)),
 al AS (SELECT n.*, coalesce(denominations, 0) AS denominations, coalesce(concealed, 0) AS concealed, delay, (SELECT density FROM ed) AS density FROM n LEFT JOIN dn USING (seed) LEFT JOIN hd USING (seed) JOIN dl USING (seed))
SELECT seed, round(least(1.0, 0.30 + 0.25 * least(1.0, n / 3.0) + 0.20 * greatest(least(1.0, denominations), least(1.0, concealed / 2.0)) + 0.15 * least(1.0, density / 0.18) + 0.10 * delay), 4) AS confidence, n FROM al WHERE denominations >= 1 OR concealed >= 1 OR mixers >= 2 OR density >= 0.18""")
def mixing(spark, sf_dir):
    return L.mixing_interaction(event_transfers(spark, sf_dir), _seeds(spark, sf_dir), _of(spark, "mixer"), gap=GAP)


@query()
def shell_wallets(spark, sf_dir):
    return L.shell_networks(purchase_transfers(spark, sf_dir), _seeds(spark, sf_dir), window=86400.0 * 10, min_ratio=0.3, min_density=0.05, pass_through=GAP, services=_services(spark).select("address"))


@query()
def high_depth(spark, sf_dir):
    return L.high_depth(purchase_transfers(spark, sf_dir), _seeds(spark, sf_dir), min_depth=3, latency=86400.0 * 5, least=0.3, exchanges=_of(spark, "exchange"))


def _layering_hits(spark, sf_dir):
    """(seed, method, confidence) of all five detectors."""
    deep = high_depth(spark, sf_dir).groupBy("seed").agg(F.max("score").alias("confidence"))
    every = {"peeling_chain": peeling_chain(spark, sf_dir), "mixing_interaction": mixing(spark, sf_dir), "bridge_hopping": bridge_hopping(spark, sf_dir), "shell_wallet_network": shell_wallets(spark, sf_dir), "high_depth_transaction_chaining": deep}
    return reduce(DataFrame.unionByName, [df.select("seed", F.lit(n).alias("method"), "confidence") for n, df in every.items()])


@query()
def layering_alerts(spark, sf_dir):
    return L.layering_alerts(_layering_hits(spark, sf_dir))


@query(f"""WITH {EV} SELECT i.tx_hash, o.tx_hash AS follow FROM ev i JOIN ev o ON i.to_address = o.from_address AND o.ts BETWEEN i.ts AND i.ts + {GAP} AND abs(i.value - o.value) <= i.value * 0.05 WHERE i.to_address IN ('U0', 'U1') AND i.from_address <> o.to_address""")
def follow_on_concealment(spark, sf_dir):
    return L.follow_on(event_transfers(spark, sf_dir), _of(spark, "mixer"), GAP, 0.05)


@query(f"""WITH {EV}, {_SVC}, seen AS (SELECT address, min(ts) AS first_ts FROM (SELECT from_address AS address, ts FROM ev UNION ALL SELECT to_address, ts FROM ev) GROUP BY 1)
SELECT i.tx_hash, o.tx_hash AS follow FROM ev i JOIN ev o ON i.to_address = o.from_address AND o.ts BETWEEN i.ts AND i.ts + {20 * GAP} AND abs(i.value - o.value) <= i.value * 0.2 JOIN seen ON seen.address = o.to_address
 WHERE i.to_address IN ('U0', 'U1') AND i.from_address <> o.to_address AND o.to_address NOT IN (SELECT address FROM svc) AND o.ts - first_ts <= {20 * GAP}""")
def fresh_follow_on(spark, sf_dir):
    """What leaves a mixer for addresses that were first seen shortly before."""
    return L.follow_on(event_transfers(spark, sf_dir), _of(spark, "mixer"), 20 * GAP, 0.2, True, _services(spark).select("address"))


@query(f"""WITH {EV}, e AS (SELECT *, CAST(substr(from_address, 2) AS INT) % 10 AS community FROM ev WHERE CAST(substr(from_address, 2) AS INT) % 10 = CAST(substr(to_address, 2) AS INT) % 10)
SELECT DISTINCT l.community, l.tx_hash FROM e l WHERE EXISTS (SELECT 1 FROM e r WHERE r.community = l.community AND r.from_address = l.to_address AND r.ts BETWEEN l.ts AND l.ts + {GAP})""")
def layering_motion(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return L.layering_motion(event_transfers(spark, sf_dir), users.select(F.concat(F.lit("U"), "user_id").alias("address"), (F.col("user_id") % 10).alias("community")), GAP)


@query(f"""WITH {HV}, t AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM hv), w AS (SELECT t0 + 43200.0 * unnest(range(0, greatest(0, floor((t1 - t0 - 1e-9) / 43200.0))::BIGINT + 1)) AS window_start FROM t)
SELECT window_start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM w JOIN hv ON ts >= window_start AND ts <= window_start + 86400 GROUP BY 1""")
def window_activity(spark, sf_dir):
    return L.window_activity(purchase_transfers(spark, sf_dir), 86400.0)


# wallets: each sender and each receiver looks at its own transfers
WTX = f"{EV}, wtx AS (SELECT from_address AS wallet, * FROM ev WHERE from_address <> to_address UNION ALL SELECT to_address, * FROM ev)"


def _wallet_txs(spark, sf_dir):
    ev = event_transfers(spark, sf_dir)
    return ev.where("from_address <> to_address").withColumn("wallet", F.col("from_address")).unionByName(ev.withColumn("wallet", F.col("to_address")))


_FOUND = """SELECT DISTINCT wallet, 'method_signature' AS detector, CASE method_id WHEN 'purchase' THEN 'swap' ELSE 'approval' END AS label, tx_hash FROM wtx WHERE method_id IN ('purchase', 'signup')
 UNION SELECT wallet, 'known_protocol', CASE to_address WHEN 'U0' THEN 'tornado_cash' ELSE 'bridge' END, tx_hash FROM wtx WHERE to_address IN ('U0', 'U3') UNION SELECT wallet, 'value_heuristic', 'large_transfer', tx_hash FROM wtx WHERE value >= 150"""


def _detections(spark, sf_dir):
    protocols = spark.createDataFrame([("U0", "tornado_cash"), ("U3", "bridge")], "address string, label string")
    return W.detections(_wallet_txs(spark, sf_dir), protocols, {"purchase": "swap", "signup": "approval"}, 150.0)


@query(f"WITH {WTX} {_FOUND}")
def wallet_detections(spark, sf_dir):
    return _detections(spark, sf_dir)


_BOT = """bot AS (SELECT wallet, n, CASE WHEN t1 > t0 THEN round(n / ((t1 - t0) / 60), 6) ELSE 0 END AS rate, round(k / n, 6) AS top_share FROM (SELECT wallet, count(*) AS n, min(ts) AS t0, max(ts) AS t1 FROM wtx GROUP BY 1)
 JOIN (SELECT wallet, max(k) AS k FROM (SELECT wallet, to_address, count(*) AS k FROM wtx GROUP BY 1, 2) GROUP BY 1) USING (wallet))"""


@query(f"WITH {WTX}, {_BOT} SELECT *, n >= 10 AND (rate > 5 OR top_share > 0.8) AS is_bot FROM bot")
def bot_behavior(spark, sf_dir):
    return W.bot_behavior(_wallet_txs(spark, sf_dir))


_FAST = """fast AS (SELECT wallet, count(*) AS times FROM (SELECT wallet, CASE WHEN from_address = wallet THEN 'out' ELSE 'in' END AS d, lead(CASE WHEN from_address = wallet THEN 'out' ELSE 'in' END) OVER w AS nd, lead(ts) OVER w - ts AS gap
 FROM wtx WINDOW w AS (PARTITION BY wallet ORDER BY ts, tx_hash)) WHERE d = 'in' AND nd = 'out' AND gap > 0 AND gap < 600 GROUP BY 1)"""


@query(f"WITH {WTX}, {_FAST} SELECT * FROM fast")
def fast_movement(spark, sf_dir):
    return W.fast_movement(_wallet_txs(spark, sf_dir))


#: Two lists of flagged addresses: suppliers in debt by their balance, and the nations' users for all chains; an address may be on both.
_RISK = f"""{WTX}, {_BOT}, {_FAST}, found AS ({_FOUND}),
 flags AS (SELECT address, sum(points) AS points FROM (SELECT 'u' || s_suppkey AS address, 20 + s_suppkey % 50 AS points FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'U' || n_nationkey, 30 FROM nation) GROUP BY lower(address), address),
 agg AS (SELECT wallet, count(DISTINCT CASE WHEN lower(to_address) <> lower(wallet) THEN lower(to_address) END) AS targets, count(*) AS n, count(CASE WHEN from_address = wallet THEN 1 END) AS n_out,
  count(DISTINCT lower(from_address)) AS senders, (SELECT count(*) FROM (SELECT lower(from_address) FROM wtx x WHERE x.wallet = w.wallet UNION SELECT lower(to_address) FROM wtx x WHERE x.wallet = w.wallet)) AS peers FROM wtx w GROUP BY 1),
 det AS (SELECT wallet, count(*) FILTER (label = 'approval') AS approvals, max((label IN ('tornado_cash', 'bridge'))::INT) AS exposed, max((label = 'tornado_cash')::INT) AS mixed, max((label = 'large_transfer')::INT) AS large FROM found GROUP BY 1),
 cls AS (SELECT wallet, CASE WHEN mixed = 1 THEN 'mixer' WHEN wallet IN (SELECT 'U' || s_suppkey FROM supplier WHERE s_acctbal < -900) THEN 'smart contract' WHEN peers > 100 THEN 'exchange' WHEN bot.n >= 10 AND (rate > 5 OR top_share > 0.8) THEN 'bot' ELSE 'user wallet' END AS class
  FROM agg LEFT JOIN det USING (wallet) JOIN bot USING (wallet)),
 risk AS (SELECT wallet, least(100, coalesce((SELECT sum(points) FROM flags f WHERE lower(f.address) = lower(a.wallet)), 0) + CASE WHEN targets >= 10 THEN 10 ELSE 0 END + CASE WHEN a.n >= 15 THEN 15 ELSE 0 END
  + CASE WHEN n_out / a.n > 0.9 AND a.n >= 5 THEN 10 ELSE 0 END + CASE WHEN times > 0 THEN 20 ELSE 0 END + CASE WHEN approvals >= 3 THEN 10 ELSE 0 END + CASE WHEN exposed = 1 THEN 25 ELSE 0 END + CASE WHEN large = 1 THEN 5 ELSE 0 END
  + CASE class WHEN 'bot' THEN 15 WHEN 'mixer' THEN 30 ELSE 0 END)::INT AS score FROM agg a LEFT JOIN det USING (wallet) LEFT JOIN fast USING (wallet) JOIN cls USING (wallet))"""


def _wallet_risk(spark, sf_dir):
    txs, found = cut(_wallet_txs(spark, sf_dir)), _detections(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier")
    owed = supplier.where("s_acctbal < 0").select(F.concat(F.lit("u"), "s_suppkey").alias("address"), (F.col("s_suppkey") % 50 + 20).alias("points"))
    flagged = owed.unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("U"), "n_nationkey").alias("address"), F.lit(30).alias("points")))
    code = supplier.where("s_acctbal < -900").select(F.concat(F.lit("U"), "s_suppkey").alias("address"))
    return W.wallet_risk(txs, found, flagged, W.entity_class(txs, found, code))


@query(f"WITH {_RISK} SELECT wallet, score, CASE WHEN score >= 70 THEN 'high_risk' WHEN score >= 30 THEN 'suspicious' ELSE 'safe' END AS level FROM risk")
def wallet_risk(spark, sf_dir):
    return _wallet_risk(spark, sf_dir).drop("reasons")


_CLUS = """wp AS (SELECT from_address AS s, to_address AS t, count(*) AS n, min(ts) AS t0, max(ts) AS t1 FROM {0} GROUP BY 1, 2), wc AS (SELECT s AS source, 'hub' AS kind FROM wp WHERE n >= 2 GROUP BY 1 HAVING count(*) >= 2
 UNION ALL SELECT s, 'rapid_funding' FROM wp GROUP BY 1 HAVING count(*) >= 5 AND max(t1) - min(t0) < 86400 UNION ALL SELECT concat_ws('|', least(s, t), greatest(s, t)), 'bidirectional' FROM wp WHERE s <> t GROUP BY least(s, t), greatest(s, t) HAVING sum(n) >= 2)"""


@query(f"WITH {HV}, {_CLUS.format('hv')} SELECT * FROM wc")
def wallet_clusters(spark, sf_dir):
    return W.wallet_clusters(purchase_transfers(spark, sf_dir))


@query(f"""WITH {_RISK}, {_CLUS.format('ev')} SELECT DISTINCT wallet, alert FROM (SELECT wallet, 'high_risk' AS alert FROM risk WHERE score >= 70 UNION ALL SELECT wallet, 'watchlist' FROM risk WHERE wallet IN ('U5', 'U9') UNION ALL SELECT source, 'cluster_' || kind FROM wc WHERE kind <> 'bidirectional'
 UNION ALL SELECT wallet, 'sustained_activity' FROM wtx GROUP BY 1 HAVING max(ts) - min(ts) >= 86400 AND max(value) > 1) WHERE wallet IN (SELECT wallet FROM risk)""")
def wallet_alerts(spark, sf_dir):
    watch = spark.createDataFrame([("U5",), ("U9",)], "address string")
    return W.wallet_alerts(_wallet_risk(spark, sf_dir), _wallet_txs(spark, sf_dir), W.wallet_clusters(event_transfers(spark, sf_dir)), watch)


@query("""SELECT chain, address, max(points) AS points FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'ethereum' ELSE 'bitcoin' END AS chain, c_name AS address FROM customer) JOIN (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'ethereum' ELSE 'bitcoin' END AS fc, upper(replace(s_name, 'Supplier', 'Customer')) AS fa, s_suppkey % 50 AS points FROM supplier)
 ON lower(address) = lower(fa) AND fc IN (chain, 'global') GROUP BY 1, 2""")
def flagged_screening(spark, sf_dir):
    who = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "ethereum").otherwise("bitcoin").alias("chain"), F.col("c_name").alias("address"))
    s = table(spark, sf_dir, "supplier")
    chain = F.when(F.col("s_suppkey") % 3 == 0, "global").when(F.col("s_suppkey") % 3 == 1, "ethereum").otherwise("bitcoin")
    return W.screen_flagged(who, s.select(chain.alias("chain"), F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("address"), (F.col("s_suppkey") % 50).alias("points")))


@query(f"WITH {EV} SELECT from_address AS source, to_address AS target, count(*) AS n FROM ev WHERE from_address = 'U1' OR to_address = 'U1' GROUP BY 1, 2")
def ego_graph(spark, sf_dir):
    return W.ego_graph(event_transfers(spark, sf_dir), "U1")


@query(f"""WITH {HV}, ends AS (SELECT from_address AS u, to_address AS v FROM hv UNION SELECT to_address, from_address FROM hv), deg AS (SELECT u, count(*) AS d FROM ends GROUP BY 1), hubs AS (SELECT u FROM deg ORDER BY d DESC, u LIMIT 30), leaf AS (SELECT u FROM deg WHERE d = 1 AND u NOT IN (SELECT u FROM hubs))
SELECT hubs.u AS node, count(leaf.u) AS leaves FROM hubs LEFT JOIN ends ON hubs.u = ends.u LEFT JOIN leaf ON ends.v = leaf.u GROUP BY 1""")
def leaf_collapse(spark, sf_dir):
    return W.collapse_leaves(purchase_transfers(spark, sf_dir).select(F.col("from_address").alias("a"), F.col("to_address").alias("b")), 30)


_STAGE = "(SELECT 'C-' || (user_id % 20) AS key, max(value) AS score FROM events WHERE user_id % 20 < {0} GROUP BY 1 UNION ALL SELECT 'U' || user_id, max(value) FROM events WHERE user_id % 3 = {1} GROUP BY 1)"
_STAGES = {"placement": (5, 0), "layering": (10, 1), "integration": (15, 2)}


@query("WITH m AS (SELECT DISTINCT 'C-' || (user_id % 20) AS entity, 'U' || user_id AS address FROM events), every AS (" + " UNION ALL ".join(f"SELECT entity, '{s}' AS stage, score, 0 AS p FROM (SELECT DISTINCT entity FROM m) JOIN {_STAGE.format(*x)} r ON entity = key UNION ALL SELECT entity, '{s}', score, 1 FROM m JOIN {_STAGE.format(*x)} r ON address = key" for s, x in _STAGES.items()) + ") SELECT entity, stage, score, CASE p WHEN 0 THEN 'entity' ELSE 'address' END AS via FROM every QUALIFY row_number() OVER (PARTITION BY entity, stage ORDER BY p, score DESC) = 1")
def chain_of_custody(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entity, address = F.concat(F.lit("C-"), F.col("user_id") % 20), F.concat(F.lit("U"), "user_id")
    stage = lambda a, b: e.where(F.col("user_id") % 20 < a).groupBy(entity.alias("key")).agg(F.max("value").alias("score")).unionByName(e.where(F.col("user_id") % 3 == b).groupBy(address.alias("key")).agg(F.max("value").alias("score")))
    members = e.select(entity.alias("entity"), address.alias("address")).distinct()
    return W.chain_of_custody(members.select("entity").distinct(), {s: stage(*x) for s, x in _STAGES.items()}, members)


@query(f"WITH {TR} SELECT to_address AS address, count(DISTINCT from_address) AS senders, CAST(sum(value) AS DOUBLE) AS total FROM tr GROUP BY 1 HAVING count(DISTINCT from_address) >= 5")
def trade_convergence(spark, sf_dir):
    return trade_transfers(spark, sf_dir).groupBy(F.col("to_address").alias("address")).agg(F.countDistinct("from_address").alias("senders"), F.sum("value").cast("double").alias("total")).where("senders >= 5")


@query("SELECT page_id, url, length(html) AS size FROM pages QUALIFY row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id DESC) = 1")
def keyed_overwrite(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("long").alias("size")).withColumn("host", F.split_part("url", F.lit("/"), F.lit(3)))
    return keep_latest(p, ["host"], ["page_id"]).drop("host")


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, strftime(time_bucket(INTERVAL 12 HOURS, ts), '%Y-%m-%d %H:%M:%S') AS window_start FROM events GROUP BY user_id, time_bucket(INTERVAL 12 HOURS, ts)")
def half_day_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.window("ts", "12 hours")).agg(F.count("*").alias("n"), exact_sum("value").alias("total")).select("user_id", "n", "total", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"))
