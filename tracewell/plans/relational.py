"""Roll-ups, pages, top lists and load-stage queries over the derived transfer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import scalar as S
from tracewell.operators import etl, transform
from tracewell.operators import relational as R
from tracewell.plans.base import query, table
from tracewell.sources.storage import fresh_path, materialise
from tracewell.sources.transfers import EV, HV, TR, epoch, event_transfers, purchase_transfers, trade_transfers

#: Users in 20 entities.
MEMBERS = "members AS (SELECT DISTINCT 'U' || user_id AS address, 'C-' || (user_id % 20) AS entity FROM events)"
_SUM = "CAST(coalesce(sum(CAST({} AS DECIMAL(18,2))), 0) AS DOUBLE)"
ROLES = "roles AS (SELECT *, from_address AS address, to_address AS peer, 'out' AS role FROM {0} UNION ALL SELECT *, to_address, from_address, 'in' FROM {0})"


def members(spark, sf_dir, n=20):
    user = table(spark, sf_dir, "events").select("user_id").distinct()
    return user.select(F.concat(F.lit("U"), "user_id").alias("address"), F.concat(F.lit("C-"), F.col("user_id") % n).alias("entity"))


@query(f"""WITH {EV}, {ROLES.format('ev')} SELECT address, max((role = 'in' AND is_contract_call)::INT) AS is_contract, min(ts) AS first_seen, max(ts) AS last_seen,
 CAST(coalesce(sum(CASE WHEN role = 'in' THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total_in,
 CAST(coalesce(sum(CASE WHEN role = 'out' THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total_out, count(*) AS tx_count FROM roles GROUP BY address""")
def address_rollup(spark, sf_dir):
    return R.address_rollup(event_transfers(spark, sf_dir))


@query(f"""WITH {EV}, {ROLES.format('ev')} SELECT address, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS tx_count, count(DISTINCT CASE WHEN peer <> address THEN peer END) AS degree FROM roles GROUP BY address""")
def address_degree(spark, sf_dir):
    return R.address_degree(event_transfers(spark, sf_dir))


@query(f"""WITH {TR}, {ROLES.format('tr')} SELECT address, CAST(sum(CASE WHEN role = 'in' THEN value ELSE 0 END) AS DOUBLE) AS total_in, CAST(sum(CASE WHEN role = 'out' THEN value ELSE 0 END) AS DOUBLE) AS total_out,
 min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS tx_count, array_to_string(list_sort(list(DISTINCT tx_hash))[1:5], ',') AS some_hashes FROM roles GROUP BY address""")
def address_stats(spark, sf_dir):
    side = lambda r: F.sum(F.when(F.col("role") == r, F.col("value")).otherwise(0)).cast("double")
    rows = R.role_union(trade_transfers(spark, sf_dir))
    return rows.groupBy("address").agg(side("in").alias("total_in"), side("out").alias("total_out"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("tx_count")).join(R.some_hashes(rows, ["address"], 5, "h").select("address", F.array_join("h", ",").alias("some_hashes")), "address")


ENT = f"{EV}, {MEMBERS}, ent AS (SELECT ev.*, a.entity AS fe, b.entity AS te FROM ev JOIN members a ON from_address = a.address JOIN members b ON to_address = b.address)"


@query(f"""WITH {ENT}, u AS (SELECT fe AS entity, te AS peer, 'out' AS role, value, ts FROM ent WHERE fe <> te UNION ALL SELECT te, fe, 'in', value, ts FROM ent WHERE fe <> te UNION ALL SELECT fe, NULL, 'within', value, ts FROM ent WHERE fe = te)
SELECT entity, {", ".join(f"count(CASE WHEN role = '{r}' THEN 1 END) AS n_{r}, CAST(coalesce(sum(CASE WHEN role = '{r}' THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS sum_{r}" for r in ("in", "out", "within"))},
 count(DISTINCT peer) AS counterparties, min(ts) AS first_seen, max(ts) AS last_seen FROM u GROUP BY entity""")
def entity_profile(spark, sf_dir):
    return R.entity_profile(event_transfers(spark, sf_dir), members(spark, sf_dir))


@query(f"""WITH {ENT} SELECT fe AS src, te AS dst, {_SUM.format('value')} AS total, count(*) AS tx_count, min(ts) AS first_ts, max(ts) AS last_ts, array_to_string(list_sort(list(DISTINCT tx_hash))[1:20], ',') AS tx_hashes FROM ent WHERE fe <> te GROUP BY ALL""")
def entity_edges(spark, sf_dir):
    return R.entity_edges(event_transfers(spark, sf_dir), members(spark, sf_dir)).withColumn("tx_hashes", F.array_join("tx_hashes", ","))


@query(f"""WITH {ENT} SELECT least(fe, te) AS a, greatest(fe, te) AS b, {_SUM.format('value')} AS volume, count(*) AS tx_count FROM ent WHERE fe <> te GROUP BY 1, 2""")
def cluster_entity_graph(spark, sf_dir):
    return R.cluster_graph(event_transfers(spark, sf_dir), members(spark, sf_dir))


@query(f"""WITH {EV}, {MEMBERS} SELECT entity, count(*) AS tx_count, min(ts) AS first_ts, max(ts) AS last_ts, {_SUM.format('value')} AS total
 FROM (SELECT e.*, m.entity FROM ev e JOIN members m ON e.from_address = m.address UNION ALL SELECT e.*, m.entity FROM ev e JOIN members m ON e.to_address = m.address) GROUP BY entity""")
def tx_stats_or_join(spark, sf_dir):
    return R.entity_tx_stats(event_transfers(spark, sf_dir), members(spark, sf_dir))


@query(f"""WITH {ENT}, s AS (SELECT te AS entity, CAST(coalesce(sum(CASE WHEN fe IN ('C-0', 'C-1', 'C-2') THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS risky, {_SUM.format('value')} AS total FROM ent WHERE fe <> te GROUP BY te)
SELECT *, CASE WHEN total < 0.01 THEN 0 ELSE round(risky / greatest(total, 1e-9), 6) END AS exposure FROM s""")
def exposure_ratio(spark, sf_dir):
    risky = members(spark, sf_dir).where(F.col("entity").isin("C-0", "C-1", "C-2")).select("entity").distinct()
    return R.exposure(event_transfers(spark, sf_dir), members(spark, sf_dir), risky)


@query(f"""WITH {EV} SELECT count(CASE WHEN value < 10 THEN 1 END) AS under_10, count(CASE WHEN value >= 10 AND value < 50 THEN 1 END) AS b10_50, count(CASE WHEN value >= 50 AND value < 100 THEN 1 END) AS b50_100,
 count(CASE WHEN value >= 100 AND value < 200 THEN 1 END) AS b100_200, count(CASE WHEN value >= 200 THEN 1 END) AS over_200 FROM ev""")
def amount_histogram(spark, sf_dir):
    v = F.col("value")
    bins = {"under_10": v < 10, "b10_50": (v >= 10) & (v < 50), "b50_100": (v >= 50) & (v < 100), "b100_200": (v >= 100) & (v < 200), "over_200": v >= 200}
    return event_transfers(spark, sf_dir).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in bins.items()])


@query(f"""WITH {TR} SELECT count(*) AS n, CAST(coalesce(sum(value), 0) AS DOUBLE) AS total, count(CASE WHEN value >= 50000 THEN 1 END) AS high_value FROM tr""")
def totals_high_value(spark, sf_dir):
    return trade_transfers(spark, sf_dir).agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0)).cast("double").alias("total"), F.count(F.when(F.col("value") >= 50000, 1)).alias("high_value"))


@query(f"""WITH {TR} SELECT tx_hash, block_number, CAST(value AS DOUBLE) AS value_out FROM tr ORDER BY value DESC, block_number DESC, tx_hash DESC LIMIT 25 OFFSET 50""")
def top_transactions_page(spark, sf_dir):
    rows = trade_transfers(spark, sf_dir).orderBy(F.desc("value"), F.desc("block_number"), F.desc("tx_hash")).offset(50).limit(25)
    return rows.select("tx_hash", "block_number", F.col("value").cast("double").alias("value_out"))


_SCORE = "CASE WHEN value <= 0 THEN 0 WHEN value / 100 >= 2 THEN 100 WHEN value / 100 >= 1 THEN round(CAST(75 + 25 * (value / 100 - 1) AS DECIMAL(18,6)), 1) ELSE round(CAST(75 * (value / 100) AS DECIMAL(18,6)), 1) END"


@query(f"""WITH {EV}, s AS (SELECT tx_hash, {_SCORE} AS score FROM ev) SELECT tx_hash, CAST(score AS DOUBLE) AS score, CASE WHEN score > 75 THEN 'High' WHEN score > 40 THEN 'Medium' ELSE 'Low' END AS label FROM s""")
def tx_risk_score(spark, sf_dir):
    rows = event_transfers(spark, sf_dir).select("tx_hash", S.risk_score(F.col("value"), 100.0).alias("score"))
    return rows.withColumn("label", S.risk_label(F.col("score")))


@query(f"""WITH {EV}, s AS (SELECT {_SCORE} AS score FROM ev) SELECT CASE WHEN score > 75 THEN 'High' WHEN score > 40 THEN 'Medium' ELSE 'Low' END AS label, count(*) AS n FROM s GROUP BY 1""")
def tx_risk_label_counts(spark, sf_dir):
    return tx_risk_score(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {TR} SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, CAST(sum(abs(value)) AS DOUBLE) AS volume, count(*) AS n FROM tr GROUP BY 1""")
def daily_volume(spark, sf_dir):
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")
    return trade_transfers(spark, sf_dir).groupBy(day.alias("day")).agg(F.sum(F.abs("value")).cast("double").alias("volume"), F.count("*").alias("n"))


@query(f"""WITH {EV} SELECT CAST(sum(CASE WHEN lower(to_address) = 'u1' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS received, CAST(sum(CASE WHEN lower(from_address) = 'u1' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS sent,
 count(CASE WHEN lower(to_address) = 'u1' THEN 1 END) AS n_in, count(CASE WHEN lower(from_address) = 'u1' THEN 1 END) AS n_out FROM ev""")
def wallet_stats_case(spark, sf_dir):
    got, sent = F.lower("to_address") == "u1", F.lower("from_address") == "u1"
    v = F.col("value").cast("decimal(18,2)")
    return event_transfers(spark, sf_dir).agg(F.sum(F.when(got, v).otherwise(0)).cast("double").alias("received"), F.sum(F.when(sent, v).otherwise(0)).cast("double").alias("sent"), F.count(F.when(got, 1)).alias("n_in"), F.count(F.when(sent, 1)).alias("n_out"))


@query(f"WITH {EV} SELECT from_address, to_address, count(*) AS n, {_SUM.format('value')} AS total FROM ev GROUP BY ALL")
def pair_flow_counts(spark, sf_dir):
    return event_transfers(spark, sf_dir).groupBy("from_address", "to_address").agg(F.count("*").alias("n"), S.exact_sum("value").alias("total"))


@query(f"WITH {EV} SELECT least(from_address, to_address) AS a, greatest(from_address, to_address) AS b, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) >= 2")
def undirected_pair_counts(spark, sf_dir):
    return event_transfers(spark, sf_dir).groupBy(F.least("from_address", "to_address").alias("a"), F.greatest("from_address", "to_address").alias("b")).agg(F.count("*").alias("n")).where("n >= 2")


@query(f"WITH {EV} SELECT to_address, CAST(round(value, 0) AS DOUBLE) AS denomination, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) >= 2")
def denomination_histogram(spark, sf_dir):
    return event_transfers(spark, sf_dir).groupBy("to_address", F.round("value", 0).alias("denomination")).agg(F.count("*").alias("n")).where("n >= 2")


@query(f"WITH {EV} SELECT to_address, CASE WHEN count(CASE WHEN value > 0 THEN 1 END) < 2 THEN 0 ELSE round(stddev_pop(CASE WHEN value > 0 THEN value END) / greatest(avg(CASE WHEN value > 0 THEN value END), 1e-9), 6) END AS cv FROM ev GROUP BY 1")
def cv_per_receiver(spark, sf_dir):
    return event_transfers(spark, sf_dir).groupBy("to_address").agg(F.round(R.variation(F.col("value")), 6).alias("cv"))


@query(f"WITH {EV}, n AS (SELECT to_address, from_address, count(*) AS n FROM ev GROUP BY 1, 2) SELECT to_address, count(*) AS senders, round(count(CASE WHEN n = 1 THEN 1 END) / count(*), 6) AS single_share FROM n GROUP BY 1")
def single_tx_sender_share(spark, sf_dir):
    n = event_transfers(spark, sf_dir).groupBy("to_address", "from_address").agg(F.count("*").alias("n"))
    return n.groupBy("to_address").agg(F.count("*").alias("senders"), F.round(F.count(F.when(F.col("n") == 1, 1)) / F.count("*"), 6).alias("single_share"))


#: Runs of the analysis: one an order day, completed at its last order.
RUNS = "runs AS (SELECT 'R' || strftime(o_orderdate, '%Y%m%d') AS run_id, max(epoch(o_orderdate)) AS completed_at, count(*) AS n FROM orders GROUP BY 1)"


def runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("R"), F.date_format("o_orderdate", "yyyyMMdd")).alias("run_id")).agg(F.max(epoch(F.col("o_orderdate"))).alias("completed_at"), F.count("*").alias("n"))


@query(f"WITH {RUNS} SELECT * FROM runs ORDER BY completed_at DESC, run_id DESC LIMIT 1")
def latest_run(spark, sf_dir):
    return R.latest_run(runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT * FROM runs WHERE completed_at <= epoch(TIMESTAMP '1996-06-30') ORDER BY completed_at DESC, run_id DESC LIMIT 1")
def latest_run_before(spark, sf_dir):
    return R.latest_run(runs(spark, sf_dir).where(F.col("completed_at") <= F.lit("1996-06-30").cast("timestamp").cast("double")))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def label_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


_NATION = "SELECT n_name AS cluster, count(*) AS size, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


def _nations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("cluster")).agg(F.count("*").alias("size"), S.exact_sum("c_acctbal").alias("balance"))


@query(f"SELECT * FROM ({_NATION}) ORDER BY size DESC, cluster LIMIT 5")
def top_clusters_size(spark, sf_dir):
    return _nations(spark, sf_dir).orderBy(F.desc("size"), "cluster").limit(5)


@query(f"SELECT * FROM ({_NATION}) ORDER BY balance DESC, cluster LIMIT 5")
def top_clusters_balance(spark, sf_dir):
    return _nations(spark, sf_dir).orderBy(F.desc("balance"), "cluster").limit(5)


@query(f"WITH {EV}, {ROLES.format('ev')} SELECT address, count(*) AS degree FROM roles GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def hubs_top25(spark, sf_dir):
    return R.role_union(event_transfers(spark, sf_dir)).groupBy("address").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "address").limit(25)


@query(f"WITH {EV} SELECT tx_hash, from_address, to_address, value FROM ev WHERE value >= 10 ORDER BY value DESC, tx_hash LIMIT 50")
def high_value_top50(spark, sf_dir):
    return event_transfers(spark, sf_dir).where("value >= 10").orderBy(F.desc("value"), "tx_hash").limit(50).select("tx_hash", "from_address", "to_address", "value")


@query(f"""WITH {ENT}, risk AS (SELECT entity, (CAST(substr(entity, 3) AS INT) % 7) / 10.0 AS risk FROM (SELECT DISTINCT entity FROM members)),
 adj AS (SELECT least(fe, te) AS a, greatest(fe, te) AS b, {_SUM.format('value')} AS volume FROM ent WHERE fe <> te GROUP BY 1, 2)
SELECT peer, CAST(risk AS DOUBLE) AS risk, volume FROM (SELECT CASE WHEN a = 'C-3' THEN b ELSE a END AS peer, volume FROM adj WHERE a = 'C-3' OR b = 'C-3') JOIN risk ON peer = entity WHERE risk > 0 ORDER BY risk * volume DESC, peer LIMIT 10""")
def connected_risky(spark, sf_dir):
    ms = members(spark, sf_dir)
    risk = ms.select("entity").distinct().select(F.col("entity").alias("peer"), (F.substring("entity", 3, 9).cast("int") % 7 / 10.0).alias("risk"))
    adj = R.cluster_graph(event_transfers(spark, sf_dir), ms)
    near = adj.where("a = 'C-3'").select(F.col("b").alias("peer"), "volume").unionByName(adj.where("b = 'C-3'").select(F.col("a").alias("peer"), "volume"))
    return near.join(risk, "peer").where("risk > 0").orderBy(F.desc(F.col("risk") * F.col("volume")), "peer").limit(10).select("peer", "risk", "volume")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_keep_latest(spark, sf_dir):
    return etl.keep_latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""SELECT o_orderkey AS block_number, CASE WHEN o_orderkey % 5 = 0 THEN coalesce(n, 0) > 0 ELSE coalesce(n, 0) = o_orderkey % 7 END AS use_flat FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def completeness_fallback(spark, sf_dir):
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_number"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 7).alias("transaction_count"))
    return etl.complete_blocks(heads, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_number")))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def upsert_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return etl.upsert(c.where("id % 2 = 0"), c.where("id % 3 = 0").withColumn("balance", F.col("balance") + 1), ["id"])


@query(f"WITH {EV} SELECT * FROM ev WHERE block_number > (SELECT max(block_number) FROM ev WHERE block_number % 97 = 0 AND block_number < 5000)")
def incremental_watermark(spark, sf_dir):
    rows = event_transfers(spark, sf_dir)
    return etl.incremental(rows, rows.where("block_number % 97 = 0 and block_number < 5000"))


@query("""SELECT lower(trim(o_orderpriority)) AS priority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,18))::VARCHAR AS amount, CAST(o_orderstatus = 'F' AS INT) AS done, o_orderkey FROM orders""")
def clean_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.lower(F.trim("o_orderpriority")).alias("priority"), F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(38,18)").cast("string").alias("amount"), (F.col("o_orderstatus") == "F").cast("int").alias("done"), "o_orderkey")


@query("""SELECT o_orderkey AS block_number, 't' || o_orderkey || '-' || i AS tx_hash, CASE WHEN i = 2 THEN NULL ELSE 'a' || i END AS to_address, i = 2 AS is_contract_call, CASE WHEN i <> 1 THEN 1 ELSE 0 END AS status FROM orders, (SELECT unnest([0, 1, 2]) AS i)""")
def flatten_documents(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    tx = [F.struct(F.concat(F.lit("T"), k, F.lit(f"-{i}")).alias("hash"), F.lit("A0").alias("from"), (F.lit(None) if i == 2 else F.lit(f"A{i}")).cast("string").alias("to"), F.lit("1000000000000000000").alias("value"), F.lit(None).cast("string").alias("input"), F.lit("1").alias("gas")) for i in range(3)]
    receipts = [F.struct(F.concat(F.lit("T"), k, F.lit(f"-{i}")).alias("transactionHash"), F.lit(f"0x{s}").alias("status"), F.lit("0x5208").alias("gasUsed")) for i, s in ((0, 0), (0, 1), (2, 1))]
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_number"), F.lit("x").alias("fetched_at"), F.array(*tx, tx[0]).alias("transactions"), F.array(*receipts).alias("receipts"))
    return etl.flatten_blocks(blocks).select("block_number", "tx_hash", "to_address", "is_contract_call", "status")


_LINES = """l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_quantity) = 1),
 n AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last FROM l GROUP BY 1)"""


@query(f"""WITH {_LINES}, e AS (SELECT o_orderkey, o_custkey, n, last, o_orderkey % 4 = 0 AS lacks, CASE WHEN o_orderkey % 5 <> 0 THEN n END AS expects FROM orders JOIN n ON l_orderkey = o_orderkey),
 w AS (SELECT *, CASE WHEN expects IS NULL THEN n - lacks::INT > 0 ELSE NOT lacks END AS use_flat FROM e)
SELECT o_orderkey AS block_number, 'l' || o_orderkey || '-' || l_linenumber AS tx_hash, 'c' || o_custkey AS from_address, 's' || l_suppkey AS to_address, l_quantity::DOUBLE AS value_eth, CASE WHEN use_flat THEN 'flat' ELSE 'raw' END AS derived
FROM w JOIN l ON l_orderkey = o_orderkey WHERE NOT (use_flat AND lacks AND l_linenumber = last)""")
def resumed_transform(spark, sf_dir):
    """Orders as blocks and lines as their transactions: every fourth order lacks its last line among the flat documents, every fifth header says no number. Run in batches, stopped after two and begun again."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_quantity")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    own = materialise(lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"), "order-lines")
    name, sender, target = F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber"), F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("S"), "l_suppkey")
    each = own.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"))
    heads = each.select(F.col("l_orderkey").alias("block_number"), F.when(F.col("l_orderkey") % 5 != 0, F.col("n")).alias("transaction_count"))
    none = lambda kind: F.lit(None).cast(kind)
    there = own.join(each, "l_orderkey").where("not (l_orderkey % 4 = 0 and l_linenumber = last)")
    flat = there.select(
        F.lower(name).alias("tx_hash"), F.struct(F.col("l_orderkey").cast("long").alias("number"), none("string").alias("timestamp")).alias("block"), F.struct(sender.alias("from"), target.alias("to")).alias("address_pair"), F.struct(F.col("l_quantity").cast("double").alias("eth")).alias("value"),
        F.struct(F.lit(False).alias("is_contract"), none("string").alias("method_id"), F.col("l_linenumber").cast("int").alias("transaction_index")).alias("forensics"), F.struct(none("long").alias("gas_used")).alias("gas"),
    )
    wei = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("0" * 18))
    tx = F.struct(name.alias("hash"), sender.alias("from"), target.alias("to"), wei.alias("value"), none("string").alias("input"), none("string").alias("gas"))
    raw = own.groupBy(F.col("l_orderkey").cast("long").alias("block_number")).agg(F.collect_list(tx).alias("transactions")).withColumns({"fetched_at": F.lit("x"), "receipts": F.array().cast("array<struct<transactionHash: string, status: string, gasUsed: string>>")})
    flat, raw = materialise(flat, "flat-documents"), materialise(raw, "raw-blocks")
    size = heads.count() // 4 + 1
    store = transform.transform_store(spark, fresh_path(spark, "transform"), 16)
    transform.transform(store, heads, flat, raw, size, most=2)
    transform.transform(store, heads, flat, raw, size)
    return store.read("rows").select("block_number", "tx_hash", "from_address", "to_address", "value_eth", "derived")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def stale_anti(spark, sf_dir):
    """Parts that no large order holds."""
    large = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(large, "p_partkey", "left_anti").select("p_partkey")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), 'bridge|bridging|portal|router|wormhole|stargate|across|hop') THEN 'bridge' END,
 CASE WHEN regexp_matches(lower(text), 'exchange|binance|coinbase|kraken|okx|bybit|kucoin|gate|bitfinex|huobi') THEN 'exchange' END, CASE WHEN regexp_matches(lower(text), 'mixer|mixing|tornado|privacy|anonymity|shielded|stealth') THEN 'mixer' END) AS categories FROM documents""")
def keyword_categories(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.keyword_categories(F.col("text")), ",").alias("categories"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pay to 0x' || substr(sha1(text), 1, 40) || ', or 0x' || upper(substr(sha1(text), 1, 40)) || '; not 0x12' WHEN 1 THEN text WHEN 2 THEN 'x0x' || sha1(text) || ' 0x' || sha1(text) || 'f' ELSE '0x' || sha1(source) || ' 0X' || sha1(text) || ' 0x' || sha1(lang) END AS t FROM documents),
 m AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?:^|[^0-9A-Za-z_])(0x[0-9a-fA-F]{40})(?:$|[^0-9A-Za-z_])', 1), lambda x: lower(x)) AS a FROM (SELECT doc_id, replace(t, ' ', '  ') AS t FROM t))
SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS addresses FROM m""")
def address_extract(spark, sf_dir):
    """Whole addresses in texts that hold them once, twice, in either case, glued to others or not at all."""
    h = F.sha1("text")
    k = F.col("doc_id") % 4
    made = F.when(k == 0, F.concat(F.lit("pay to 0x"), h, F.lit(", or 0x"), F.upper(h), F.lit("; not 0x12"))).when(k == 1, F.col("text")).when(k == 2, F.concat(F.lit("x0x"), h, F.lit(" 0x"), h, F.lit("f")))
    made = made.otherwise(F.concat(F.lit("0x"), F.sha1("source"), F.lit(" 0X"), h, F.lit(" 0x"), F.sha1("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.addresses_in(made), ",").alias("addresses"))


@query("SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))


_ASCII_SQL = "text"
for _a, _b in S.ASCII.items():
    _ASCII_SQL = f"replace({_ASCII_SQL}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents({_ASCII_SQL}), '[^\\x00-\\x7f]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS ascii FROM documents")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.ascii_text(F.col("text")).alias("ascii"))


@query(f"WITH {MEMBERS} SELECT entity, 'C-' || upper(substr(sha1(array_to_string(list_sort(list(address)), '|')), 1, 12)) AS cluster_id FROM members GROUP BY 1")
def ids_sha1(spark, sf_dir):
    return members(spark, sf_dir).groupBy("entity").agg(S.stable_id("C-", F.collect_set("address")).alias("cluster_id"))


@query(f"WITH {HV} SELECT count(*) AS n, max(block_number) AS last_block FROM hv")
def graph_totals(spark, sf_dir):
    return purchase_transfers(spark, sf_dir).agg(F.count("*").alias("n"), F.max("block_number").alias("last_block"))
