"""Queries over what is written out and read in again: exports, documents by time, lists of flagged addresses, loads of the graph, wallets on several chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import scalar as S
from tracewell.operators import etl
from tracewell.operators import wallet as W
from tracewell.operators.graph import graph_tables
from tracewell.plans.base import query, table
from tracewell.schema import FLAT_DOC
from tracewell.sources import feeds, loads
from tracewell.sources.storage import fresh_path
from tracewell.sources.transfers import EV, TR, event_transfers, trade_transfers

_EXPORT = """x AS (SELECT CASE WHEN event_type = 'signup' THEN ' ' ELSE 'H' || user_id || '-' || CAST(floor(value) AS BIGINT) END AS tx_hash, event_id, ts, user_id, value, event_type FROM events)"""


def _export(spark, sf_dir) -> str:
    """Events as an export: sign-ups have a blank hash, a user's events of one amount share theirs, amounts have exponents, views no time that can be read."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.when(F.col("event_type") == "signup", " ").otherwise(F.concat(F.lit("H"), "user_id", F.lit("-"), F.floor("value"))).alias("tx_hash"), F.col("event_id").alias("block_number"),
        F.when(F.col("event_type") == "view", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), F.concat(F.lit("U"), "user_id").alias("from_address"), F.lit("U0").alias("to_address"),
        F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("e-3")).alias("value_eth"), F.when(F.col("event_type") == "click", "1").otherwise("no").alias("is_contract_call"), F.lit("21000").alias("gas_used"), F.lit("1").alias("status"),
    )
    path = fresh_path(spark, "export")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(f"""WITH {_EXPORT} SELECT tx_hash, event_id AS block_number, CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at, ((CAST(value AS DECIMAL(18,2)) * CAST('0.001' AS DECIMAL(4,3)))::DECIMAL(38,18))::VARCHAR AS value_eth, (event_type = 'click')::INT AS called
 FROM x WHERE trim(tx_hash) <> '' QUALIFY row_number() OVER (PARTITION BY tx_hash ORDER BY event_id DESC) = 1""")
def prepared_rows(spark, sf_dir):
    """Rows of an export as they are loaded, the last of each hash by block."""
    ready, _ = loads.prepare_rows(loads.read_export(spark, _export(spark, sf_dir)).withColumn("block", F.col("block_number").cast("long")), ["block"])
    return ready.select("tx_hash", "block_number", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "value_eth", F.col("is_contract_call").alias("called"))


@query(f"WITH {_EXPORT} SELECT count(*) AS rows, count(CASE WHEN trim(tx_hash) = '' THEN 1 END) AS blank, count(CASE WHEN trim(tx_hash) <> '' THEN 1 END) - count(DISTINCT CASE WHEN trim(tx_hash) <> '' THEN tx_hash END) AS repeated, count(DISTINCT CASE WHEN trim(tx_hash) <> '' THEN tx_hash END) AS kept FROM x")
def prepared_counts(spark, sf_dir):
    """How many rows of the export were blank, repeated and kept."""
    return loads.prepare_rows(loads.read_export(spark, _export(spark, sf_dir)))[1]


@query("SELECT 'E' || event_id AS tx_hash, event_id AS number FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def since_scan(spark, sf_dir):
    """Events as documents of blocks, those after a time written as lines of JSON and read back."""
    docs = table(spark, sf_dir, "events").select(F.concat(F.lit("E"), "event_id").alias("tx_hash"), F.struct(F.col("event_id").cast("long").alias("number"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")).alias("block"), F.struct(F.lit(0).alias("transaction_index")).alias("forensics"))
    path = fresh_path(spark, "since")
    loads.write_lines(loads.scan_since(docs, "2024-01-20 00:00:00"), path)
    return spark.read.schema(FLAT_DOC).json(path).select("tx_hash", "block.number")


@query(f"WITH {EV}, s AS (SELECT * FROM ev WHERE ts < epoch(TIMESTAMP '2024-01-16 00:00:00')), k AS (SELECT max(block_number) AS mark, count(*) AS held FROM s) SELECT count(CASE WHEN block_number > mark THEN 1 END) AS synced, count(CASE WHEN block_number <= mark THEN 1 END) AS already, max(held) + count(CASE WHEN block_number > mark THEN 1 END) AS total FROM ev, k")
def sync_report(spark, sf_dir):
    """What a load of the graph adds to one that holds the first half of the month."""
    rows = event_transfers(spark, sf_dir)
    return etl.sync_report(rows, rows.where(F.col("ts") < F.expr("timestamp'2024-01-16 00:00:00'").cast("double")))


_LAST = "g AS (SELECT 'U' || a.user_id AS f, 'U' || b.user_id AS t, 'H' || floor(a.value)::BIGINT AS h, a.event_id, a.value AS v FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1)"


@query(f"""WITH {_LAST}, e AS (SELECT * FROM g WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f, t, h ORDER BY event_id DESC) = 1)
SELECT 'edge' AS part, f AS a, t AS b, h AS tx_hash, v AS value, event_id AS n FROM e UNION ALL SELECT 'node', x, NULL, NULL, NULL, NULL FROM (SELECT f AS x FROM e UNION SELECT t FROM e) UNION ALL SELECT 'loaded', NULL, NULL, NULL, NULL, count(t) FROM g UNION ALL SELECT 'skipped', NULL, NULL, NULL, NULL, count(*) - count(t) FROM g""")
def graph_load(spark, sf_dir):
    """Nodes and edges of the events for a graph store; hashes repeat, so later transfers take the place of earlier ones, and the last event has no target."""
    e = table(spark, sf_dir, "events")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.concat(F.lit("U"), "user_id").alias("to_address"))
    rows = e.join(after, "event_id", "left").select(F.concat(F.lit("U"), "user_id").alias("from_address"), "to_address", F.concat(F.lit("H"), F.floor("value")).alias("tx_hash"), "value", F.col("event_id").alias("block_number"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.lit(False).alias("is_contract_call"))
    nodes, edges, counts = graph_tables(rows)
    none = lambda kind: F.lit(None).cast(kind)
    out = edges.select(F.lit("edge").alias("part"), F.col("from_address").alias("a"), F.col("to_address").alias("b"), "tx_hash", "value", F.col("block_number").alias("n"))
    out = out.unionByName(nodes.select(F.lit("node").alias("part"), F.col("address").alias("a"), none("string").alias("b"), none("string").alias("tx_hash"), none("double").alias("value"), none("long").alias("n")))
    return out.unionByName(counts.unpivot([], ["loaded", "skipped"], "part", "n").select("part", none("string").alias("a"), none("string").alias("b"), none("string").alias("tx_hash"), none("double").alias("value"), "n"))


@query(r"""WITH s AS (SELECT source, unnest(list_distinct(list_concat(regexp_extract_all(text, '(0x[a-fA-F0-9]{40})', 1), regexp_extract_all(text, '\b((?:bc1|[13])[a-zA-HJ-NP-Z0-9]{20,90})\b', 1)))) AS address FROM documents WHERE lang IS NOT NULL)
SELECT CASE WHEN starts_with(address, '0x') THEN 'ethereum' WHEN regexp_matches(address, '^(bc1|1|3)') THEN 'bitcoin' ELSE 'global' END AS chain, address, 'sanctioned' AS category, 'OFAC' AS source, 95 AS score, coalesce(source, 'Unknown') AS label FROM s
UNION ALL SELECT CASE WHEN s_acctbal < 0 THEN 'global' ELSE 'ethereum' END, 'U' || s_suppkey, 'ransomware', s_name, 98, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'bitcoin', 'U' || c_custkey, 'reported_ransomware', c_name, CASE WHEN c_acctbal < 0 THEN 60 ELSE 75 END, NULL FROM customer""")
def flagged_feed(spark, sf_dir):
    """One table of flagged addresses: documents as a sanction list's remarks, suppliers as listed and customers as reported addresses."""
    path = fresh_path(spark, "sanctions")
    d = table(spark, sf_dir, "documents")
    blank = [F.lit(None).cast("string").alias(f"b{k}") for k in range(8)]
    d.select("doc_id", "source", blank[0], "lang", *blank[1:], "text", F.lit("see list").alias("more")).write.option("escape", '"').csv(path)
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    listed = s.select(F.when(F.col("s_acctbal") >= 0, "ethereum").alias("chain"), F.concat(F.lit("U"), "s_suppkey").alias("address"), F.lit("ransomware").alias("category"), F.col("s_name").alias("source"), F.lit(98).alias("score"), F.col("n_name").alias("label"))
    reports = table(spark, sf_dir, "customer").select(F.concat(F.lit("U"), "c_custkey").alias("address"), F.lit("reported_ransomware").alias("category"), F.col("c_name").alias("source"), F.when(F.col("c_acctbal") >= 0, 0.75).alias("confidence"))
    return feeds.flagged_table(feeds.read_sanctions(spark, path), listed, reports)


_SUMS = "count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value)::DOUBLE AS most FROM"


@query(f"WITH {EV}, {TR} SELECT 'events' AS chain, from_address AS wallet, {_SUMS} ev GROUP BY 2 UNION ALL SELECT 'trade', from_address, {_SUMS} tr GROUP BY 2")
def chain_scan(spark, sf_dir):
    """What wallets send on two chains; a third has no table and is left out."""
    scan = lambda t: t.groupBy(F.col("from_address").alias("wallet")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.max("value").cast("double").alias("most"))
    chains = {"events": lambda: event_transfers(spark, sf_dir), "none": lambda: spark.read.parquet(f"{sf_dir}/no-such-chain.parquet"), "trade": lambda: trade_transfers(spark, sf_dir)}
    return W.scan_chains(chains, scan)[0]


_SIDES = "tx AS (SELECT from_address AS wallet, tx_hash, 'out' AS d, value, ts, method_id FROM ev UNION ALL SELECT to_address, tx_hash, 'in', value, ts, method_id FROM ev WHERE from_address <> to_address)"


def _sides(spark, sf_dir):
    ev = event_transfers(spark, sf_dir)
    return ev.withColumn("wallet", F.col("from_address")).unionByName(ev.where("from_address <> to_address").withColumn("wallet", F.col("to_address")))


@query(f"""WITH {EV}, {_SIDES}, r AS (SELECT wallet, array_to_string(list(tx_hash ORDER BY ts DESC, tx_hash), ',') AS newest FROM (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, tx_hash) <= 10) GROUP BY 1)
SELECT wallet, count(CASE WHEN d = 'out' THEN 1 END) AS n_sent, count(CASE WHEN d = 'in' THEN 1 END) AS n_received, CAST(coalesce(sum(CASE WHEN d = 'out' THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS sent, CAST(coalesce(sum(CASE WHEN d = 'in' THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS received, min(ts) AS first_ts, max(ts) AS last_ts, any_value(newest) AS newest FROM tx JOIN r USING (wallet) GROUP BY 1""")
def explorer_summary(spark, sf_dir):
    """Each wallet's sums and its ten newest transfers."""
    return W.explorer_summary(_sides(spark, sf_dir)).withColumn("newest", F.array_join("newest", ","))


@query(f"WITH {EV}, {_SIDES} SELECT wallet, CASE method_id WHEN 'click' THEN 'approval' WHEN 'view' THEN 'swap' ELSE CASE d WHEN 'out' THEN 'send' ELSE 'receive' END END AS label, count(*) AS n FROM tx GROUP BY 1, 2")
def wallet_labels(spark, sf_dir):
    """How often each wallet sends, receives, swaps and approves: views are swaps, clicks approvals."""
    return W.labelled(_sides(spark, sf_dir), {"view": "swap", "click": "approval"}).groupBy("wallet", "label").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE ts END AS ts, CAST(value AS DECIMAL(18,2)) AS v, sha1(CAST(event_id AS VARCHAR)) AS h, event_type FROM events)
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at, regexp_replace(regexp_replace(v::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS amount, CASE WHEN event_type = 'view' THEN 'tron' WHEN event_type = 'click' THEN 'polygon' ELSE 'ethereum' END AS chain FROM t""".replace("\\\\", "\\"))
def event_texts(spark, sf_dir):
    """Times, amounts and the chain to look an address up on, as pages show them: views have no EVM address and stay on their chain."""
    e = table(spark, sf_dir, "events")
    ts = F.when(F.col("event_type") != "signup", F.col("ts").cast("timestamp").cast("double")).otherwise(0.0)
    address = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.concat(F.lit(" 0x"), F.sha1(F.col("event_id").cast("string"))))
    current = F.when(F.col("event_type") == "click", "polygon").otherwise("tron")
    return e.select("event_id", S.iso_time(ts).alias("at"), S.plain_amount(F.col("value").cast("decimal(38,18)").cast("decimal(20,2)")).alias("amount"), S.detect_chain(address, current).alias("chain"))
