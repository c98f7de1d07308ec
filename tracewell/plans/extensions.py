"""Queries over stores and sources of the library's own: clusters kept between batches, services, the block source, run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.config import EngineConfig
from tracewell.functions.scalar import is_banned
from tracewell.operators import clustering as C
from tracewell.operators import relational as R
from tracewell.operators import reports as A
from tracewell.operators import services as V
from tracewell.plans.base import query, table
from tracewell.sources import blocks
from tracewell.sources.storage import fresh_path
from tracewell.sources.transfers import EV, HV, event_transfers, purchase_transfers


@query(f"""WITH RECURSIVE {HV}, near AS (SELECT from_address AS u, to_address AS v FROM hv UNION SELECT to_address, from_address FROM hv), reach AS (SELECT DISTINCT u, u AS v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u),
 roots AS (SELECT u AS address, min(v) AS root, count(*) AS size FROM reach GROUP BY 1)
SELECT address, 'C-' || upper(substr(sha1(array_to_string(list_sort(list(address) OVER (PARTITION BY root)), '|')), 1, 12)) AS cluster_id, size FROM roots""")
def incremental_clusters(spark, sf_dir):
    """Clusters of who pays whom, kept over three batches of transfers."""
    store = C.cluster_store(spark, fresh_path(spark, "clusters"), 16)
    pairs = purchase_transfers(spark, sf_dir).select("block_number", F.col("from_address").alias("a"), F.col("to_address").alias("b"))
    for k in range(3):
        C.update_clusters(store, k, pairs.where(F.col("block_number") % 3 == k))
    return C.stored_clusters(store, EngineConfig())


@query("""WITH o AS (SELECT lower('U' || s_suppkey) AS address, lower(s_name || ' ' || coalesce(text, '')) AS t FROM supplier LEFT JOIN documents ON doc_id = s_suppkey),
 hit AS (SELECT address, 'mixer' AS category FROM o WHERE regexp_matches(t, 'mixer|mixing|tornado|privacy|anonymity|shielded|stealth') UNION ALL SELECT address, 'bridge' FROM o WHERE regexp_matches(t, 'bridge|bridging|portal|router|wormhole|stargate|across|hop')
  UNION ALL SELECT address, 'exchange' FROM o WHERE regexp_matches(t, 'exchange|binance|coinbase|kraken|okx|bybit|kucoin|gate|bitfinex|huobi') UNION ALL SELECT address, 'vault' FROM o WHERE contains(t, 'supplier#000000007') UNION ALL SELECT 'u0', 'mixer')
SELECT DISTINCT address, category FROM hit WHERE address <> 'u3' UNION SELECT 'u3', 'exchange'""")
def service_registry(spark, sf_dir):
    """Services among suppliers, by their names and the documents of their numbers, with a profile and one override."""
    profile = spark.createDataFrame([({"mixer": [" U0 "]}, {"bridge": ["signup"]}, {"vault": ["SUPPLIER#000000007"]})], V.PROFILE)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("s_suppkey"), F.col("text").alias("notes"))
    owners = table(spark, sf_dir, "supplier").join(docs, "s_suppkey", "left").select(F.concat(F.lit("U"), "s_suppkey").alias("address"), F.col("s_name").alias("full_name"), "notes")
    return V.service_registry(profile, owners, spark.createDataFrame([("U3", "exchange")], "address string, category string"))[0]


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id >= 100 AND event_id < 700 AND value > 10")
def block_source(spark, sf_dir):
    """Events through the Python source, as blocks of their numbers, with the range taken over by its reader."""
    blocks.register(spark)
    own = spark.read.format("blocks").option("block", "event_id").option("per_partition", 20_000).load(f"{sf_dir}/events.parquet")
    return own.where("event_id >= 100 and event_id < 700 and value > 10").select("event_id", "user_id", "event_type", "value")


@query(f"""WITH {EV} SELECT address, role, count(*) AS n, count(DISTINCT CASE WHEN peer <> address THEN peer END) AS peers, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS most
 FROM (SELECT from_address AS address, to_address AS peer, 'out' AS role, value FROM ev UNION ALL SELECT to_address, from_address, 'in', value FROM ev) GROUP BY 1, 2""")
def client_wallet_sides(spark, sf_dir):
    """What each wallet sends and what it receives."""
    own = R.role_union(event_transfers(spark, sf_dir))
    other = F.when(F.col("peer") != F.col("address"), F.col("peer"))
    return own.groupBy("address", "role").agg(F.count("*").alias("n"), F.countDistinct(other).alias("peers"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.max("value").alias("most"))


@query("""SELECT array_to_string(list(k || '=' || n ORDER BY k), ',') AS counts FROM (SELECT event_type AS k, count(*) AS n FROM (SELECT CASE WHEN event_type = 'signup' THEN ' Funneling' ELSE event_type END AS event_type FROM events)
 WHERE lower(trim(event_type)) NOT IN ('funneling', 'funnel', 'immediate_utilization', 'immediate-utilization', 'immediate utilization') GROUP BY 1)""")
def run_summary_counts(spark, sf_dir):
    """A run's counts by behaviour, without those that reports leave out: event types as behaviours, sign-ups as a banned one."""
    named = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "signup", " Funneling").otherwise(F.col("event_type")).alias("behavior"))
    counts = A.run_counts(named.where(~is_banned(F.col("behavior"))), "behavior")
    return counts.select(F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("counts"))
