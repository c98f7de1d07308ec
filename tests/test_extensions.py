"""Processors with state and the Python data source, against batch queries and plain readers."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import risk as K
from tracewell.plans import detection as D
from tracewell.schema import TRANSFERS
from tracewell.sources import blocks
from tracewell.streaming import jobs, stateful

SF = "/root/testdata/sf0.001"


def run(stream, top, name):
    """What is new, into a table of files; progress stays in a checkpoint, so each call is a restart."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{top}/ck-{name}").option("path", f"{top}/out-{name}").trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("cuts", [[1000], [137, 600, 601, 1000]])
def test_watchlist_state_equals_the_batch_query(spark, cuts):
    top = tempfile.mkdtemp()
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").cast("double").alias("ts"))
    order = {r.event_id: k for k, r in enumerate(sorted(events.collect(), key=lambda r: (r.ts, r.event_id)))}
    place = spark.createDataFrame(sorted(order.items()), "event_id long, place long")
    txs = D.event_transfers(spark, SF).join(place.withColumnRenamed("event_id", "block_number"), "block_number")
    own = D.watch_entries(spark, SF).join(events.join(place, "event_id").groupBy(F.col("ts").alias("added_at")).agg(F.min("place").alias("place")), "added_at")
    kind = "address string, added_at double, expires_at double"
    at = 0
    for end in cuts:
        inside = (F.col("place") >= at) & (F.col("place") < end)
        txs.where(inside).select(*TRANSFERS.names).coalesce(1).write.mode("append").parquet(f"{top}/tx")
        own.where(inside).select("address", "added_at", "expires_at").coalesce(1).write.mode("append").parquet(f"{top}/watch")
        at = end
        run(stateful.screened_by_state(jobs.read_transfers(spark, f"{top}/tx"), spark.readStream.schema(kind).parquet(f"{top}/watch")), top, "watch")
    got = sorted(map(tuple, spark.read.parquet(f"{top}/out-watch").select("tx_hash", "address", "side").collect()))
    want = sorted(map(tuple, K.screen_over_time(D.event_transfers(spark, SF), D.watch_entries(spark, SF)).collect()))
    assert got == want and len(want) > 20


def test_watchlist_state_that_ends_by_the_clock(spark):
    """An entry kept for a tenth of a second is gone when the next batch comes; one kept for a day is there."""
    kind, found = "address string, added_at double, expires_at double", {}
    for days in (1e-6, 1.0):
        top = tempfile.mkdtemp()
        row = lambda i: spark.createDataFrame([(f"t{i}", i, 10.0 * i, "a", "b", 1.0, False, "")], TRANSFERS).coalesce(1)
        row(1).write.mode("append").parquet(f"{top}/tx")
        spark.createDataFrame([("a", 5.0, 1e9)], kind).coalesce(1).write.parquet(f"{top}/watch")
        stream = stateful.screened_by_state(jobs.read_transfers(spark, f"{top}/tx"), spark.readStream.schema(kind).parquet(f"{top}/watch"), days)
        out = stream.writeStream.format("memory").queryName(f"kept{days > 0.1}").outputMode("append").option("checkpointLocation", f"{top}/ck").start()
        seen = lambda: {r.tx_hash for r in spark.table(f"kept{days > 0.1}").collect()}  # noqa: B023, E731
        until = time.time() + 60
        while "t1" not in seen() and time.time() < until:
            time.sleep(0.5)
        time.sleep(1)
        row(2).write.mode("append").parquet(f"{top}/tx")
        while "t2" not in seen() and time.time() < until and not (days < 0.1 and time.time() > until - 45):
            time.sleep(0.5)
        out.stop()
        found[days] = seen()
    assert found == {1e-6: {"t1"}, 1.0: {"t1", "t2"}}


@pytest.mark.parametrize("cuts", [[2000], [100, 101, 650, 2000]])
def test_poi_state_equals_the_batch_query(spark, cuts):
    top, at = tempfile.mkdtemp(), 0
    scores = D.poi_scores(spark, SF)
    for end in cuts:
        scores.where((F.col("at") >= at) & (F.col("at") < end)).coalesce(1).write.mode("append").parquet(f"{top}/in")
        at = end
        run(stateful.poi_by_state(spark.readStream.schema(scores.schema).parquet(f"{top}/in")), top, "poi")
    got = sorted(map(tuple, spark.read.parquet(f"{top}/out-poi").select("entity", "at", "risk", "is_poi").collect()))
    want = sorted(map(tuple, K.poi_history(scores).collect()))
    assert got == want and len({r[3] for r in want}) == 2


def test_block_reader(spark):
    blocks.register(spark)
    top = tempfile.mkdtemp()
    rows = [(f"t{i}", i // 3, float(i), "a", "b", 1.5 * i, i % 2 == 0, None) for i in range(300)]
    plain = spark.createDataFrame(rows, TRANSFERS)
    plain.repartitionByRange(4, "block_number").write.parquet(f"{top}/in")
    own = spark.read.format("blocks").option("per_partition", 7).load(f"{top}/in")
    assert own.schema.names == TRANSFERS.names and own.rdd.getNumPartitions() == 15
    assert sorted(own.collect()) == sorted(plain.collect())
    for rule in ("block_number >= 20 and block_number < 31", "block_number = 40 and value > 100", "block_number > 98 and from_address = 'a'", "block_number > 500", "20 < block_number and tx_hash like 't6%'"):
        assert sorted(own.where(rule).collect()) == sorted(plain.where(rule).collect())
    assert own.where("block_number >= 20 and block_number < 31").rdd.getNumPartitions() == 2
    spark.createDataFrame([], TRANSFERS).write.parquet(f"{top}/none")
    assert spark.read.format("blocks").load(f"{top}/none").count() == 0


def test_block_stream_resumes(spark):
    blocks.register(spark)
    top, made = tempfile.mkdtemp(), 0
    for n in (10, 0, 25):
        rows = [(f"t{i}", i, float(i), "a", "b", 1.0, False, "") for i in range(made, made + n)]
        made += n
        spark.createDataFrame(rows, TRANSFERS).coalesce(1).write.mode("append").parquet(f"{top}/in")
        run(spark.readStream.format("blocks").option("per_partition", 4).load(f"{top}/in"), top, "blocks")
        assert sorted(r.block_number for r in spark.read.parquet(f"{top}/out-blocks").collect()) == list(range(made))
