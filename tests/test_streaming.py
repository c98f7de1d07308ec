import os
import tempfile

from tracewell.schema import TRANSFERS
from tracewell.sources.transfers import CsvTransfers, FirstAvailable, ParquetTransfers
from tracewell.streaming import jobs


def test_micro_batches_take_what_is_new_once(spark):
    top = tempfile.mkdtemp()
    row = lambda i: (f"t{i}", i, 1000.0 * i, "A ", "b", 1.5, False, "")
    seen = []
    for i in range(2):
        spark.createDataFrame([row(i)], TRANSFERS).write.mode("append").parquet(f"{top}/in")
        jobs.run_batches(jobs.read_transfers(spark, f"{top}/in"), lambda df, _: seen.extend(r.tx_hash for r in df.collect()), f"{top}/ck").awaitTermination()
    assert seen == ["t0", "t1"]
    assert {r.from_address for r in ParquetTransfers(f"{top}/in").load(spark).collect()} == {"a"}


def test_windowed_rollup(spark):
    top = tempfile.mkdtemp()
    spark.createDataFrame([("t", 1, 3600.0, "a", "b", 2.0, False, ""), ("t", 1, 3600.0, "a", "b", 2.0, False, "")], TRANSFERS).write.parquet(f"{top}/in")
    stream = jobs.windowed_rollup(jobs.read_transfers(spark, f"{top}/in"))
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.address, r.n, r.total) for r in spark.table("rolled").collect()} == {("a", 2, 4.0), ("b", 2, 4.0)}


def test_first_source_with_rows(spark):
    top = tempfile.mkdtemp()
    spark.createDataFrame([], TRANSFERS).write.parquet(f"{top}/none")
    with open(f"{top}/flat.csv", "w") as f:
        f.write("tx_hash,block_number,timestamp,from_address,to_address,value_eth,is_contract_call,gas_used,status\nx,1,1970-01-01T00:01:00Z,A,,1.5,,21000,1\n")
    r = FirstAvailable(ParquetTransfers(f"{top}/none"), CsvTransfers(f"{top}/flat.csv")).load(spark).first()
    assert (r.from_address, r.to_address, r.ts, r.value) == ("a", None, 60.0, 1.5)


def _feed(spark, rows):
    top = tempfile.mkdtemp()
    spark.createDataFrame(rows, TRANSFERS).coalesce(1).write.parquet(f"{top}/in")
    return top, jobs.read_transfers(spark, f"{top}/in")


def _shown(stream, name):
    stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_a_transfer_delivered_again_counts_once(spark):
    row = ("t1", 1, 1000.0, "a", "b", 1.5, False, "")
    _, stream = _feed(spark, [row, row, ("t2", 2, 1001.0, "a", "b", 1.5, False, "")])
    assert sorted(r.tx_hash for r in _shown(jobs.unique_transfers(stream), "unique_ones")) == ["t1", "t2"]


def test_screened_stream(spark):
    _, stream = _feed(spark, [("t1", 1, 1000.0, "a", "b", 1.5, False, ""), ("t2", 2, 1001.0, "c", "a", 1.5, False, ""), ("t3", 3, 1001.0, "old", "c", 1.5, False, "")])
    watch = spark.createDataFrame([("a", 5000.0), ("old", 10.0)], "address string, expires_at double")
    assert {tuple(r) for r in _shown(jobs.screened(stream, watch, 2000.0), "alerts")} == {("t1", "a", "from"), ("t2", "a", "to")}


def test_keyed_table_takes_a_batch_again(spark):
    path = tempfile.mkdtemp()
    handle = jobs.keyed_table(path, ["k"], ["n"], buckets=8)
    make = lambda rows: spark.createDataFrame(rows, "k string, n long")
    store = jobs.keyed_store(spark, path, make([]).schema, ["k"], 8)
    assert store.read("rows").count() == 0
    handle(make([("a", 1), ("b", 5)]), 0)
    for _ in range(2):
        handle(make([("a", 2), ("b", 3), ("c", 1)]), 1)
    assert {tuple(r) for r in store.read("rows").collect()} == {("a", 2), ("b", 5), ("c", 1)}
    for number in (2, 3, 4):
        handle(make([("d", number)]), number)
    assert {tuple(r) for r in store.read("rows").collect()} == {("a", 2), ("b", 5), ("c", 1), ("d", 4)}
    # buckets without a key of the batch are those of the commit that wrote them, and older versions of the others are gone
    of = {k: store.touched("rows", make([(k, 0)]))[0] for k in "ad"}
    held = store.last()[1]["rows"]
    assert held[str(of["d"])] == 4 and (of["a"] == of["d"] or held[str(of["a"])] == 1)
    assert not os.path.exists(f"{path}/rows/commit=2/bucket={of['d']}")


def test_what_a_failed_commit_wrote_is_not_seen(spark):
    path = tempfile.mkdtemp()
    make = lambda rows: spark.createDataFrame(rows, "k string, n long")
    store = jobs.keyed_store(spark, path, make([]).schema, ["k"], 4)
    jobs.keyed_table(path, ["k"], ["n"], 4)(make([("a", 1)]), 0)
    make([("a", 9)]).withColumn("bucket", store.bucket("rows")).write.partitionBy("bucket").parquet(f"{path}/rows/commit=1")
    assert [tuple(r) for r in store.read("rows").collect()] == [("a", 1)]
    jobs.keyed_table(path, ["k"], ["n"], 4)(make([("a", 2)]), 1)
    assert [tuple(r) for r in store.read("rows").collect()] == [("a", 2)]
