"""Incremental clusters and run sets against full runs."""

import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tracewell.config import EngineConfig
from tracewell.operators import clustering as C
from tracewell.sources.tables import RunStore

PAIRS = "a string, b string"


def test_clusters_follow_each_batch(spark):
    """After each batch the store holds what a run over all pairs so far gives; a batch delivered again changes nothing."""
    rng = random.Random(4)
    store = C.cluster_store(spark, tempfile.mkdtemp(), buckets=16)
    name = lambda i: f"n{i:03d}"
    batches = [[(name(rng.randrange(120)), name(rng.randrange(120))) for _ in range(25)] for _ in range(3)]
    batches += [[("n000", "zz"), ("zz", "n050"), ("q", "q")], [("n001", None)]]
    cfg, so_far = EngineConfig(), []
    for number, batch in enumerate(batches):
        so_far += batch
        for _ in range(2 if number == 1 else 1):
            C.update_clusters(store, number, spark.createDataFrame(batch, PAIRS))
        full = C.build_clusters(spark.createDataFrame(so_far, PAIRS), cfg)
        assert sorted(map(tuple, C.stored_clusters(store, cfg).collect())) == sorted(map(tuple, full.collect()))


def test_a_batch_reads_its_own_buckets(spark, monkeypatch):
    store = C.cluster_store(spark, tempfile.mkdtemp(), buckets=64)
    C.update_clusters(store, 0, spark.createDataFrame([(f"p{i}", f"q{i}") for i in range(500)], PAIRS))
    asked = []
    read = type(store).read
    monkeypatch.setattr(type(store), "read", lambda self, name, only=None: (asked.append(only), read(self, name, only))[1])
    changed = C.update_clusters(store, 1, spark.createDataFrame([("p1", "q2"), ("new", "p7")], PAIRS)).collect()
    assert sorted(r["size"] for r in changed) == [3, 4]
    assert asked and all(only is not None and len(only) <= 8 for only in asked)


def test_runs_show_once_they_are_whole(spark):
    store = RunStore(spark, tempfile.mkdtemp())
    assert store.runs().count() == 0
    day = lambda d: datetime.datetime(2024, 1, d)
    table = lambda *rows: spark.createDataFrame(rows, "entity string, score double")
    store.save("R1", day(1), {"placements": table(("a", 0.5), ("b", 0.6)), "behaviors": table(("a", 0.1))})
    store.save("R2", day(2), {"placements": table(("a", 0.7)), "behaviors": table(("a", 0.2), ("c", 0.3))})
    broken = table(("a", 1.0)).select("entity", F.raise_error(F.lit("lost")).cast("double").alias("score"))
    with pytest.raises(Exception, match="lost"):
        store.save("R3", day(3), {"placements": table(("z", 0.9)), "behaviors": broken})
    assert {r.run_id for r in store.runs().collect()} == {"R1", "R2"}
    assert {(r.run_id, r.entity) for r in store.read("placements").collect()} == {("R1", "a"), ("R1", "b"), ("R2", "a")}
    assert {r.entity for r in store.read("placements", store.latest()).collect()} == {"a"}
    assert store.latest(day(1)).first().run_id == "R1"
    both = store.read("placements").join(store.read("behaviors").withColumnRenamed("score", "own"), ["run_id", "entity"])
    assert {tuple(r) for r in both.collect()} == {("R1", "a", 0.5, 0.1), ("R2", "a", 0.7, 0.2)}
    # a run that fails on its second try is gone; written again, it replaces its own rows only
    with pytest.raises(Exception, match="lost"):
        store.save("R2", day(2), {"placements": table(("y", 0.1)), "behaviors": broken})
    assert {r.run_id for r in store.runs().collect()} == {"R1"}
    store.save("R2", day(4), {"placements": table(("y", 0.1)), "behaviors": table()})
    assert {(r.run_id, r.entity) for r in store.read("placements").collect()} == {("R1", "a"), ("R1", "b"), ("R2", "y")}
    assert {r.run_id: r.counts for r in store.runs().collect()}["R2"] == {"placements": 1, "behaviors": 0}
