"""Entity resolution, run tables, owner lists, texts and paths, by hand."""

import datetime
import hashlib
import random
import tempfile

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F
from test_detectors import edges

from tracewell.config import EngineConfig
from tracewell.functions import scalar as S
from tracewell.operators import placement, strong
from tracewell.operators import reports as A
from tracewell.operators.strong import strongly_connected
from tracewell.sources.storage import materialise


def test_strong_components_match_brute_force(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)} | {(100 + i, 101 + i) for i in range(12)} | {(112, 105)}
    reach = {x: {x} for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in reach}
    want = {x: c for x, c in want.items() if sum(v == c for v in want.values()) > 1}
    for one_task in (0, 100_000):
        got = strongly_connected(spark.createDataFrame(sorted(pairs), "a long, b long"), one_task=one_task)
        assert {r.node: r.component for r in got.collect()} == want and len(want) > 5
    odd = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "a"), ("b", None), ("c", "d"), ("d", "c"), ("d", "c")], "a string, b string")
    for one_task in (0, 100_000):
        assert {tuple(r) for r in strongly_connected(odd, one_task=one_task).collect()} == {("c", "c"), ("d", "c")}
        assert strongly_connected(odd.where("false"), one_task=one_task).count() == 0


@pytest.mark.parametrize("closed", [False, True])
def test_long_chains_and_rings_take_few_joins(spark, closed, monkeypatch):
    """10,000 nodes in any order: 15 steps of pointers, where a step an edge would take as many as nodes."""
    written = []
    monkeypatch.setattr(strong, "materialise", lambda df, name: (written.append(name), materialise(df, name))[1])
    order = random.Random(3).sample(range(10_000), 10_000)
    edges = list(zip(order, order[1:])) + [(order[-1], order[0])] * closed
    got = strongly_connected(spark.createDataFrame(edges, "a long, b long"), one_task=0)
    assert {tuple(r) for r in got.collect()} == ({(x, 0) for x in range(10_000)} if closed else set())
    assert written.count("up") <= 20


def test_entities(spark):
    # two known clusters with a flow both ways merge; one that nothing links stays; a lone address stays itself
    rows = [("a1", "a2", 1, 1), ("a2", "a1", 1, 2), ("b1", "c1", 1, 3), ("x", "y", 1, 4), ("y", "z", 1, 5), ("z", "x", 1, 6)]
    known = spark.createDataFrame([("a1", "C-ONE"), ("a2", "C-TWO"), ("b1", "C-B")], "address string, cluster_id string")
    links = spark.createDataFrame([("a1", "a2", "repeated_flow"), ("x", "y", "common_funder"), ("x", "y", "coordinated_cashout")], "a string, b string, name string")
    got = {r.address: r for r in placement.resolve_entities(edges(spark, rows), links, known, EngineConfig(min_heuristic_support=1)).collect()}
    assert got["a1"].entity == got["a2"].entity == "PCL-" + hashlib.sha1(b"a1|a2").hexdigest()[:12].upper()
    # signals: the pair's own and being strongly connected
    assert (got["a1"].source_kind, got["a1"].confidence) == ("enhanced", pytest.approx(0.72 + 0.02 + 0.08))
    assert (got["b1"].entity, got["b1"].source_kind, got["b1"].confidence) == ("C-B", "existing", 0.82)
    assert (got["c1"].entity, got["c1"].source_kind, got["c1"].entity_type, got["c1"].confidence) == ("c1", "address_fallback", "address", 0.48)
    assert got["a1"].signals == ["repeated_flow", "strong_connectivity"]
    # neither weak signals nor being strongly connected merge on their own
    assert {got[a].entity for a in "xyz"} == {"x", "y", "z"}


def test_enhanced_entity_is_a_suspicious_receiver_free_case(spark):
    rows = [(a, s, 1.0, t) for t, (a, s) in zip((10, 20, 30, 40), (("a1", "s1"), ("a2", "s1"), ("a1", "s2"), ("a2", "s2")), strict=True)]
    known = spark.createDataFrame([("a1", "C-ONE"), ("a2", "C-TWO"), ("s1", "C-A"), ("s2", "C-B")], "address string, cluster_id string")
    links = spark.createDataFrame([("a1", "a2", "behavioral_similarity"), ("a1", "a2", "fan_pattern")], "a string, b string, name string")
    got = {r.address: r for r in placement.resolve_entities(edges(spark, rows), links, known, EngineConfig(min_heuristic_support=2)).collect()}
    assert got["a1"].entity == got["a2"].entity and got["a1"].source_kind == "enhanced" and got["a1"].confidence >= 0.72


def test_run_tables(spark):
    path = tempfile.mkdtemp()
    make = lambda rows: spark.createDataFrame(rows, "entity string, score double")
    A.save_run(make([("a", 0.5)]), path, "R1")
    A.save_run(make([("b", 0.6)]), path, "R2")
    A.save_run(make([("a", 0.7), ("c", 0.1)]), path, "R1")
    assert {(r.entity, r.score) for r in A.read_run(spark, path, "R1").collect()} == {("a", 0.7), ("c", 0.1)}
    assert A.read_run(spark, path, "R2").count() == 1
    staging, processed = tempfile.mkdtemp(), tempfile.mkdtemp()
    for i in range(2):
        A.stage_rows(make([(f"e{i}", 1.0)]), staging, processed)
    assert [r.entity for r in spark.read.option("header", True).csv(staging).collect()] == ["e1"] and spark.read.option("header", True).csv(processed).count() == 2
    blocks = tempfile.mkdtemp()
    A.save_blocks(spark.createDataFrame([(7, "x"), (8, "y")], "block_number long, network string"), blocks)
    assert spark.read.json(blocks).where("block_number = 8").first().network == "y"


def test_ids_and_texts(spark):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    one = spark.createDataFrame([(at, "E", ["a", "b", "c"])], "at timestamp, e string, addresses array<string>")
    r = one.select(A.run_id("LYR", F.col("at")).alias("run"), A.evidence_id(F.col("e"), F.lit("mixing_interaction"), F.lit(2)).alias("evidence"), A.representative(F.col("e"), F.col("addresses")).alias("address")).first()
    assert r.run == "LYR-20240506070809-" + hashlib.sha1(b"2024-05-06T07:08:09+00:00").hexdigest()[:8].upper()
    assert r.evidence == "LEV-" + hashlib.sha1(b"E|mixing_interaction|2").hexdigest()[:12].upper()
    assert r.address == "abc"[int(hashlib.sha1(b"E").hexdigest()[:8], 16) % 3]
    hits = spark.createDataFrame([("e", "bridge_hopping", 0.7), ("e", "peeling_chain", 0.9), ("f", "own_method", 7.0), ("f", "mixing_interaction", 4.6)], "entity string, method string, score double")
    ranked = A.ranked_methods(hits)
    assert {(r.entity, r.primary, r.strong_second) for r in ranked.collect()} == {("e", "peeling_chain", True), ("f", "own_method", False)}
    behaviors = spark.createDataFrame([("e", "micro_funding", 2), ("e", "smurfing", 1), ("e", "structuring", 3)], "entity string, behavior string, rank int")
    text = {r.entity: r.text for r in A.narrative(ranked, behaviors, spark.createDataFrame([("e", 2)], "entity string, n int")).collect()}
    assert text["e"].endswith("already linked to smurfing, micro funding. 2 bridge-linked transfer pairs support the trace.") and "Cross-chain & bridge hopping also scores" in text["e"]
    assert text["f"] == "Own Method is the dominant layering signal for this entity."
    assert text["e"].startswith("Peeling chains dominate this entity, with value repeatedly shaved into smaller follow-on transfers. Cross-chain")
    reasons = spark.createDataFrame([("e", [" ", None, "PEELING chains dominate"]), ("f", ["A raw reason "]), ("g", ["", "only a reason"]), ("h", [])], "entity string, reasons array<string>")
    more = {r.entity: r.text for r in A.narrative(ranked, behaviors, spark.createDataFrame([("e", 1)], "entity string, n int"), reasons).collect()}
    assert more["e"].endswith("1 bridge-linked transfer pair supports the trace.") and more["g"] == "only a reason" and more["h"] is None
    assert more["f"] == "Own Method is the dominant layering signal for this entity. A raw reason"
    for method, begins in (("mixing_interaction", "Mixing and anonymity-tool"), ("bridge_hopping", "Cross-chain and bridge hopping is"), ("shell_wallet_network", "Shell wallet network behavior"), ("high_depth_transaction_chaining", "High-depth transaction chaining")):
        one = A.narrative(A.ranked_methods(spark.createDataFrame([("x", method, 0.9)], "entity string, method string, score double")), behaviors, spark.createDataFrame([], "entity string, n int"))
        assert one.first().text.startswith(begins)


def test_owner_lists(spark):
    ok = "0x" + "A" * 40
    lists = spark.createDataFrame([(1, [ok, " " + ok.lower()]), (2, [])], "owner_id long, addresses array<string>")
    assert [tuple(r) for r in A.clean_owner_lists(lists).collect()] == [(1, ok.lower())]
    with pytest.raises(SparkRuntimeException, match="not an address"):
        A.clean_owner_lists(spark.createDataFrame([(1, ["0x12"])], "owner_id long, addresses array<string>")).collect()
    kind = "owner_id long, address string, is_primary boolean"
    owned, new = spark.createDataFrame([(1, "a", True), (1, "b", False)], kind), spark.createDataFrame([(2, "a", False), (2, "c", True)], kind)
    assert {tuple(r) for r in A.owner_conflicts(owned, new).collect()} == {("a", 2, 1)}
    assert {(r.owner_id, r.address) for r in A.insert_owners(owned, new).collect()} == {(1, "a"), (1, "b"), (2, "c")}
    assert {(r.owner_id, r.address) for r in A.insert_owners(owned, new, True).collect()} == {(2, "a"), (1, "b"), (2, "c")}


def test_other_ledgers(spark):
    kind = "wallet string, txid string, vin array<string>, vout array<struct<address string, value long>>"
    raw = spark.createDataFrame([("W", "t1", ["x"], [("w", 150_000_000), ("w", 50_000_000), ("y", 7)]), ("W", "t2", ["w"], [("y", 5)]), ("W", "t3", ["q"], [("y", 5)])], kind)
    assert {(r.tx_hash, r.from_address, r.to_address, r.value, r.direction) for r in A.utxo_transfers(raw).collect()} == {("t1", "x", "W", 2.0, "in"), ("t2", "w", None, 0.0, "out")}
    sol = spark.createDataFrame([("S", "s1", ["k"], [5_000_000_000], [2_500_000_000]), ("S", "s2", [], [], [1])], "wallet string, signature string, keys array<string>, pre array<long>, post array<long>")
    assert {(r.tx_hash, r.value, r.direction) for r in A.lamport_transfers(sol).collect()} == {("s1", 2.5, "out"), ("s2", 1e-9, "in")}


def test_more_scalars(spark):
    df = spark.createDataFrame([("café ﬁn ½ — naïve",)], "t string")
    assert df.select(S.ascii_text(F.col("t"))).first()[0] == "cafe fin 12 - naive"
    times = spark.createDataFrame([("0x10",), ("16",), ("1970-01-01T00:00:16Z",), ("zz",)], "t string")
    assert [r[0] and r[0].timestamp() for r in times.select(S.any_timestamp(F.col("t"))).collect()] == [16, 16, 16, None]
    ids = spark.createDataFrame([("ABC",), ("0xAb",), ("0xzz",)], "t string")
    assert [r[0] for r in ids.select(S.hex_id(F.col("t"))).collect()] == ["0xabc", "0xab", None]


def test_strongest_hits(spark):
    hits = spark.createDataFrame([("e", "m", 0.4, ["b", "a"]), ("e", "m", 0.7, ["c", "a"]), ("e", "n", 0.1, []), ("f", "m", 0.2, None)], "entity string, method string, score double, hashes array<string>")
    got = {(r.entity, r.method): (r.score, r.hashes) for r in A.strongest_hits(hits).collect()}
    assert got == {("e", "m"): (0.7, ["a", "b", "c"]), ("e", "n"): (0.1, []), ("f", "m"): (0.2, [])}
