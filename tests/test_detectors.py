"""Hand-computed cases of the detectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.config import EngineConfig
from tracewell.functions import scalar as S
from tracewell.operators import clustering, heuristics, integration, layering, placement, risk
from tracewell.operators.etl import flatten_blocks, keep_latest, upsert
from tracewell.operators.graph import bounded_cycles, connected_components, propagate
from tracewell.operators.joins import interval_join
from tracewell.schema import RAW_BLOCK, TRANSFERS

CFG = EngineConfig(min_shared_counterparties=3, max_pattern_size=20)


def edges(spark, rows, calls=False):
    return spark.createDataFrame([(f"t{i}", 1, float(t), a, b, float(v), calls, "") for i, (a, b, v, t) in enumerate(rows)], TRANSFERS)


def pairs(df):
    return {tuple(r) for r in df.select("a", "b").collect()}


@pytest.mark.parametrize(
    ("name", "rows", "want"),
    [
        ("coordinated_cashout", [("a1", "c", 1.0, 10), ("a2", "c", 1.02, 40), ("o", "c", 4.0, 500)], {("a1", "a2")}),
        ("common_funder", [("t", "a1", 2, 10), ("t", "a2", 2, 11), ("a1", "s", 1, 20), ("a2", "s", 1.1, 21)], {("a1", "a2")}),
        ("deposit_address_reuse", [("u1", "d", 1.0, 10), ("d", "e", 0.995, 20), ("u2", "d", 1.005, 30), ("d", "e", 1.0, 40)], {("u1", "u2")}),
        ("behavioral_similarity", [("a1", "x", 1, 1), ("a1", "y", 1, 2), ("a2", "x", 1, 3), ("a2", "y", 1, 4)], {("a1", "a2"), ("x", "y")}),
        ("repeated_flow", [("a", "b", 1, 1), ("b", "a", 1, 2), ("c", "d", 1, 1), ("c", "d", 1, 2), ("e", "f", 1, 1)], {("a", "b"), ("c", "d")}),
        ("temporal_coordination", [("a", "r", 1, 0), ("b", "r", 1, 30), ("c", "r", 1, 60), ("d", "r", 1, 200)], {("a", "b"), ("a", "c"), ("b", "c")}),
        ("loop_detection", [("a", "b", 1, 1), ("b", "c", 1, 2), ("c", "a", 1, 3), ("c", "d", 1, 4)], {("a", "b"), ("a", "c"), ("b", "c")}),
    ],
)
def test_heuristics(spark, name, rows, want):
    assert pairs(heuristics.HEURISTICS[name](edges(spark, rows), CFG)) == want
    # order of rows and repeats of a transfer make no difference
    assert pairs(heuristics.HEURISTICS[name](edges(spark, rows).orderBy(F.rand(3)), CFG)) == want


def test_empty_and_null_transfers(spark):
    none = edges(spark, [("a", "b", 1, 1)]).where("false")
    for f in heuristics.HEURISTICS.values():
        assert f(none, CFG).count() == 0
    odd = spark.createDataFrame([("t", 1, 1.0, None, "b", 1.0, False, "")], TRANSFERS)
    assert heuristics.all_links(odd, CFG).count() == 0


def test_gate(spark):
    rows = [("a", "b", "fan_pattern"), ("c", "d", "fan_pattern"), ("c", "d", "loop_detection"), ("e", "f", "common_funder"), ("e", "f", "coordinated_cashout")]
    links = spark.createDataFrame(rows, "a string, b string, name string")
    assert pairs(heuristics.gate(links, EngineConfig(min_heuristic_support=2))) == {("c", "d")}
    assert pairs(heuristics.gate(links, EngineConfig(min_heuristic_support=1))) == {("a", "b"), ("c", "d")}


def test_indicators(spark):
    members = spark.createDataFrame([("a1", "C", 2), ("a2", "C", 2)], "address string, cluster_id string, size long")
    r = clustering.indicators(edges(spark, [("a1", "a2", 1.25, 10), ("a2", "x", 0.5, 20), ("x", "a1", 0.75, 30)]), members).first()
    assert (r.internal_volume, r.internal_tx, r.total_volume, r.total_in, r.total_out, r.net, r.span) == (1.25, 1, 2.5, 2.0, 1.75, 0.25, 20.0)


def test_owner_labels(spark):
    members = spark.createDataFrame([(f"a{i}", "C", 3) for i in range(3)] + [("b1", "D", 2), ("b2", "D", 2), ("z", "E", 1)], "address string, cluster_id string, size long")
    owners = spark.createDataFrame([(1, "a0", False), (1, "a1", False), (2, "a2", True), (3, "b1", False), (4, "b2", False)], "owner_id long, address string, is_primary boolean")
    got = {r.cluster_id: (r.status, r.owner_id) for r in clustering.owner_labels(members, owners).collect()}
    assert got == {"C": ("matched", 1), "D": ("conflict", None), "E": ("unlabeled", None)}


def flows(spark, rows):
    return spark.createDataFrame([(a, b, float(t), f"t{i}", float(v)) for i, (a, b, v, t) in enumerate(rows)], "src string, dst string, ts double, tx_hash string, value double")


P = EngineConfig(high_value=1, structuring_max_cv=0.1, smurf_senders=4, smurf_max_age=7200)


def test_structuring(spark):
    r = placement.structuring(flows(spark, [("f1", "c", 0.49, 100), ("f2", "c", 0.5, 160), ("f3", "c", 0.51, 220), ("f4", "c", 0.5, 280)]), P).first()
    assert (r.entity, r.confidence) == ("c", 0.8255)


def test_smurfing(spark):
    f = flows(spark, [(f"s{i}", "w", 0.4, 50 + 50 * i) for i in range(1, 5)])
    profile = spark.createDataFrame([("w", 100.0, 250.0)], "entity string, first_seen double, last_seen double")
    assert placement.smurfing(f, profile, P).first().confidence == 0.7677


def test_micro_funding(spark):
    f = flows(spark, [(f"a{i}", "w", 0.07, 10 * i) for i in range(1, 9)])
    r = placement.micro_funding(f, EngineConfig(micro_max=0.1, micro_count=6, micro_total=0.4)).first()
    assert r.confidence == pytest.approx(0.40 * 8 / 12 + 0.40 * 0.56 / 1.2 + 0.20, abs=1e-4)


@pytest.mark.parametrize(("scores", "mode"), [((0.91, 0.70, 0.66), "dominant"), ((0.88, 0.84, 0.62), "paired"), ((0.91, 0.89, 0.86), "balanced")])
def test_highlights(spark, scores, mode):
    ranked = spark.createDataFrame([("e", f"b{i}", s, i) for i, s in enumerate(scores, 1)], "entity string, behavior string, confidence double, rank int")
    assert placement.highlights(ranked).first()["mode"] == mode


def test_integration_signals(spark):
    one = lambda f, rows, cfg=EngineConfig(): {r.address: r.score for r in f(edges(spark, rows), cfg).collect()}
    assert one(integration.convergence, [(f"s{i}", "x", 10, i) for i in range(5)]) == {"x": 0.6}
    assert one(integration.terminal_node, [("a", "x", 20, 1)]) == {"x": 0.65}
    assert one(integration.dormancy, [("a", "x", 9, 1), ("x", "b", 5, 1 + 45 * 86400)])["x"] == 0.5
    assert one(integration.reaggregation, [(f"s{i}", "x", 1, i) for i in range(4)] + [("x", "y", 4, 9)]) == {"x": 0.5625}
    both = edges(spark, [(f"s{i}", "x", 10, i) for i in range(5)])
    up = spark.createDataFrame([("x", 0.6, 0.0)], "address string, layering double, placement double")
    got = {r.address: r for r in integration.alerts(both, EngineConfig(), up).collect()}
    # converges (0.6) and is terminal (0.65)
    assert (got["x"].score, got["x"].confidence) == (0.875, 0.65)


def test_risk(spark):
    found = spark.createDataFrame([("e", "structuring"), ("e", "mixing_interaction")], "entity string, behavior string")
    assert risk.behavior_score(found).first().behavior == pytest.approx(1 - math.exp(-0.6), abs=1e-6)
    names = ["entity", *risk.FACTORS, "risk"]
    scored = spark.createDataFrame([("a", 0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.75), ("b", 0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.75), ("c", 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.85)], names)
    prior = spark.createDataFrame([("a", True), ("b", False)], "entity string, was_poi boolean")
    assert {r.entity: r.is_poi for r in risk.poi_status(scored, prior).collect()} == {"a": True, "b": False, "c": False}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "a string, b string")
    got = {r.node: round(r.risk, 4) for r in propagate(chain, spark.createDataFrame([("n0", 0.9)], "node string, score double")).collect()}
    assert got == {"n0": 1.0, "n1": 0.54, "n2": 0.27, "n3": 0.09}
    assert risk.poi_reason(scored).where("entity = 'a'").first().reason


def test_peeling_chain(spark):
    rows = [("seed", "m1", 9, 10), ("seed", "f1", 1, 11), ("m1", "m2", 8, 100), ("m1", "f2", 1, 101), ("m2", "m3", 7, 200), ("m2", "f3", 1, 201)]
    r = layering.peeling_chain(edges(spark, rows), spark.createDataFrame([("seed",)], "seed string"), gap=300.0).first()
    assert (r.path, r.hops) == (["seed", "m1", "m2", "m3"], 3) and r.confidence == pytest.approx(0.8525, abs=1e-4)
    ends = layering.peeling_chain(edges(spark, rows), spark.createDataFrame([("seed",)], "seed string"), gap=300.0, exchanges=spark.createDataFrame([("m3",)], "address string")).first()
    assert ends.confidence == pytest.approx(0.8 * 0.8525, abs=1e-4)


def test_peeling_chain_ties(spark):
    # of equal targets the earlier, then the greater is the main one
    rows = [("s", "a", 9, 10), ("s", "z", 1, 10), ("a", "b", 4, 20), ("a", "c", 4, 20), ("a", "q", 0.5, 20), ("c", "d", 3, 30), ("c", "e", 0.5, 30)]
    r = layering.peeling_chain(edges(spark, rows), spark.createDataFrame([("s",)], "seed string"), high=2.0).first()
    assert r.path == ["s", "a", "c", "d"]


def test_bridges(spark):
    rows = [("seed", "bridge", 5, 10), ("bridge", "fresh", 4.95, 100)]
    c = layering.bridge_candidates(edges(spark, rows), spark.createDataFrame([("bridge",)], "address string"), 0.03, 300.0)
    found = layering.match_bridges(c)
    assert found.count() == 1
    hit = layering.bridge_hopping(found, spark.createDataFrame([("seed",)], "seed string"), spark.createDataFrame([("fresh", 100.0, 1)], "address string, first_seen double, degree long"), 300.0).first()
    want = 0.40 * 0.99 + 0.30 * math.exp(-90 / 300) + 0.20 + 0.10
    assert hit.confidence == pytest.approx(want, abs=1e-4) and want == pytest.approx(0.9182, abs=1e-4)


def test_bridge_rounds_equal_deposits_in_turn(spark):
    rng = random.Random(5)
    rows = [(f"u{i}", "b", rng.choice([9.8, 10, 10.2]), rng.randrange(300)) for i in range(60)] + [("b", f"w{i}", rng.choice([9.8, 10, 10.2]), rng.randrange(400)) for i in range(45)]
    c = layering.bridge_candidates(edges(spark, rows), spark.createDataFrame([("b",)], "address string"), 0.05, 100.0)
    used, want = set(), set()
    found = c.collect()
    for _, deposit in sorted({(r.dts, r.deposit) for r in found}):
        free = [(r.cost, r.wts, r.withdrawal) for r in found if r.deposit == deposit and r.withdrawal not in used]
        if free:
            used.add(min(free)[2])
            want.add((deposit, min(free)[2]))
    assert len(want) > 30 and {(r.deposit, r.withdrawal) for r in layering.match_bridges(c).collect()} == want
    assert layering.match_bridges(c.where("false")).count() == 0


def test_bridge_matching_uses_each_withdrawal_once(spark):
    rows = [("a", "b", 10, 0), ("c", "b", 10, 5), ("b", "x", 10, 10), ("b", "y", 10, 20)]
    c = layering.bridge_candidates(edges(spark, rows), spark.createDataFrame([("b",)], "address string"), 0.1, 100.0)
    got = {(r.deposit, r.withdrawal) for r in layering.match_bridges(c).collect()}
    assert got == {("t0", "t2"), ("t1", "t3")}


def test_high_depth(spark):
    rows = [("seed", "a1", 5, 10), ("a1", "a2", 4.5, 20), ("a2", "a3", 4, 30), ("a3", "a4", 3.7, 40)]
    r = layering.high_depth(edges(spark, rows), spark.createDataFrame([("seed",)], "seed string"), 5, 4, 2, 0.7, 300.0, 0.5).first()
    assert (r.path, r.depth) == ("seed>a1>a2>a3>a4", 4) and r.score == pytest.approx(0.8809, abs=1e-4)


def test_mixing(spark):
    rows = [("seed", "m", 10, 10), ("seed", "m", 10, 40), ("m", "f1", 9.9, 80), ("m", "f2", 9.8, 120)]
    r = layering.mixing_interaction(edges(spark, rows), spark.createDataFrame([("seed",)], "seed string"), spark.createDataFrame([("m",)], "address string"), gap=300.0, min_density=0.1).first()
    assert r.seed == "seed" and r.confidence == pytest.approx(0.9072, abs=1e-4)


def test_shell_network(spark):
    rows = [("s", "w1", 1, 10), ("w1", "w2", 0.9, 20), ("w2", "w3", 0.85, 30), ("w3", "s", 0.8, 40), ("s", "w2", 0.75, 200), ("w2", "w1", 0.7, 210), ("w1", "w3", 0.65, 220), ("w3", "s", 0.6, 230)]
    got = layering.shell_networks(edges(spark, rows), spark.createDataFrame([("s",)], "seed string"), window=130.0).collect()
    assert [r.nodes for r in got] == ["s,w1,w2,w3"] and 0.5 < got[0].confidence <= 1
    # services are left out
    out = layering.shell_networks(edges(spark, rows), spark.createDataFrame([("s",)], "seed string"), window=130.0, services=spark.createDataFrame([("w2",)], "address string"))
    assert out.count() == 0
    two = {(f"{g}{i}", f"{g}{j}"): 1.0 for g in "ab" for i in range(4) for j in range(i)} | {("a0", "b0"): 0.1}
    assert sorted(sorted(c) for c in layering.local_communities(two)) == [["a0", "a1", "a2", "a3"], ["b0", "b1", "b2", "b3"]]


@pytest.mark.parametrize("order", ["ordered", "reversed", "shuffled", "alternating"])
def test_components_of_long_chains(spark, order):
    n = 10_000
    ids = list(range(n))
    if order == "reversed":
        ids = ids[::-1]
    elif order == "shuffled":
        random.Random(3).shuffle(ids)
    elif order == "alternating":
        ids = [x for i in range(n // 2) for x in (i, n - 1 - i)]
    chain = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    got = connected_components(chain, max_rounds=20, one_task=0)
    assert (got.count(), got.agg(F.max("root")).first()[0]) == (n, 0)


def test_components_of_odd_edges(spark):
    rows = [("x", "y"), ("y", "x"), ("x", "y"), ("z", "z"), (None, "x"), ("q", None), ("m", "n")]
    got = connected_components(spark.createDataFrame(rows, "a string, b string"))
    joined = connected_components(spark.createDataFrame(rows, "a string, b string"), one_task=0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, got.collect()))
    assert {(r.node, r.root) for r in got.collect()} == {("x", "x"), ("y", "x"), ("z", "z"), ("m", "m"), ("n", "m")}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_and_cycles(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.root for r in connected_components(e).collect()} == {0, 100}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")], "a string, b string")
    assert {">".join(r.path) for r in bounded_cycles(ring).collect()} == {"a>b>c", "a>b"}


def test_interval_join_matches_brute_force(spark):
    left = spark.range(60).select((F.col("id") % 3).alias("k"), (F.col("id") * 7.3).alias("lts"))
    right = spark.range(60).select((F.col("id") % 3).alias("k"), (F.col("id") * 5.1 - 20).alias("rts"))
    got = interval_join(left, right, ["k"], "lts", "rts", 11.0).count()
    want = sum(a.k == b.k and a.lts <= b.rts <= a.lts + 11 for a in left.collect() for b in right.collect())
    assert got == want > 0


def test_flatten_and_upsert(spark):
    tx = [("0xA", "0xF", "0xT", "1000000000000000000", "0x", None), ("0xB", "0xF", None, "5", "0xabcdef0123", None), ("0xa", "0xF", "0xT", "1000000000000000000", "0x", None)]
    blocks = spark.createDataFrame([(1, "x", "eth", 3, tx, [("0xA", "0x1", "0x5208"), ("0xA", "0x0", "0x5208")])], RAW_BLOCK)
    got = {r.tx_hash: r for r in flatten_blocks(blocks).collect()}
    assert set(got) == {"0xa", "0xb"} and got["0xa"].status == 0 and got["0xa"].gas_used == 21000
    assert str(got["0xa"].value_eth) == "1.000000000000000000" and got["0xb"].is_contract_call and got["0xb"].method_id == "0xabcdef01"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = upsert(old, new, ["id"])
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (2, "c"), (3, "d")} == {tuple(r) for r in upsert(once, new, ["id"]).collect()}
    assert keep_latest(new.unionByName(new), ["id"], ["v"]).count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (6.0,), (3.0,)], "v double").select("v", S.risk_score(F.col("v"), 10.0).alias("s"))
    got = {r.v: (r.s, r.l) for r in df.withColumn("l", S.risk_label(F.col("s"))).collect()}
    assert got == {10.0: (75.0, "Medium"), 20.0: (100.0, "High"), 6.0: (45.0, "Medium"), 3.0: (22.5, "Low")}
    text = spark.createDataFrame([("Deposit→Contract→Withdraw cycles are linked — shared fan-out…",)], "t string")
    assert text.select(S.ascii_text(F.col("t"))).first()[0] == "Deposit->Contract->Withdraw cycles are linked - shared fan-out..."
    hexes = spark.createDataFrame([("0x10",), ("12",), ("zz",), (None,)], "h string")
    assert [r[0] for r in hexes.select(S.hex_to_long(F.col("h"))).collect()] == [16, 12, 0, 0]
    assert spark.createDataFrame([("0x" + "a" * 40,), ("not-an-address",)], "a string").select(S.is_address(F.col("a"))).collect() == [(True,), (False,)]
