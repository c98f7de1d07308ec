"""Operators in forms that don't square a hub or a hot receiver, against their definitions."""

import itertools
import random
import statistics

import pytest

from tracewell.config import EngineConfig
from tracewell.operators import heuristics as H
from tracewell.operators import placement as P
from tracewell.operators.graph import bounded_cycles

TX = "tx_hash string, block_number long, ts double, from_address string, to_address string, value double, is_contract_call boolean, method_id string"


def transfers(spark, pairs, values=itertools.repeat(1.0)):
    return spark.createDataFrame([(f"t{i}", i, float(i), a, b, v, False, "") for i, ((a, b), v) in enumerate(zip(pairs, values))], TX)


def plain_structuring(rows, cfg):
    out = {}
    for dst in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == dst), key=lambda r: (r[2], r[3]))
        for k, last in enumerate(own):
            window = [r for r in own[: k + 1] if last[2] - r[2] <= cfg.structuring_window]
            good = [r[4] for r in window if r[4] > 0]
            if len(good) < cfg.structuring_min_tx:
                continue
            cv = statistics.pstdev(good) / max(statistics.fmean(good), 1e-9)
            if cv > cfg.structuring_max_cv:
                continue
            c = 0.35 * min(1, len(window) / (2 * cfg.structuring_min_tx)) + 0.35 * (1 - min(1, cv / cfg.structuring_max_cv)) + 0.3 * min(1, round(sum(r[4] for r in window), 2) / max(cfg.high_value, 1))
            c = round(min(1, max(0, c + (0.05 if len({r[0] for r in window}) >= 3 else 0))), 4)
            out[dst] = max(out.get(dst, 0), c)
    return {d: c for d, c in out.items() if c >= 0.55}


@pytest.mark.parametrize("senders", [1, 2, 3, 7])
def test_structuring_windows(spark, senders):
    rng = random.Random(senders)
    cfg = EngineConfig(structuring_window=10, structuring_min_tx=3, structuring_max_cv=0.3, high_value=8)
    rows = [(f"s{rng.randrange(senders)}", f"d{rng.randrange(12)}", float(rng.randrange(60)), f"h{i:03d}", rng.choice([0.0, 1.0, 1.25, 1.5, 2.0])) for i in range(260)]
    flows = spark.createDataFrame(rows, "src string, dst string, ts double, tx_hash string, value double")
    got = {r.entity: r.confidence for r in P.structuring(flows, cfg).collect()}
    want = plain_structuring(rows, cfg)
    assert set(got) == set(want) and all(abs(got[d] - want[d]) < 1.5e-4 for d in want) and len(want) > 3


@pytest.mark.parametrize("least", [1, 2, 3, 4])
def test_behavioural_pairs(spark, least):
    rng = random.Random(least)
    pairs = [(f"u{rng.randrange(14)}", f"p{rng.randrange(9)}") for _ in range(70)] + [(f"u{i}", "hub") for i in range(14)] + [("x", "p1"), ("x", "p2"), ("p2", "y"), ("p1", "y"), ("z", "lone")]
    peers = {}
    for a, b in pairs:
        peers.setdefault(a, set()).add(b)
        peers.setdefault(b, set()).add(a)
    want = set()
    for a, b in itertools.combinations(sorted(peers), 2):
        n = len(peers[a] & peers[b])
        if n >= 2 and (n >= least or n / len(peers[a] | peers[b]) >= 0.75):
            want.add((a, b))
    got = [tuple(r) for r in H.behavioral_similarity(transfers(spark, pairs), EngineConfig(min_shared_counterparties=least)).collect()]
    assert set(got) == want and len(got) == len(want) and ("x", "y") in want


def test_a_hub_brings_no_pairs_together(spark):
    """500 nodes that share a hub, and nothing else that others have, are compared with none."""
    pairs = [(f"u{i}", "hub") for i in range(500)] + [(f"u{i}", f"own{i}") for i in range(500)] + [(f"u{i}", f"own{i + 1}") for i in range(3)]
    got = H.behavioral_similarity(transfers(spark, pairs), EngineConfig(min_shared_counterparties=2))
    # the hub and what two of them own share these two
    assert {tuple(r) for r in got.collect()} == {("u0", "u1"), ("u1", "u2"), ("u2", "u3"), ("hub", "own1"), ("hub", "own2"), ("hub", "own3")}


def test_fans_are_looked_up_for_pairs_with_other_evidence(spark):
    pairs = [("f", f"m{i}") for i in range(30)] + [("m1", "m2"), ("m2", "m1"), ("m3", "q"), ("q", "m3")]
    cfg = EngineConfig(min_heuristic_support=2, fan_threshold=5)
    rows = transfers(spark, pairs)
    few, every = H.gated_links(rows, cfg), H.all_links(rows, cfg)
    fans = lambda df: df.where("name = 'fan_pattern'").count()
    assert fans(every) == 435 and fans(few) < 5
    assert sorted(map(tuple, H.gate(few, cfg).collect())) == sorted(map(tuple, H.gate(every, cfg).collect())) != []


@pytest.mark.parametrize("longest", [2, 3, 5, 6])
def test_cycles_by_halves(spark, longest):
    rng = random.Random(9)
    edges = {(rng.randrange(11), rng.randrange(11)) for _ in range(34)}
    want = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1] and len(path) >= 2 and b == path[0]:
                want.add(tuple(path))
            if a == path[-1] and b > path[0] and b not in path and len(path) < longest:
                walk([*path, b])

    for start in range(11):
        walk([start])
    got = [tuple(r.path) for r in bounded_cycles(spark.createDataFrame(sorted(edges), "a long, b long"), longest).collect()]
    assert set(got) == want and len(got) == len(want) > 1
