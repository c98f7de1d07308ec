"""Wallet risk, simulation, history and services by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tracewell.operators import risk as K
from tracewell.operators import services as V
from tracewell.operators import wallet as W

TX = "wallet string, tx_hash string, from_address string, to_address string, value double, ts double, method_id string"


def test_wallet_risk_rules(spark):
    rows = [("W1", f"a{i}", "W1", f"t{i % 12}", 1.0, 1000.0 + 3600 * i, "swap") for i in range(16)]
    rows += [("W2", "b1", "x", "W2", 1.0, 100.0, ""), ("W2", "b2", "W2", "y", 1.0, 400.0, "approve"), ("W2", "b3", "W2", "y", 1.0, 9e5, "approve"), ("W2", "b4", "W2", "TC", 150.0, 9.5e5, "approve")]
    rows += [("W3", f"c{i}", "x", "W3", 1.0, 500.0, "") for i in range(10)] + [("W4", "d", "W4", None, 1.0, 5.0, "")]
    rows += [("W5", f"e{i}", "W5", f"u{i % 3}", 1.0, 500.0 + i, "") for i in range(12)]
    txs = spark.createDataFrame(rows, TX)
    found = W.detections(txs, spark.createDataFrame([("TC", "tornado_cash")], "address string, label string"), {"approve": "approval"})
    flagged = spark.createDataFrame([("w1", 25), ("W1", 30), ("t1", 90), ("y", 90), ("w4", 20)], "address string, points int")
    classes = W.entity_class(txs, found, txs.select(F.col("wallet").alias("address")).where("false"))
    got = {r.wallet: (r.score, r.level, r.reasons) for r in W.wallet_risk(txs, found, flagged, classes).collect()}
    # own flags add up; whom a wallet pays doesn't count
    assert got["W1"] == (25 + 30 + 10 + 15 + 10, "high_risk", "flagged, counterparty fan-out, activity burst, mostly outbound")
    assert got["W2"] == (20 + 10 + 25 + 5 + 30, "high_risk", "fast movement, repeated approvals, mixer or bridge exposure, large transfer, mixer")
    # ten transfers of one moment to one address: a bot by its target, not by its rate
    assert got["W3"] == (15, "safe", "bot") and got["W4"] == (20, "safe", "flagged")
    bots = {r.wallet: (r.rate, r.is_bot) for r in W.bot_behavior(txs).collect()}
    assert bots["W3"] == (0.0, True) and bots["W5"][1] and bots["W5"][0] > 5 and bots["W1"][1] is False
    spread = spark.createDataFrame([("W6", f"f{i}", "W6", f"u{i}", 1.0, 500.0, "") for i in range(10)], TX)
    assert not W.bot_behavior(spread).first().is_bot


SCORES = "entity string, label double, behavior double, propagation double, temporal double, exposure double, integration double, risk double"


@pytest.mark.parametrize(
    ("change", "want", "moved", "poi"),
    [
        ({}, 0.3, {}, False),
        ({"add_label": "SANCTIONED"}, 0.25 + 0.08 + 0.06 + 0.06, {"label": 0.6}, False),
        ({"add_label": "merchant"}, 0.3, {}, False),
        ({"remove_label": True, "add_label": "scam"}, 0.2, {"label": -0.4}, False),
        ({"toggle_behavior": "smurfing"}, 0.1 + 0.2 * (1 - 0.6 * math.exp(-0.25)) + 0.12, {"behavior": round(0.6 - 0.6 * math.exp(-0.25), 4)}, False),
        ({"add_integration": "terminal_node"}, 0.1 + 0.08 + 0.06 + 0.2 * 0.6, {"integration": 0.3}, False),
        ({"add_integration": "unheard"}, 0.1 + 0.08 + 0.06 + 0.2 * 0.4, {"integration": 0.1}, False),
        ({"add_label": "sanctioned", "weights": {"label": 0.9}}, 1.0, {"label": 0.6}, True),
    ],
)
def test_simulation(spark, change, want, moved, poi):
    scored = spark.createDataFrame([("e", 0.4, 0.4, 0.4, 0.0, 0.0, 0.3, 0.3)], SCORES)
    r = K.simulate(scored, **change).first()
    assert r.new_risk == pytest.approx(want, abs=1e-4) and r.difference == pytest.approx(want - 0.3, abs=1e-4)
    assert r.changed == pytest.approx(moved) and r.would_be_poi is poi
    assert r.strong == sum(r[f] >= 0.4 for f in K.FACTORS)


def test_behaviour_of_one_and_the_log(spark):
    scored = spark.createDataFrame([(f"e{i}", 1.0, 1.0, None, 0.5, 0.0, 0.0, 0.5) for i in range(5)], SCORES)
    sim = K.simulate(scored, toggle_behavior="loop_detection")
    assert sim.first().behavior == round(1 - math.exp(-3.4), 4)
    log = K.audit_rows(sim, "{}", "analyst", F.substring("entity", 2, 1).cast("int"))
    tail = K.audit_tail(log, 3).orderBy("place").collect()
    assert [(r.place, r.entity, r.action, r.current) for r in tail] == [(k, f"e{k + 1}", "simulate_risk", 0.5) for k in (1, 2, 3)]


def test_services(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"addresses": {"mixer": [" 0xAA", "0xbb", "", None], "vault": ["0xcc"]}, "methods": {"bridge": ["0xDEAD"]}, "keywords": {"vault": ["Strongbox"]}, "more": 1}))
    (tmp_path / "p" / "b.json").write_text("{ broken")
    profiles = V.read_profiles(spark, str(tmp_path / "p"))
    owners = spark.createDataFrame([("0xD1 ", "Some Kraken desk", None), ("0xd2", "plain", "uses a STRONGBOX router"), ("0xaa", "Coinbase", ""), ("", "Binance", ""), ("0xd3", None, None)], "address string, full_name string, notes string")
    addresses, methods = V.service_registry(profiles, owners)
    want = {("0xaa", "mixer"), ("0xbb", "mixer"), ("0xcc", "vault"), ("0xd1", "exchange"), ("0xd2", "vault"), ("0xd2", "bridge"), ("0xaa", "exchange")}
    assert {tuple(r) for r in addresses.collect()} == want and [tuple(r) for r in methods.collect()] == [("0xdead", "bridge")]
    said = spark.createDataFrame([("0xAA", "exchange"), ("0xbb", None)], "address string, category string")
    assert {tuple(r) for r in V.service_registry(profiles, owners, said)[0].collect()} == want - {("0xaa", "mixer"), ("0xbb", "mixer")}
    none = profiles.where("false")
    assert {tuple(r) for r in V.service_registry(none, owners)[0].collect()} == {("0xd1", "exchange"), ("0xaa", "exchange"), ("0xd2", "bridge")}
    txs = spark.createDataFrame([("t1", "0xBB", "q", "0x1"), ("t2", "q", "0xd1", "0xDEAD"), ("t3", "q", "r", None)], "tx_hash string, from_address string, to_address string, method_id string")
    assert {tuple(r) for r in V.service_transfers(txs, addresses, methods).collect()} == {("t1", "mixer", "from"), ("t2", "exchange", "to"), ("t2", "bridge", "method")}
