"""Exports, lists, source choice, graph loads, saved clusterings and wallet scans on odd rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.config import EngineConfig
from tracewell.functions import scalar as S
from tracewell.operators import clustering as C
from tracewell.operators import etl
from tracewell.operators import wallet as W
from tracewell.operators.graph import graph_tables
from tracewell.sources import feeds, loads
from tracewell.sources.transfers import JsonTransfers

HEAD = "tx_hash,block_number,timestamp,from_address,to_address,value_eth,is_contract_call,gas_used,status"
TX = "tx_hash string, block_number long, ts double, from_address string, to_address string, value double, is_contract_call boolean, method_id string"


def test_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEAD}\nh1,1,2024-01-01T00:00:00Z,a,b,2.385e-11,True,21000,1\nh2,x,bad,a,b,lots,1,,\n ,1,,a,b,1,0,1,1\n,1,,a,b,1,0,1,1\nh1,2,,c,d,1e3,no,5,0\n")
    rows = loads.read_export(spark, str(tmp_path / "a.csv"))
    ready, counts = loads.prepare_rows(rows)
    got = {r.tx_hash: r for r in ready.collect()}
    # of one hash the later line stays
    assert set(got) == {"h1", "h2"} and got["h1"].from_address == "c" and got["h1"].value_eth == "1000." + "0" * 18 and got["h1"].timestamp is None
    assert (got["h2"].block_number, got["h2"].timestamp, got["h2"].value_eth, got["h2"].is_contract_call) == (None, None, "0." + "0" * 18, 1)
    assert counts.first().asDict() == {"rows": 5, "blank": 2, "repeated": 1, "kept": 2}
    first = loads.prepare_rows(rows.where("from_address = 'a'"))[0].where("tx_hash = 'h1'").first()
    assert first.value_eth == "0.000000000023850000" and first.is_contract_call == 1 and first.timestamp == datetime.datetime(2024, 1, 1)
    assert loads.read_export(spark, str(tmp_path / "a.csv"), 2).count() == 2
    (tmp_path / "b.csv").write_text("tx_hash,status\nh,1\n")
    with pytest.raises(ValueError, match="missing columns.*block_number"):
        loads.read_export(spark, str(tmp_path / "b.csv"))
    empty = loads.prepare_rows(rows.limit(0))
    assert empty[0].count() == 0 and empty[1].first().asDict() == {"rows": 0, "blank": 0, "repeated": 0, "kept": 0}


def test_first_source_with_rows(spark, tmp_path):
    for name, rows in (("none", []), ("some", [("t", 1, 1.0, "A ", "b", 1.0, False, "")]), ("raw", [("u", 1, 1.0, "a", "", 1.0, False, ""), ("v", 1, 1.0, "a", "b", 1.0, False, "")])):
        spark.createDataFrame(rows, TX).write.json(str(tmp_path / name))
    sources = {n: JsonTransfers(str(tmp_path / n)) for n in ("none", "some", "raw")}
    name, rows, counts = loads.resolve_source(spark, sources)
    assert (name, counts, rows.first().from_address) == ("some", {"none": 0, "some": 1}, "a")
    assert loads.resolve_source(spark, sources, prefer="raw")[0::2] == ("raw", {"raw": 2})
    assert loads.resolve_source(spark, {"none": sources["none"]}) == (None, None, {"none": 0})


def test_sanction_lists(spark, tmp_path):
    coin, evm = "1" + "A" * 25, "0x" + "aB" * 20
    line = ["7", "NAME, THE", "x", "PROG", *[""] * 7, f'paid ""{coin}""', "", f"and {evm}, {evm}\nor {coin}"]
    (tmp_path / "sdn.csv").write_text(",".join(f'"{c}"' for c in line) + "\nshort,row,only\n8,B,-0-,P\n")
    got = {r.name: r for r in feeds.read_sanctions(spark, str(tmp_path / "sdn.csv")).collect()}
    assert set(got) == {"NAME, THE", "B"} and got["B"].addresses == [] and got["B"].remarks == ""
    assert got["NAME, THE"].addresses == [evm, coin] and got["NAME, THE"].remarks == f'paid "{coin}" | and {evm}, {evm}\nor {coin}'
    listed = spark.createDataFrame([(None, "z", "ransomware", "s", 98, "l")], "chain string, address string, category string, source string, score int, label string")
    reports = spark.createDataFrame([("bc1q", "reported", "r", None), ("bc1p", "reported", "r", 0.9)], "address string, category string, source string, confidence double")
    table = feeds.flagged_table(feeds.read_sanctions(spark, str(tmp_path / "sdn.csv")), listed, reports)
    assert {(r.chain, r.address, r.score) for r in table.collect()} == {("global", "z", 98), ("ethereum", evm, 95), ("bitcoin", coin, 95), ("bitcoin", "bc1q", 60), ("bitcoin", "bc1p", 90)}


def test_graph_loads(spark):
    rows = [("h", 1, 1.0, "a", "b", 1.0, None, ""), ("h", 2, 1.0, "a", "b", None, True, ""), ("h", 1, 1.0, "b", "a", 1.0, False, ""), ("i", 1, 1.0, "a", "a", 1.0, False, ""), ("j", 1, 1.0, None, "b", 1.0, False, ""), ("k", 1, 1.0, "c", "", 1.0, False, "")]
    nodes, edges, counts = graph_tables(spark.createDataFrame(rows, TX))
    assert {r.address for r in nodes.collect()} == {"a", "b"} and tuple(counts.first()) == (4, 2)
    assert {(r.from_address, r.to_address, r.tx_hash, r.value, r.block_number) for r in edges.collect()} == {("a", "b", "h", 0.0, 2), ("b", "a", "h", 1.0, 1), ("a", "a", "i", 1.0, 1)}
    rows = spark.createDataFrame([(1,), (2,), (3,)], "block_number long")
    assert tuple(etl.sync_report(rows, rows.where("block_number <= 2")).first()) == (1, 2, 3)
    assert tuple(etl.sync_report(rows, rows.limit(0)).first()) == (3, 0, 3)


def test_saved_clusterings(spark):
    found = spark.createDataFrame([("a", "C1", 3), ("b", "C1", 3), ("c", "C1", 3), ("d", "C2", 2), ("e", "C2", 2)], "address string, cluster_id string, size long")
    signs = spark.createDataFrame([("C1", "fan_pattern", 2, 0.67), ("C2", "loop_detection", 1, 0.5), ("C1", "own_rule", 1, 0.33)], "cluster_id string, name string, n long, confidence double")
    sums = spark.createDataFrame([("C1", 4.5)], "cluster_id string, internal_volume double")
    known = spark.createDataFrame([("a",), ("b",), ("b",), ("d",), ("x",)], "address string")
    owners = spark.createDataFrame([(7, "b", True), (8, "d", False)], "owner_id long, address string, is_primary boolean")
    old = spark.createDataFrame([("C0",), ("C1",), ("C2",)], "cluster_id string")
    out = C.persisted(found, signs, sums, known, owners, old, EngineConfig())
    assert [tuple(r) for r in out["clusters"].collect()] == [("C1", 2, 4.5, "normal", "matched", 7, "b")]
    assert {tuple(r) for r in out["addresses"].collect()} == {("a", "C1"), ("b", "C1"), ("d", None), ("x", None)}
    assert {(r.heuristic, r.text.rsplit(".", 1)[-1]) for r in out["evidence"].collect()} == {("fan_pattern", " (signals: 2)"), ("own_rule", "own rule (signals: 1)")}
    assert {r.cluster_id for r in out["stale"].collect()} == {"C0", "C2"}


def test_wallets_over_chains(spark):
    one = spark.createDataFrame([("w", "t", "w", "x", 1.0, 1.0, "0xA9059CBB0000")], "wallet string, tx_hash string, from_address string, to_address string, value double, ts double, method_id string")
    lost = lambda: spark.read.parquet("/nowhere/at/all")
    rows, errors = W.scan_chains({"a": lambda: one, "b": lost}, lambda t: t.select("wallet"))
    assert [tuple(r) for r in rows.collect()] == [("w", "a")] and set(errors) == {"b"}
    with pytest.raises(RuntimeError, match="no chain"):
        W.scan_chains({"b": lost}, lambda t: t)
    assert W.labelled(one, {"0xa9059cbb": "swap"}).first().label == "swap" and W.labelled(one, {"0x00000000": "swap"}).first().label == "send"
    got = W.explorer_summary(one).first()
    assert (got.n_sent, got.n_received, got.sent, got.received, got.newest) == (1, 0, 1.0, 0.0, ["t"])


def test_page_texts(spark):
    row = spark.range(1).select(
        S.iso_time(F.lit(0.0)).alias("zero"), S.iso_time(F.lit(1.9)).alias("one"), S.iso_time(F.lit(None).cast("double")).alias("none"),
        S.plain_amount(F.lit("0.000000000000000001").cast("decimal(38,18)")).alias("wei"), S.plain_amount(F.lit("12300").cast("decimal(38,18)")).alias("whole"), S.plain_amount(F.lit("0").cast("decimal(38,18)")).alias("nothing"),
        *[S.detect_chain(F.lit(a), F.lit(c)).alias(f"c{i}") for i, (a, c) in enumerate([(" 1" + "a" * 30, "tron"), ("0x" + "1" * 40, "base"), ("0x" + "1" * 40, "tron"), (S.GNOSIS_ADDRESS.upper().replace("0X", "0x"), "base"), ("?", "tron")])],
    ).first()
    assert (row.zero, row.one, row.none) == (None, "1970-01-01T00:00:01+00:00", None)
    assert (row.wei, row.whole, row.nothing) == ("0.000000000000000001", "12300", "0")
    assert [row[f"c{i}"] for i in range(5)] == ["bitcoin", "base", "ethereum", "gnosis", "tron"]
