"""The transform job, interrupted and repeated, and communities by levels."""

import itertools
import random
import tempfile

import pytest

from tracewell.operators import layering as L
from tracewell.operators import transform as X
from tracewell.schema import FLAT_DOC, RAW_BLOCK


def doc(n, i, **more):
    return {"tx_hash": f"t{n}-{i}", "block": {"number": n, "timestamp": "1970-01-01T00:01:00Z"}, "address_pair": {"from": " A ", "to": f"B{i}"}, "value": {"eth": 1.5}, "forensics": {"is_contract": None, "method_id": "0xAB ", "transaction_index": i}, "gas": {"gas_used": 1}, **more}


def raw(block, n, at="1"):
    tx = [{"hash": f"T{block}-{i}", "from_": "A", "to": f"B{i}", "value": str(2 * 10**18), "input": "0x", "gas": "0x1"} for i in range(n)]
    return (block, at, "eth", n, [tuple(t.values()) for t in tx], [])


@pytest.fixture(scope="module")
def inputs(spark):
    # block 1 is whole, 2 lacks one, 3 has none, 4 says no number and has one, 5 says none and has none, 6 says 0 and has none, 25000 is in another range
    heads = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, None), (6, 0), (25_000, 1)], "block_number long, transaction_count long")
    flat = spark.createDataFrame([doc(1, 0), doc(1, 1), doc(2, 0), doc(2, 1), doc(4, 0), doc(25_000, 0), doc(99, 0)], FLAT_DOC)
    blocks = [raw(2, 2, "0"), raw(2, 3, "1"), raw(3, 1), raw(4, 7), raw(5, 2), raw(1, 5)]
    return heads, flat, spark.createDataFrame(blocks, RAW_BLOCK)


WANT = {("t1-0", "flat"), ("t1-1", "flat"), ("t2-0", "raw"), ("t2-1", "raw"), ("t2-2", "raw"), ("t3-0", "raw"), ("t4-0", "flat"), ("t5-0", "raw"), ("t5-1", "raw"), ("t25000-0", "flat")}


def shown(store):
    rows = [(r.tx_hash, r.derived) for r in store.read("rows").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("size", [1, 3, 100])
def test_interrupted_and_repeated_runs_give_one_table(spark, inputs, size):
    store = X.transform_store(spark, tempfile.mkdtemp(), 4)
    assert X.transform(store, *inputs, size=size, most=1) == 1 and shown(store) <= WANT
    # what a broken batch leaves behind is not seen
    inputs[1].limit(0).selectExpr("1L as block_range", "1L as block_number", "'junk' as tx_hash", "'' as from_address", "'' as to_address", "0D as value_eth", "false as is_contract_call", "'' as method_id", "'raw' as derived", "0 as bucket").write.partitionBy("bucket").parquet(f"{store.path}/rows/commit=1")
    for _ in range(2):
        X.transform(store, *inputs, size=size)
        assert shown(store) == WANT
    assert {r.block_number for r in store.read("blocks").collect()} == {1, 2, 3, 4, 5, 6, 25_000}
    values = {r.tx_hash: (r.from_address, r.to_address, r.value_eth, r.method_id) for r in store.read("rows").collect()}
    assert values["t1-1"] == ("a", "b1", 1.5, "0xab") and values["t2-2"] == ("a", "b2", 2.0, "0x")


def test_pending_blocks(spark, inputs):
    heads = inputs[0]
    done = heads.where("block_number in (2, 3)")
    take = lambda **k: [r.block_number for r in X.pending_blocks(heads, done, **{"size": 10, **k}).collect()]
    assert take() == [1, 4, 5, 6, 25_000] and take(size=2) == [1, 4] and take(start=4, end=6) == [4, 5, 6]
    assert take(after=4) == [5, 6, 25_000] and take(start=5, after=1, end=5) == [4, 5]


def test_flat_documents(spark):
    odd = [doc(1, 0), doc(2, 0, address_pair={"from": " ", "to": None}), doc(3, 0, block={"number": None, "timestamp": "?"}, value=None, forensics=None, address_pair={"from": None, "to": "C"})]
    got = {r.tx_hash: r for r in X.flat_document_transfers(spark.createDataFrame(odd, FLAT_DOC)).collect()}
    assert set(got) == {"t1-0", "t3-0"} and (got["t1-0"].ts, got["t1-0"].method_id, got["t1-0"].from_address) == (60.0, "0xab", "a")
    assert tuple(got["t3-0"])[1:] == (0, 0.0, None, "c", 0.0, False, "")


def partitions(nodes):
    if not nodes:
        yield []
        return
    head, *rest = nodes
    for p in partitions(rest):
        yield [{head}, *p]
        for i in range(len(p)):
            yield [*p[:i], p[i] | {head}, *p[i + 1 :]]


def test_communities_by_levels():
    # a ring of four cliques of five: single edges between them
    weights = {(f"{c}{i}", f"{c}{j}"): 1.0 for c in "abcd" for i, j in itertools.combinations(range(5), 2)}
    weights |= {("a0", "b1"): 1.0, ("b0", "c1"): 1.0, ("c0", "d1"): 1.0, ("a1", "d0"): 1.0}
    assert {frozenset(g) for g in L.louvain(weights)} == {frozenset(f"{c}{i}" for i in range(5)) for c in "abcd"}
    rng, better, exact = random.Random(5), 0, 0
    for _ in range(60):
        nodes = [f"n{i}" for i in range(7)]
        some = {e: float(rng.randrange(1, 4)) for e in itertools.combinations(nodes, 2) if rng.random() < 0.35}
        if not some:
            continue
        used = sorted({u for e in some for u in e})
        best = max(L.modularity(some, p) for p in partitions(used))
        one, all_levels = L.modularity(some, L.local_communities(some)), L.modularity(some, L.louvain(some))
        assert one - 1e-9 <= all_levels <= best + 1e-9
        assert sorted(u for g in L.louvain(some) for u in g) == used
        better, exact = better + (all_levels > one + 1e-9), exact + (all_levels > best - 1e-9)
    assert better and exact >= 40
    # a long path needs more than one level
    path = {(f"p{i:02d}", f"p{i + 1:02d}"): 1.0 for i in range(40)}
    assert L.modularity(path, L.louvain(path)) > L.modularity(path, L.local_communities(path))
