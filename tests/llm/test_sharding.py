"""Hilbert shards against the curve's definition and plain counts."""

import itertools
import os
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewell.llm import sharding

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, Shard string, curve_at int"


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2), (5, 1)])
def test_curve_visits_each_point_and_steps_to_a_neighbour(spark, dims, bits):
    points = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), [f"c{i}" for i in range(dims)])
    found = points.select("*", sharding.curve_index([F.col(f"c{i}") for i in range(dims)], bits).alias("h")).collect()
    path = [tuple(r[:dims]) for r in sorted(found, key=lambda r: r.h)]
    assert sorted(r.h for r in found) == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(path, path[1:]))


def test_cells_hold_equal_counts_and_keep_the_order(spark):
    rows = [(i, f"host-{i % 97:02d}", i * i) for i in range(4000)] + [(None, None, None)] * 3 + [(-5, "host-98", 0)]
    table = spark.createDataFrame(rows, "doc_id long, source string, n long")
    for column, first in (("doc_id", -5), ("source", "host-00"), ("n", 0)):
        cells = defaultdict(list)
        for value, cell in table.select(column, sharding.cell_columns(table, [column], 4)[0]).collect():
            cells[cell].append(value)
        assert None in cells[0] and first in cells[0] and 12 <= len(cells) <= 16
        spans = [[v for v in cells[c] if v is not None] for c in sorted(cells)]
        assert all(max(a) < min(b) for a, b in zip(spans, spans[1:]))
        assert max(map(len, spans)) <= 2 * len(rows) / 16


def test_each_row_has_a_place(spark):
    rows = [(i, "a" * (i % 50), "en", "s" if i % 3 else f"s{i}", i % 7, "x", 1) for i in range(203)]
    rows += [(None, None, None, None, None, None, None), (5, "ü\n日本", None, "s", None, "y", 2), (7, "", "", "", 0, "", 0), (9, "b" * 200_000, "de", "s", 200_000, "z", 3)] + [(11, "same", "en", "s", 4, "x", 1)] * 40
    docs = spark.createDataFrame(rows, ODD)
    got = sharding.shard_digests(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(8)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    table, shard, slot = sharding.write_shards(docs)
    assert (shard, slot) == ("shard_", "slot") and table.columns[: len(docs.columns)] == docs.columns
    assert Counter(tuple(r)[:7] for r in table.collect()) == Counter(rows)


def test_shards_of_near_equal_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 900), "en", f"s{i % 5}", i) for i in range(1000)], ODD[:ODD.index(", Shard")])
    slots, sizes = defaultdict(list), Counter()
    for r in sharding.shard_digests(docs, law="bytes").collect():
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(v - mean) <= 900 for v in sizes.values())


def test_few_or_no_rows_and_unknown_law(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1, "x", 1) for i in range(3)], ODD)
    assert sorted((r.shard, r.slot) for r in sharding.shard_digests(docs).collect()) == [(0, 0), (2, 0), (5, 0)]
    for law in sharding.LAWS:
        assert sharding.shard_digests(docs.where("false"), law=law).collect() == []
    with pytest.raises(ValueError, match="law"):
        sharding.write_shards(docs, law="key")


def test_filters_skip_most_files(spark, tmp_path):
    """By the file statistics, a filter on any column reads fewer shards than where each shard holds some of everything."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, shards=32, path=str(tmp_path / "out"))
    spans = defaultdict(list)
    for top, _, names in os.walk(tmp_path / "out"):
        for name in names:
            if name.endswith(".parquet"):
                t = pq.read_table(os.path.join(top, name), columns=["lang", "source", "n_chars", "doc_id"])
                for c in t.column_names:
                    own = [v for v in t[c].to_pylist() if v is not None]
                    spans[c].append((min(own), max(own)))
    rows = docs.select("lang", "source", "n_chars", "doc_id").collect()
    for c in ("lang", "source", "n_chars", "doc_id"):
        values = sorted({r[c] for r in rows if r[c] is not None})
        touched = sum(sum(a <= v <= b for a, b in spans[c]) for v in values) / len(values) / len(spans[c])
        assert touched < 0.75, (c, touched)
