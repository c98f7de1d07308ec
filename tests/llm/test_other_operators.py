"""WARC, neighbours and media against brute force."""

import base64
import hashlib
from collections import Counter

import numpy as np

from tracewell.llm import neighbours, warc

TRICK = "x" * 300 + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\nfoo" + "y" * 1000 + "WARC/1.0\r\n" * 3


def test_warc_round_trip_over_small_splits(spark):
    rows = [(i, f"http://e/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(101, None, None), (102, "a b\r\n", ""), (103, "u", TRICK), (104, "u", TRICK), (105, "u", TRICK + "z" * 50_000), (106, None, "WARC/1.0\r\n"), (None, "x", "qq"), (107, "x", "qq"), (107, "x", "qq"), (108, "ü", "日本")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "'p' as payload").coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    last, want = {}, Counter()
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    for i, _, h in rows:
        raw, again = (h or "").encode(), i is None or i < last[h or ""]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None] += 1
    assert got == want


def test_warc_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert {r.page_id for r in warc.round_trip(pages, min_bytes=5).where("record_type = 'revisit'").collect()} == {3}
    assert warc.round_trip(pages.where("false")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(900, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(m)]
    same = rng.normal(size=16).tolist()
    rows += [(1000 + i, same, 0) for i in range(60)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] + [1.0] * 15, 0), (2060, [1.0, None], 0), (2080, [], 0), (2100, [1.0, 2.0], 0), (None, same, 0), (7, m[7].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as v", "2 as leaf", "3 as rank")
    got: dict = {}
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.array([*range(900), *range(1000, 1060)])
    vectors = np.array([*m, *[same] * 60])
    # lengths are searched apart, and 2100 is alone in its own
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        score = vectors @ vectors[np.flatnonzero(ids == q)[0]]
        order = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert len(found) == 20 and len({v for v, _ in found}) == 20
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-9 for v, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hit += len({v for v, _ in found} & set(order))
    assert hit >= 0.9 * 20 * len(got)
    # copies: ties go to the smaller ids
    copies = [v for v, _ in got[1000] if v >= 1000]
    assert copies == list(range(1001, 1001 + len(copies)))
    assert neighbours.nearest(table.where("false")).count() == 0


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(table).collect()} == {(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)}




def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32)) * 4
    m = np.concatenate([c + rng.normal(size=(120, 32)) * 0.4 for c in centres])
    forest = neighbours.Forest(m.astype(np.float32), len(m), 8)
    share = neighbours.enough_share(forest, m, 20)
    counts = np.bincount(forest.route(m.astype(np.float32)).ravel(), minlength=forest.leaves * 8)
    leaf = forest.route(m.astype(np.float32))
    hit = scored = 0
    for q in range(0, len(m), 97):
        opened = forest.search(m[q].astype(np.float32), counts, int(share * len(m)))
        there = np.flatnonzero(np.isin(leaf, opened).any(axis=1))
        scored += counts[opened].sum()
        score = m @ m[q]
        best = set(np.argsort(-score)[:20].tolist())
        hit += len(best & set(there.tolist()))
    asked = len(range(0, len(m), 97))
    # well under half of the vectors are scored, all copies in all trees counted
    assert hit >= 0.9 * 20 * asked and scored < 0.5 * asked * len(m)


def test_vectors_of_several_lengths(spark):
    rows = [(i, [1.0 + i, 2.0]) for i in range(30)] + [(100 + i, [1.0, 2.0, 3.0 + i]) for i in range(30)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert {r.query_id for r in got} == {0, 20, 100, 120} and all((r.query_id < 100) == (r.vec_id < 100) for r in got)


def test_recall_on_the_given_table(spark):
    """At least 0.9 of the true nearest, and exact scores, on the vectors of a given table."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids = np.array(sorted(rows))
    m = np.array([rows[i] for i in ids])
    found = {}
    for r in neighbours.nearest(table).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        score = m @ rows[q]
        best = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hit, total = hit + len(set(best) & set(found[q])), total + len(best)
        assert all(abs(s - rows[q] @ rows[v]) < 1e-9 for v, s in found[q].items())
    assert len(found) == np.count_nonzero(ids % 20 == 0) and hit >= 0.9 * total


def test_where_no_share_is_enough_all_are_compared(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(18, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(table, k=5, every=3).collect()}
    assert got == {(q, int(i)) for q in range(0, 18, 3) for i in [x for x in np.argsort(-(m @ m[q]), kind="stable") if x != q][:5]}
    assert neighbours.enough_share(neighbours.Forest(m.astype(np.float32), 18, 2), m, 20) is None
