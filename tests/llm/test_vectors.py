"""Vector codes and whitening against plain versions in whole numbers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tracewell.llm import codes, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int"
BAD = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 8, 1), (903, [1.0, None] * 4, 1), (904, [float("inf")] * 8, 1)]


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(codes, error) by row, and the codebooks, all distances computed in Python's whole numbers."""
    xs = [[math.floor(1024 * c) for c in v] for _, v, _ in rows]
    w = len(xs[0]) // parts
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, xs[i]))[:entries]
    book = [[xs[i][p * w : p * w + w] for i in first] for p in range(parts)]

    def nearest(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x[p * w : p * w + w], e)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for x in xs:
            for p in range(parts):
                held[p][nearest(x, p)[1]].append(x[p * w : p * w + w])
        book = [[[sum(c) // len(held[p][k]) for c in zip(*held[p][k])] if held[p][k] else e for k, e in enumerate(book[p])] for p in range(parts)]
    found = [[nearest(x, p) for p in range(parts)] for x in xs]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], book


def vectors(n, width=8, seed=1, scale=0.3):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=width) * scale).tolist(), i % 3 or None) for i in range(n)]


@pytest.mark.parametrize("n", [1, 40, 330])
def test_codes_equal_brute_force(spark, n):
    rows = vectors(n)
    rows += [rows[0]] * 5 + [(None, rows[-1][1], None), (-7, [0.0] * 8, 1), (3, [-1e-9] * 8, 2)]
    table = spark.createDataFrame([*rows, *BAD], KIND).selectExpr("*", "1 as x", "2 as error", "'c' as codes", "3 as `of`")
    got = codes.code_digests(table).collect()
    want, book = plain_codes(rows)
    errors = defaultdict(int)
    for (_, _, label), (_, e) in zip(rows, want):
        errors[label] += e
    digest = hashlib.sha256(",".join(str(c) for part in book for e in part for c in e).encode()).hexdigest()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, c, e, errors[label], digest) for (i, _, label), (c, e) in zip(rows, want)), key=key)


def test_bounds_never_exceed_a_distance():
    """Nearest entries equal those of a full scan where norms, means and residuals are far apart, equal or zero."""
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 16):
        for scale in (1, 50, 2**20):
            entries = np.concatenate([rng.integers(-scale, scale + 1, (60, width)), np.repeat(rng.integers(-scale, scale + 1, (20, 1)), width, axis=1), np.zeros((2, width), int)])
            rows = np.concatenate([rng.integers(-scale, scale + 1, (300, width)), entries[::3], entries[::2] + 1, np.full((1, width), 2**25)])
            far = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
            index, least, _ = codes.Codebook(entries).nearest(rows)
            assert (index == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_bounds_save_most_distances():
    rng = np.random.default_rng(6)
    centres = rng.integers(-2000, 2000, (256, 16))
    rows = centres[rng.integers(0, 256, 2000)] + rng.integers(-60, 60, (2000, 16))
    assert codes.Codebook(centres).nearest(rows)[2] < 0.05 * 2000 * 256


def test_codes_decode_to_their_entries(spark):
    rows = vectors(50)
    got, book = codes.compress(spark.createDataFrame(rows, KIND), entries=8)
    whole = {r[0]: np.floor(np.array(r[1]) * 1024) for r in rows}
    for r in codes.decoded(got, book).collect():
        assert ((np.array(r.x) - whole[r.vec_id]) ** 2).sum() == r.error


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert codes.code_digests(empty).collect() == [] == codes.code_digests(spark.createDataFrame(BAD, KIND)).collect()
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 6, 0)], KIND))
    with pytest.raises(Exception, match="65,536"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, 0)], KIND))
    # the commonest length takes part
    assert codes.compress(spark.createDataFrame([*vectors(5), (77, [1.0] * 4, 0)], KIND))[0].count() == 5


def plain_whitening(rows, components=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1).tolist()
    # whole numbers until the last division
    apart = (n * x - s).astype(object)
    cov = np.array((apart.T @ apart), dtype=object)
    cov = np.array([[float(c) / float(n) ** 3 for c in row] for row in cov])
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    return n, deviation, (apart / n).astype(float) @ vector / np.sqrt(value), value / np.trace(cov)


def check_whitening(got, rows, least=1e-9):
    n, deviation, whitened, share = plain_whitening(rows)
    assert len(got) == len(rows) * len(share) and {r.n for r in got} == {n}
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    for k, own in by.items():
        mine = sorted((r.vec_id, r.deviation, round(r.whitened, 6) + 0.0) for r in own)
        ways = [sorted((row[0], d, round(sign * w, 6) + 0.0) for row, d, w in zip(rows, deviation, whitened[:, k - 1].tolist())) for sign in (1, -1)]
        assert any(all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(mine, way)) for way in ways), k
        assert all(abs(r.explained - share[k - 1]) < 1e-9 and r.identity_error < least for r in own)


def test_whitening_equals_whole_number_moments(spark):
    rows = [(i, (np.array(v) * [9, 7, 5, 4, 3, 2, 1.5, 1, 0.5]).tolist(), label) for i, v, label in vectors(400, 9)]
    rows += [rows[3]] * 4
    table = spark.createDataFrame([*rows, *BAD], KIND).repartition(7).selectExpr("*", "1 as x", "2 as n", "3 as component")
    check_whitening(whitening.whitening_rows(table).collect(), rows)


def test_whitening_of_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding], r.label) for r in table.collect()]
    check_whitening(whitening.whitening_rows(table).collect(), rows)


def test_merge_is_that_of_all_rows():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2000, (999, 5)) + 10**9
    parts = [whitening.Moments.of(p) for p in np.array_split(rows, [1, 2, 50, 700])]
    whole, merged = whitening.Moments.of(rows), parts[0]
    for p in parts[1:]:
        merged = merged.merged(p)
    assert merged.n == 999 and (merged.total == whole.total).all()
    assert np.allclose(merged.scatter, whole.scatter, rtol=1e-9, atol=1) and np.allclose(merged.mean, whole.mean, rtol=1e-15)


def test_whitening_of_odd_tables(spark):
    assert whitening.whitening_rows(spark.createDataFrame(BAD, KIND)).collect() == []
    one = whitening.whitening_rows(spark.createDataFrame([(1, [0.5] * 3, 0)] * 2, KIND)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 2, 0, None, None, None) for k in (1, 2, 3)] * 2
    flat = whitening.whitening_rows(spark.createDataFrame([(i, [i / 8, 1.0, i / 4], 0) for i in range(5)], KIND)).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in flat)
    few = whitening.Whitening(10**7, np.array([10**12]), np.ones((1, 1)), np.ones(1))
    assert few.deviation(np.array([[10**5]])) == [0] and few.deviation(np.array([[5 * 10**5]])) == [None]
