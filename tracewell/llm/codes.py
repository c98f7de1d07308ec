"""Vector code compression: product codes whose nearest entries are found through segment-mean lower bounds.

A vector is cut into parts and each part replaced by the index of its nearest codebook entry. For a part and an entry, cut alike into blocks,
the squared distance is at least the sum over blocks of (difference of sums)² / length, plus the squared difference of what
the norms leave over once the blocks' means are taken out. One block is coarse and cheap, more are finer. Entries whose bound exceeds an exact
distance already known are out; those that survive the finest bound get exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.storage import materialise
from tracewell.llm.vectors import matrix, scaled_vectors

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Blocks of a part at each level of the bounds; rows that are worked on at once.
LEVELS, ROWS = (1, 2, 4, 8), 1024
#: Bounds are lowered by a share of both squared norms and a constant, more than what the rounding of doubles can add to them: a residual norm
#: near zero is off by up to 1e-8 of its vector's norm.
RELATIVE, ABSOLUTE = 1e-7, 1e-3


class Codebook:
    """The entries of one part, with their block sums and residual norms at each level."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        width = entries.shape[1]
        self.cuts = [np.unique(np.linspace(0, width, min(blocks, width) + 1).astype(int)) for blocks in LEVELS]
        self.levels = [self._sketch(self.entries, cut) for cut in self.cuts]
        self.norms = (self.entries * self.entries).sum(axis=1)

    @staticmethod
    def _sketch(rows: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block sums over the root of the block's length, norm of the rest), one row each."""
        sums = np.add.reduceat(rows, cut[:-1], axis=1)
        scaled = sums / np.sqrt(np.diff(cut))
        rest = (rows * rows).sum(axis=1) - (scaled * scaled).sum(axis=1)
        return scaled, np.sqrt(np.maximum(rest, 0.0))

    @staticmethod
    def _lowest(r: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """For each row the place of its least value, the first of equal ones; ``r``, the row of each value, ascends and leaves none out."""
        if not rows:
            return np.zeros(0, int)
        least = np.minimum.reduceat(value, np.searchsorted(r, np.arange(rows)))
        hits = np.flatnonzero(value == least[r])
        return hits[np.unique(r[hits], return_index=True)[1]]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of the nearest entry of each row, ties to the lower index; how many distances were computed."""
        slack = ABSOLUTE + RELATIVE * np.add.outer((rows * rows).sum(axis=1), self.norms).astype(float)
        known, open_ = np.full(len(rows), np.inf), None
        for cut, (of, left) in zip(self.cuts, self.levels, strict=True):
            sums, rest = self._sketch(rows, cut)
            # sum of squared differences of block sums and of residual norms, as one product of matrices
            mine, theirs = np.column_stack([sums, rest]), np.column_stack([of, left])
            bound = np.add.outer((mine * mine).sum(axis=1), (theirs * theirs).sum(axis=1)) - 2 * mine @ theirs.T - slack
            # the entry of least bound is as a rule near: its distance tightens what is known
            guess = bound.argmin(axis=1)
            known = np.minimum(known, ((rows - self.entries[guess]) ** 2).sum(axis=1))
            fits = bound <= known[:, None]
            open_ = fits if open_ is None else open_ & fits
        r, e = np.nonzero(open_)
        exact = ((rows[r] - self.entries[e]) ** 2).sum(axis=1)
        best = self._lowest(r, exact, len(rows))
        return e[best], exact[best], len(exact)


def _assigned(batch: pa.RecordBatch, books: list[Codebook]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, vectors, indices (row, part), squared distances (row, part)) of a batch, some rows at a time."""
    rows = matrix(batch.column(batch.schema.get_field_index("x")))
    for at in range(0, len(rows), ROWS):
        own = rows[at : at + ROWS]
        found = [book.nearest(part) for book, part in zip(books, np.split(own, len(books), axis=1), strict=True)]
        yield at, own, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(points: DataFrame, entries: np.ndarray) -> list:
    """(part, entry, n, sums of components) of what is nearest to each entry; ``entries`` is (part, entry, component).

    A task sends one row for each part and entry it has met.
    """
    parts, many, width = entries.shape

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        n, sums = np.zeros((parts, many), np.int64), np.zeros((parts, many, width), np.int64)
        for batch in batches:
            for _, own, index, _ in _assigned(batch, books):
                for p, part in enumerate(np.split(own, parts, axis=1)):
                    n[p] += np.bincount(index[:, p], minlength=many)
                    np.add.at(sums[p], index[:, p], part)
        p, e = np.nonzero(n)
        yield pa.record_batch([pa.array(p), pa.array(e), pa.array(n[p, e]), *(pa.array(sums[p, e, i]) for i in range(width))], names=names)

    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]
    partial = points.select("x").mapInArrow(kernel, ", ".join(f"{c} long" for c in names))
    return partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect()


def learned(points: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, component) over all ``points`` (vec_id, x), which start at those of the smallest ids.

    The driver holds the codebooks and, for each round, one row of sums for each entry.
    """
    first = points.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    book = np.array([r["x"] for r in first], np.int64)
    if book.shape[-1] % parts:
        raise ValueError(f"vectors of {book.shape[-1]} components can't be cut into {parts} equal parts")
    book = np.stack(np.split(book, parts, axis=1))
    for _ in range(rounds):
        means = book.copy()
        for r in _sums(points, book):
            means[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(book.shape[2])]
        book = means
    return book


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, codes array<int>, error), codebooks) of the ``embeddings`` rows with a whole vector.

    Rows whose vector is null, empty or holds null or non-finite components are dropped; ``scaled_vectors`` says what is done with other lengths
    and with very large components. Repeated rows are rows, in the fit too. A null vec_id comes after all others; rows of one id are ordered by their
    vectors. Ties of distances go to the lower index. With fewer rows than ``entries`` there are as many entries as rows; an empty
    table gives no rows and no codebooks. Null labels are kept; other columns are ignored.
    """
    points = materialise(scaled_vectors(table, "label"), "points")
    kind = T.StructType([points.schema["vec_id"], points.schema["label"]]).add("codes", T.ArrayType(T.IntegerType())).add("error", "long")
    if points.isEmpty():
        return table.sparkSession.createDataFrame([], kind), np.zeros((parts, 0, 0), np.int64)
    book = learned(points, parts, entries, rounds)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in book]
        for batch in batches:
            for at, own, index, far in _assigned(batch, books):
                flat = pa.array(index.astype(np.int32).ravel())
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(books)), flat)
                yield pa.record_batch([batch.column(0).slice(at, len(own)), batch.column(1).slice(at, len(own)), codes, pa.array(far.sum(axis=1))], names=["vec_id", "label", "codes", "error"])

    return materialise(points.select("vec_id", "label", "x").mapInArrow(kernel, kind), "codes"), book


def decoded(codes: DataFrame, book: np.ndarray) -> DataFrame:
    """``codes`` with ``x``, the entries that stand for each vector, put together."""
    entries = [F.lit([[int(c) for c in e] for e in part]) for part in book]
    return codes.withColumn("x", F.flatten(F.array(*[F.get(e, F.col("codes")[p]) for p, e in enumerate(entries)])))


def code_digests(table: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row; all cases as in ``compress``. Null labels are one label.

    Errors of a label are added in each task first, so a hot label is one row a task.
    """
    codes, book = compress(table)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    spelled = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", spelled.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """The statement of ``code_digests``; distances are of whole numbers, exact in doubles."""

    def nearest(k: int) -> str:
        far = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
        return f"a{k} AS MATERIALIZED (SELECT vec_id, label, part, v, min({{'d': {far}, 'e': entry}}) AS best FROM parts JOIN c{k} USING (part) GROUP BY ALL)"

    steps = []
    for k in range(rounds):
        steps.append(nearest(k))
        steps.append(
            f"m{k} AS (SELECT part, entry, list(floor(s / n) ORDER BY i) AS c FROM (SELECT part, best.e AS entry, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT part, best, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL), "
            f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry))"
        )
    return f"""
WITH kept AS (SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // {PARTS}) + 1:(part + 1) * (len(x) // {PARTS})] AS v FROM kept, range(0, {PARTS}) r(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{", ".join(steps)}, {nearest(rounds)},
digest AS (SELECT sha256(string_agg(array_to_string([y::BIGINT FOR y IN c], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""


SQL = _sql()
