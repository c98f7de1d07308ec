"""Best-fit packing by non-negative least squares over length patterns.

Documents become token pieces in one Arrow pass. Only the histogram of piece lengths (at most
``max_len`` numbers) reaches the driver: patterns of few lengths that fill a sequence exactly are
fitted to it by non-negative least squares, rounded down, and what is left of the histogram is
packed best fit, longest first. The plan is a list of length patterns with counts; pieces find
their place by their rank among pieces of the same length, which is counted in groups of bounded size.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.batches import stretches
from tracewell.llm.storage import materialise

#: Encodings that a worker keeps over its tasks in each of two generations. Words that are learnt at once.
CACHE_WORDS, BATCH_WORDS = 500_000, 1_500_000
#: Pieces of one length that are ranked together.
RANKED = 500_000


class WordIds:
    """Little-endian 32-bit ids of white-space separated words. No token spans white space.

    Words that differ in ASCII case or in one comma or full stop after a letter share an encoding: the
    tokenizer lower-cases, and cuts between letters and signs. Words with the literal of a special token, in any
    case, are encoded as they stand: the literal is one id where it is spelled exactly. Encodings are kept; when they are many, they
    become the older generation, from which those in use are taken over and the others go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.begin = os.path.commonprefix(self.special)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails = {sign: self._encoded([sign])[0] for sign in (",", ".")}

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of words, encoded as one text and cut where words begin."""
        found = self.tokenizer.encode_batch([" ".join(words)], add_special_tokens=False)[0]
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        at = np.searchsorted([start for start, _ in found.offsets], begins)
        ids = array("I", found.ids).tobytes()
        return [ids[4 * i : 4 * j] for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]

    def ids(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each of ``words``."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        names, joined = list(words), " ".join(words)
        if not names:
            return {}
        if joined.isascii():
            cores = joined.lower().split(" ")
        else:
            cores = [w.lower() if w.isascii() else w for w in names]
        if self.begin in joined.lower():
            cores = [w if any(t in w.lower() for t in self.special) else core for w, core in zip(names, cores, strict=True)]
        # a comma or full stop after a letter has ids of its own
        signs = {i: c[-1] for i, c in enumerate(cores) if c.endswith((",", ".")) and c[-2:-1].lower().isalpha()}
        for i in signs:
            cores[i] = cores[i][:-1]
        learnt = []
        for core in set(cores):
            if core not in known:
                if (found := older.get(core)) is None:
                    learnt.append(core)
                else:
                    known[core] = found
        for at in range(0, len(learnt), 500):
            known.update(zip(learnt[at : at + 500], self._encoded(learnt[at : at + 500]), strict=True))
        out = list(map(known.__getitem__, cores))
        for i, sign in signs.items():
            out[i] += self.tails[sign]
        return dict(zip(names, out, strict=True))

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Ids of whole texts, each with ``end`` after it."""
        words, last = [t.replace("\n", " ").split(" ") for t in texts], array("I", [end]).tobytes()
        if sum(map(len, words)) <= BATCH_WORDS:
            found = self.ids(set().union(*words))
            return [b"".join([*map(found.__getitem__, own), last]) for own in words]
        out = []
        for own in words:
            parts = []
            for at in range(0, len(own), BATCH_WORDS):
                found = self.ids(set(own[at : at + BATCH_WORDS]))
                parts += map(found.__getitem__, own[at : at + BATCH_WORDS])
            out.append(b"".join([*parts, last]))
        return out


@cache
def known_words(path: str) -> WordIds:
    """One cache a worker process, which Spark reuses for many tasks."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text, then ``end_id``, cut every ``max_len``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(tokenizer_path)
        for batch in batches:
            out = defaultdict(list)
            for at, texts in stretches(batch.column(1)):
                for doc_id, raw in zip(batch.column(0).slice(at, len(texts)).to_pylist(), known.encode(texts, end_id), strict=True):
                    for piece, start in enumerate(range(0, len(raw) // 4, max_len)):
                        own = raw[4 * start : 4 * (start + max_len)]
                        for k, v in zip(names, (doc_id, piece, start, len(own) // 4, zlib.crc32(own)), strict=True):
                            out[k].append(v)
            yield pa.record_batch([pa.array(out[k], kind) for k, kind in names.items()], names=list(names))

    names = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(kernel, "doc_id long, piece int, start long, length long, ids_crc32 long")


def length_patterns(counts: dict[int, int], max_len: int, most: int = 6000) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths with rows that fill ``max_len`` exactly, longest length first."""
    there = sorted((n for n in counts if counts[n]), reverse=True)
    known, found = set(there), dict.fromkeys([(max_len,)] if max_len in counts else [])
    for a in there:
        if (b := max_len - a) in known and b <= a:
            found[a, b] = None
    for few in (3, 4):
        # spread over the histogram: every length in turn leads some patterns
        budget = most * (few - 1) // 4
        for step in range(1, len(there)):
            for i, a in enumerate(there):
                if len(found) >= budget:
                    break
                b = there[(i + step) % len(there)]
                rest = max_len - a - b
                if rest <= 0 or b > a:
                    continue
                if few == 3:
                    if rest in known and rest <= b:
                        found[a, b, rest] = None
                elif (half := rest // 2) in known and rest - half in known and rest - half <= b:
                    found[a, b, rest - half, half] = None
            if len(found) >= budget:
                break
    return list(found)


def fit_patterns(patterns: list[tuple[int, ...]], counts: dict[int, int], max_len: int, sweeps: int = 60) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|^2 by coordinate descent; column j of A has the lengths of pattern j."""
    residual = [float(counts.get(n, 0)) for n in range(max_len + 1)]
    x = [0.0] * len(patterns)
    columns = [[(n, p.count(n)) for n in dict.fromkeys(p)] for p in patterns]
    norms = [sum(c * c for _, c in col) for col in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            step = max(-x[j], sum(residual[n] * c for n, c in col) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, c in col:
                    residual[n] -= step * c
        if moved < 0.25:
            break
    return np.array(x)


def best_fit(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over a histogram: (lengths of a sequence, how many such sequences)."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = next((r for r in range(n, max_len) if open_bins.get(r)), None)
            if room is None:
                fit = max_len // n
                whole, rest = divmod(left, fit)
                for size, times in ((fit, whole), (rest, 1)):
                    if size and times:
                        open_bins[max_len - size * n].append(((n,) * size, times))
                left = 0
            else:
                lengths, times = open_bins[room].pop()
                used = min(times, left)
                if times > used:
                    open_bins[room].append((lengths, times - used))
                open_bins[room - n].append(((*lengths, n), used))
                left -= used
    return [x for bins in open_bins.values() for x in bins]


def plan_sequences(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Fitted patterns rounded down, then the rest of the histogram best fit."""
    patterns, left = length_patterns(counts, max_len), dict(counts)
    plan = []
    for p, x in zip(patterns, fit_patterns(patterns, counts, max_len), strict=True):
        if times := min([int(x + 1e-9), *(left[n] // p.count(n) for n in p)]):
            plan.append((p, times))
            for n in p:
                left[n] -= times
    return plan + best_fit({n: c for n, c in left.items() if c}, max_len)


def _runs(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from one row's first to the next row's are its own."""
    used, base, rows = defaultdict(int), 0, []
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], base, offset))
            used[n] += times
            offset += n
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    A null or empty text is the one id ``end_id``. Repeated rows are packed as often as they come.
    An empty table gives no rows. Columns other than doc_id and text are ignored; a null doc_id is
    packed like any other. Very long texts are read whole; pieces of one length are interchangeable, and go in the order of a hash, doc_id and piece. Sequence ids are dense from 0, offsets gapless from 0.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer_path, max_len, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    # a length's pieces are ranked in as many parts as they fill; both small tables have a row a length, or a part
    parts = spark.createDataFrame([(n, -(-c // RANKED)) for n, c in counts.items()], "length long, parts long")
    salted = pieces.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("rank", within - 1).join(F.broadcast(first), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))
    runs = spark.sparkContext.broadcast(_runs(plan_sequences(counts, max_len)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(keys) else table
            where = [pa.array(row[:, 2] + rank - row[:, 1], pa.int64()), pa.array(row[:, 3], pa.int64())]
            yield pa.record_batch([*batch.columns[:5], *where], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
