"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into words that no piece crosses. The lattice of a word has an edge for each
substring of bounded length that is in the piece table, and a fold over it picks the path. Models of
the unigram kind take the path of highest score (Viterbi). For those of the BPE kind such a path is not
what the model means, so there the fold replays the merges on the same edges, best score first.

``encode`` holds the lattices of a batch's distinct words as arrays, a column a
substring length, and joins and folds them there. ``encode_words`` is the relational form: exploded
substrings, an equi-join to the piece table, edges grouped by word, and a higher-order ``aggregate``.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.batches import stretches

SPACE = "▁"
WORD = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Words of up to this many characters are folded in arrays, longer ones one by one; encoded words that a worker keeps over its tasks.
ARRAY_CHARS, CACHE_WORDS = 24, 1_000_000
NONE = np.int32(2**31 - 1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """The pieces of a SentencePiece model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    is_bpe: bool

    @classmethod
    def read(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        own = cls([p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces], proto.trainer_spec.model_type == 2)
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(own.pieces, own.kinds, strict=True) if k == 1):
            raise ValueError("a piece crosses words")
        return own

    def __post_init__(self) -> None:
        normal = [i for i, k in enumerate(self.kinds) if k == 1]
        self.ids = {self.pieces[i]: i for i in normal}
        self.raw = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0
        self.longest = max((len(p) for p in self.ids), default=1)
        # the order in which merges are made: the best score first
        order = sorted(normal, key=lambda i: -self.scores[i])
        self.rank = {}
        for i in order:
            at = len(self.rank)
            self.rank[i] = self.rank[order[at - 1]] if at and self.scores[order[at - 1]] == self.scores[i] else at
        self.output = [bytes([int(p[1:-1], 16)]) if k == 6 else b"" if k == 3 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        hashes = np.array([_hash(self.pieces[i]) for i in normal], np.uint64)
        at = np.argsort(hashes)
        self.hashes, self.hashed_ids = hashes[at], np.array(normal, np.int64)[at]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.rank_of = np.array([self.rank[i] for i in self.hashed_ids.tolist()], np.int32)
        # first place of each leading 16 bits
        self.starts = np.searchsorted(self.hashes, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))

    def spelled(self, symbol: str) -> list[int]:
        """Ids of a symbol: its piece, else its bytes, else unknown."""
        if (i := self.ids.get(symbol)) is not None:
            return [i]
        return [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")] if len(self.bytes) == 256 else [self.unknown]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Merge rank of each hashed substring, NONE where it is no piece."""
        out, at = np.full(hashes.shape, NONE, np.int32), self.starts[(hashes >> np.uint64(48)).astype(np.int64)]
        todo = np.flatnonzero(at < len(self.hashes))
        flat, place, to = hashes.ravel()[todo], at.ravel()[todo], out.reshape(-1)
        while len(todo):
            there = self.hashes[place]
            hit = there == flat
            to[todo[hit]] = self.rank_of[place[hit]]
            on = (there < flat) & (place + 1 < len(self.hashes))
            todo, flat, place = todo[on], flat[on], place[on] + 1
        return out


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(FACTOR) + ord(c) + 1) % (1 << 64)
    return h


def merge_cuts(words: list[str], model: Model) -> list[np.ndarray]:
    """Symbol starts of words of one length, by replaying the merges on all their lattices at once."""
    n = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64) + np.uint64(1)
    longest = min(n, model.longest)
    edge = np.full((longest + 1, len(words), n), NONE, np.int32)
    h = codes.copy()
    for size in range(2, longest + 1):
        h = h[:, :-1] * FACTOR + codes[:, size - 1 :]
        edge[size, :, : n - size + 1] = model.lookup(h)
    flat, plane = edge.ravel(), len(words) * n
    end = np.tile(np.append(np.arange(1, n + 1), n), (len(words), 1))
    alive = np.ones((len(words), n + 1), bool)
    alive[:, n] = False
    todo, at = np.arange(len(words)), np.arange(n)
    while len(todo):
        own_end = end[todo]
        after = np.take_along_axis(own_end, own_end[:, :n], 1)
        size = after - at
        fits = alive[todo][:, :n] & (own_end[:, :n] < n) & (size <= longest)
        # size 0 has no edges
        rank = flat[np.where(fits, size, 0) * plane + todo[:, None] * n + at]
        best = rank.argmin(axis=1)
        more = rank[np.arange(len(todo)), best] < NONE
        row, best = todo[more], best[more]
        alive[row, end[row, best]] = False
        end[row, best] = after[more, best]
        todo = row
    return [np.flatnonzero(a) for a in alive]


def merge_one(word: str, model: Model) -> list[int]:
    """The same for one word of any length, with a queue."""
    n, ids, rank = len(word), model.ids, model.rank
    end, start_of, queue = list(range(1, n + 1)), {i + 1: i for i in range(n)}, []

    def offer(i: int) -> None:
        if (j := end[i]) < n and end[j] - i <= model.longest and (p := ids.get(word[i : end[j]])) is not None:
            heapq.heappush(queue, (rank[p], i, j, end[j]))

    for i in range(n):
        offer(i)
    while queue:
        _, i, j, k = heapq.heappop(queue)
        if start_of.get(j) == i and end[i] == j and start_of.get(k) == j and end[j] == k:
            end[i], start_of[k] = k, i
            del start_of[j]
            offer(i)
            if i in start_of:
                offer(start_of[i])
    return sorted(start_of.values())


def viterbi_one(word: str, model: Model) -> list[int]:
    """Symbol starts of the path of highest score; uncovered characters cost more than any piece."""
    low = min(model.scores, default=0.0) - 10.0
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        options = [(best[j - 1][0] + low, j - 1)]
        for i in range(max(0, j - model.longest), j):
            if (p := model.ids.get(word[i:j])) is not None:
                options.append((best[i][0] + model.scores[p], i))
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    cuts, j = [], len(word)
    while j:
        j = best[j][1]
        cuts.append(j)
    return cuts[::-1]


class WordPieces(dict):
    """Little-endian ids of words, each encoded once."""

    def __init__(self, model: Model):
        self.model = model

    def learn(self, words: set[str]) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in words:
            if w not in self:
                by_length[len(w) if self.model.is_bpe and len(w) <= ARRAY_CHARS else 0].append(w)
        fold = merge_one if self.model.is_bpe else viterbi_one
        for n, own in by_length.items():
            for at in range(0, len(own), 2048):
                part = own[at : at + 2048]
                for w, cuts in zip(part, [c.tolist() for c in merge_cuts(part, self.model)] if n else [fold(w, self.model) for w in part], strict=True):
                    self[w] = self.spell(w, cuts)

    def spell(self, word: str, cuts: list[int]) -> bytes:
        out = [self.model.raw.get(word[a:b]) for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]
        if None in out:
            out = [x or np.array(self.model.spelled(word[a:b]), "<u4").tobytes() for x, a, b in zip(out, cuts, [*cuts[1:], len(word)], strict=True)]
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each after a dummy space; words are learnt together."""
        words = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        for own, to in zip(words, out, strict=True):
            if len(own) > CACHE_WORDS:
                for at in range(0, len(own), CACHE_WORDS):
                    self.learn(set(own[at : at + CACHE_WORDS]))
                    to += map(self.__getitem__, own[at : at + CACHE_WORDS])
        few = [(own, to) for own, to in zip(words, out, strict=True) if len(own) <= CACHE_WORDS]
        self.learn(set().union(*(own for own, _ in few)))
        for own, to in few:
            to += map(self.__getitem__, own)
        return [b"".join(x) for x in out]


@cache
def known_words(path: str) -> WordPieces:
    """One cache a worker process, which Spark reuses for many tasks."""
    return WordPieces(Model.read(path))


def decode_ids(ids: list[int], model: Model) -> str:
    """Text of ids; bytes that are no UTF-8 become U+FFFD, the dummy space goes."""
    return b"".join(map(model.output.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, ids_crc32, round_trip) for each row of ``docs`` (doc_id, text).

    ids are those of the model's own library. round_trip: decoding them gives the text back, which holds
    unless it has U+2581 or broken characters. A null or empty text has no ids and round-trips.
    Repeated rows give repeated rows, an empty table gives none, other columns are ignored. Very long texts are read whole;
    of merges with equal scores the leftmost is made first.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(model_path)
        model = known.model
        for batch in batches:
            for at, texts in stretches(batch.column(1)):
                part, raw = batch.slice(at, len(texts)), known.encode(texts)
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in raw]
                crc = [zlib.crc32(x) for x in raw]
                same = [decode_ids(x.tolist(), model) == t for x, t in zip(ids, texts, strict=True)]
                offsets = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.record_batch([part.column(0), lists, pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(kernel, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.read(model_path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([None if x.as_py() is None else decode_ids(x.as_py(), model) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(kernel, "doc_id long, text string")


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, pieces array<string>) of the distinct ``word`` values: the lattice as relations.

    For BPE models the fold replays merges: each step drops the boundary inside the best edge that
    spans just two symbols. For others it keeps the best score and cut of each end (Viterbi).
    """
    spark: SparkSession = words.sparkSession
    rows = [(p, float(model.scores[i])) for p, i in model.ids.items()]
    # as many rows as the model has pieces
    table = F.broadcast(spark.createDataFrame(rows, "piece string, score double"))
    own = words.select("word").where("word is not null and word <> ''").distinct()
    starts = own.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("a"))
    spans = starts.select("word", "a", F.explode(F.sequence(F.col("a") + 1, F.least(F.length("word"), F.col("a") + model.longest))).alias("b"))
    edges = spans.withColumn("piece", F.expr("substring(word, a + 1, b - a)")).join(table, "piece")
    grouped = own.join(edges.groupBy("word").agg(F.collect_list(F.struct("score", "a", "b")).alias("e")), "word", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<score:double,a:int,b:int>>")))
    if model.is_bpe:
        fold = """aggregate(sequence(1, length(word)), sequence(0, length(word)), (cut, step) ->
            filter(cut, x -> not coalesce(exists(array(array_max(transform(filter(e, y -> array_contains(cut, y.a) and array_contains(cut, y.b)
                and size(filter(cut, z -> z > y.a and z < y.b)) = 1), y -> struct(y.score as s, -y.a as a, y.b as b)))), m -> x > -m.a and x < m.b), false)))"""
    else:
        low = min(model.scores, default=0.0) - 10.0
        fold = f"""reverse(aggregate(sequence(1, length(word)), array(struct(0D as s, array(0) as c)), (best, j) -> concat(best, array(array_max(
            concat(array(struct(best[j - 1].s + {low}D as s, concat(array(j), best[j - 1].c) as c)),
            transform(filter(e, y -> y.b = j), y -> struct(best[y.a].s + y.score as s, concat(array(j), best[y.a].c) as c)))))))[length(word)].c)"""
    cut = grouped.select("word", F.expr(fold).alias("cut"))
    return cut.select("word", F.expr("transform(slice(cut, 1, size(cut) - 1), (x, i) -> substring(word, x + 1, cut[i + 1] - x))").alias("pieces"))
