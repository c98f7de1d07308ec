"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of any 9 successive five-word hashes the least, so equal 13-word
passages share one. Anchors that several documents hold are extended both ways to all 13-word windows around
them, and a window's words go from every document but that of least id. Overlapping windows make
maximal repeats. Texts are dealt once into groups of a few MB; all that leaves a group are its
distinct anchors and windows, packed by hash range, so a passage in a third of all documents
costs one entry a group, not one a document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_WORDS = 5
GROUP_BYTES, RANGE_BYTES = 4 << 20, 3 << 19
NO_ID = np.int64(2**63 - 1)
PACKED = "bucket long, grp long, base long, n long, data binary"
_RNG = np.random.default_rng(20240)
#: Odd factors of the word hashes of a seed (row 0) and a window (rows 1 and 2).
FACTORS = _RNG.integers(0, 2**63, (3, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Masks of the first 0 to 8 bytes.
BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 64


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed_words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in the bytes ``raw``, which end at white space and at ``breaks``.

    Words are taken in by eight bytes at a time, all words at once; those of over LONG_WORD bytes by XXH64.
    """
    solid = ~SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    eights = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    hashes = sizes.astype(np.uint64) * FACTORS[0, -1]
    for at in range(0, min(LONG_WORD, int(sizes.max(initial=0))), 8):
        more = np.flatnonzero(sizes > at) if at else slice(None)
        own = eights[starts[more] + at] & BYTES[np.minimum(sizes[more] - at, 8)]
        hashes[more] = spread((hashes[more] ^ own) * FACTORS[0, -2])
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + sizes[k]].tobytes())
    return starts, hashes


def runs(hashes: np.ndarray, size: int, row: int, starts: np.ndarray | None = None) -> np.ndarray:
    """A hash for each run of ``size`` word hashes; only for those at ``starts``, if given."""
    n = len(hashes) - size + 1
    total = np.zeros(n if starts is None else len(starts), np.uint64)
    for k in range(size):
        total += (hashes[k : k + n] if starts is None else hashes[starts + k]) * FACTORS[row, k]
    return spread(total)


def stretched(pick: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest (``pick`` np.minimum or np.maximum) of each ``width`` successive ones of ``x``, by stretches of doubled length."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x, span = pick(x[:-step], x[step:]), span + step
    return x


def winnowed(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a document of at least ``window`` words: all that are the least of a stretch that holds them."""
    grams = runs(hashes, SEED_WORDS, 0)
    width = window - SEED_WORDS + 1
    # the greatest of the leasts of the stretches around a place is its own hash just where it is the least of one
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(stretched(np.maximum, np.concatenate([edge, stretched(np.minimum, grams, width), edge]), width) == grams)
    return at, grams[at]


def _pack(arrays: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [("bucket", pa.int64()), ("grp", pa.int64()), ("base", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _by_range(group: int, keys: np.ndarray, arrays: list[np.ndarray], buckets: int) -> pa.Table:
    """Rows of packed stretches of sorted ``keys``, a row for each hash range that has any."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)] if len(keys) else [0]
    return _table([(int(bucket[a]), group, a, b - a, _pack([x[a:b] for x in arrays])) for a, b in zip(cuts, cuts[1:], strict=False)])


def _documents(table: pa.Table) -> Iterator[tuple[int | None, memoryview, np.ndarray]]:
    """(id, text in UTF-8, hashes of its words) of each row; a null text is empty."""
    text = pc.fill_null(table["text"].cast(pa.large_binary()), b"").combine_chunks()
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    starts, hashes = hashed_words(raw, ends)
    held, cuts = memoryview(raw), np.searchsorted(starts, ends).tolist()
    for k, doc_id in enumerate(table["doc_id"].to_pylist()):
        yield doc_id, held[ends[k] : ends[k + 1]], hashes[cuts[k] : cuts[k + 1]]


def _anchors(buckets: int, window: int):
    """Distinct anchors of a group, each with whether several of its documents hold it."""

    def kernel(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for _, _, hashes in _documents(table):
            if len(hashes) >= window:
                found.append(np.unique(winnowed(hashes, window)[1]))
        anchors, counts = np.unique(np.concatenate(found), return_counts=True)
        return _by_range(keys[0].as_py(), anchors, [anchors, (counts > 1).astype(np.uint8)], buckets)

    return kernel


def _by_group(groups: np.ndarray, arrays: list[np.ndarray], kind: int) -> pa.Table:
    order = np.argsort(groups, kind="stable")
    groups, arrays = groups[order], [a[order] for a in arrays]
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)] if len(groups) else [0]
    return _table([(kind, int(groups[a]), 0, b - a, _pack([x[a:b] for x in arrays])) for a, b in zip(cuts, cuts[1:], strict=False)])


def _gather(table: pa.Table, kinds: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(group, index in the group) and the arrays of all packed rows."""
    rows = [(g, b, n, _unpack(d, n, kinds)) for g, b, n, d in zip(*(table[c].to_pylist() for c in ("grp", "base", "n", "data")), strict=True)]
    groups = np.concatenate([np.full(n, g, np.int64) for g, _, n, _ in rows])
    index = np.concatenate([np.arange(b, b + n, dtype=np.int64) for _, b, n, _ in rows])
    return groups, index, [np.concatenate([r[3][k] for r in rows]) for k in range(len(kinds))]


def _seeds(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Anchors of one hash range that several documents hold, back to their groups."""
    groups, _, (anchors, several) = _gather(table, ["<u8", "u1"])
    _, inverse, counts = np.unique(anchors, return_inverse=True, return_counts=True)
    repeated = (counts > 1)[inverse] | (several > 0)
    return _by_group(groups[repeated], [anchors[repeated]], 0)


def _unpacked(table: pa.Table, kind: int, kinds: list[str]) -> list[np.ndarray]:
    rows = [(n, d) for b, n, d in zip(*(table[c].to_pylist() for c in ("bucket", "n", "data")), strict=True) if b == kind]
    parts = [_unpack(d, n, kinds) for n, d in rows]
    return [np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds)]


def _windows(table: pa.Table, seeds: np.ndarray, window: int):
    """Documents (id, text, number of words) with the starts and keys of their windows around seeds; distinct keys of the group; least id of each."""
    seeds, docs = np.sort(seeds), []
    key = np.dtype([("a", "<u8"), ("b", "<u4")])
    for doc_id, text, hashes in _documents(table):
        starts, own = np.zeros(0, np.int64), np.zeros(0, key)
        if len(hashes) >= window and len(seeds):
            at, anchors = winnowed(hashes, window)
            hit = at[seeds[np.minimum(np.searchsorted(seeds, anchors), len(seeds) - 1)] == anchors]
            if len(hit):
                near = np.zeros(len(hashes), bool)
                for k in range(window - SEED_WORDS + 1):
                    near[hit[np.searchsorted(hit, k) :] - k] = True
                starts = np.flatnonzero(near[: len(hashes) - window + 1])
                own = np.zeros(len(starts), key)
                own["a"], own["b"] = runs(hashes, window, 1, starts), runs(hashes, window, 2, starts).astype(np.uint32)
        docs.append((doc_id, text, len(hashes), starts, own))
    if not docs:
        return docs, np.zeros(0, key), np.zeros(0, np.int64), []
    every = np.concatenate([d[4] for d in docs])
    ids = np.concatenate([np.full(len(d[3]), NO_ID if d[0] is None else d[0], np.int64) for d in docs])
    order = np.lexsort((ids, every["b"], every["a"]))
    placed = every[order]
    first = np.ones(len(placed), bool)
    first[1:] = placed[1:] != placed[:-1]
    inverse = np.empty(len(every), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return docs, placed[first], ids[order][first], np.split(inverse, np.cumsum([len(d[3]) for d in docs])[:-1])


def _extended(buckets: int, window: int):
    def kernel(keys: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        (seeds,) = _unpacked(back, 0, ["<u8"])
        _, found, least, _ = _windows(table, seeds, window)
        return _by_range(keys[0].as_py(), found["a"], [found["a"], found["b"], least], buckets)

    return kernel


def _least(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Least document id of each window of one hash range, to the groups whose own least is larger."""
    groups, index, (a, b, least) = _gather(table, ["<u8", "<u4", "<i8"])
    order = np.lexsort((least, b, a))
    groups, index, a, b, least = (x[order] for x in (groups, index, a, b, least))
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    over = least[first][np.cumsum(first) - 1]
    later = over < least
    return _by_group(groups[later], [index[later], over[later]], 1)


def _cut(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string())])

    def kernel(keys: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        (seeds,), (index, over) = _unpacked(back, 0, ["<u8"]), _unpacked(back, 1, ["<i8", "<i8"])
        docs, _, least, inverse = _windows(table, seeds, window)
        least = least.copy()
        least[index] = over
        out = []
        for (doc_id, text, n, starts, _), of in zip(docs, inverse, strict=True):
            gone = starts[least[of] < doc_id] if doc_id is not None and len(starts) else starts[:0]
            words, turn, removed = bytes(text).split(), gone, 0
            if len(gone):
                edge = np.zeros(n + 1, np.int64)
                edge[gone] += 1
                edge[gone + window] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                words, removed = list(compress(words, (~covered).tolist())), int(covered.sum())
                turn = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
            kept = b" ".join(words)
            out.append((doc_id, n, removed, hashlib.sha256(kept).hexdigest(), turn.reshape(-1, 2).tolist(), kept.decode("utf-8", "surrogatepass")))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)

    return kernel


def cut_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept) for each row of ``docs`` (doc_id, text).

    A word goes if it is in a run of ``window`` words that also stands in a document of smaller
    id; runs are judged on the input. spans lists the maximal removed stretches as [start, end) in
    words, kept the kept words joined by one space. Null and blank texts have no words.
    Rows that share a doc_id don't affect each other; a row with a null doc_id neither loses words nor costs others theirs.
    Texts of fewer than ``window`` words stay. Very long texts are taken whole: a task holds the words of one group of texts, some MB or its longest text.
    Of equal runs in several documents the least doc_id keeps its own, all of them where it stands several times; equal hashes of a seed only add candidates. An empty table gives no rows; other columns are ignored.
    """
    if not SEED_WORDS < window <= 256:
        raise ValueError(f"window must be over {SEED_WORDS} and at most 256 words")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = max(1, math.ceil(size / GROUP_BYTES)), max(1, math.ceil(size / RANGE_BYTES))
    dealt = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("grp"), "doc_id", "text").groupBy("grp")
    anchors = dealt.applyInArrow(_anchors(buckets, window), PACKED)
    seeds = anchors.groupBy("bucket").applyInArrow(_seeds, PACKED)
    windows = dealt.cogroup(seeds.groupBy("grp")).applyInArrow(_extended(buckets, window), PACKED)
    least = windows.groupBy("bucket").applyInArrow(_least, PACKED)
    back = seeds.unionByName(least)
    return dealt.cogroup(back.groupBy("grp")).applyInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>, kept string")
