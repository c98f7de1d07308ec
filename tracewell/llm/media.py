"""Media columns: chroma audio fingerprints and their alignment.

A recording becomes frames of twelve pitch classes; box filters over the integral image of the frames,
each quantised to two Gray-coded bits, pack one 32-bit integer a frame. Two recordings align at the offset
that most of their common anchors (selected pairs of successive integers) agree on, and the share of differing
bits there decides. Alike recordings are found in the buckets of their anchors, and grouped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.components import connected_components
from tracewell.llm.groups import group_links, judged_pairs
from tracewell.llm.storage import materialise

RATE, FRAME, HOP = 5512, 1024, 512
#: Quarter points of a filter's log ratio; steps in which a frame's shares are counted, so that sums are exact.
CUTS, UNIT = (-0.18, 0.0, 0.18), 1 << 20
WIDTH, ANCHORS = 16, 6
#: Words, frames that are worked on together.
NOTES, BLOCK = 1024, 2048
#: Pairs of places that are taken at once.
FEW_PAIRS = 1 << 16
#: What aligned recordings have at least: anchors that agree, as a share of those of the recording with fewer; overlap in frames. And at most: differing bits.
MIN_VOTES, MIN_OVERLAP, MAX_BIT_ERROR = 0.25, 8, 0.15

Blocks = Iterator[np.ndarray]


def filters() -> np.ndarray:
    """16 box filters by rule: (filter, side, box, (first frame, end frame, first pitch class, end)); a filter compares its sides, of one or two boxes."""
    out = np.zeros((16, 2, 2, 4), np.int64)
    for k in range(16):
        p, w = (5 * k) % 9, (4, 8, 12, 16)[k // 4]
        h = 3 + k % 4 // 2 * 2 if p < 8 else 3
        q, half, mid = (p + 6) % (13 - h), w // 2, p + h // 2
        if k % 4 == 0:
            sides = [[(0, w, p, p + h)], [(0, w, q, q + h)]]
        elif k % 4 == 1:
            sides = [[(0, half, p, p + h)], [(half, w, p, p + h)]]
        elif k % 4 == 2:
            sides = [[(0, w, p, mid)], [(0, w, mid, p + h)]]
        else:
            sides = [[(0, half, p, mid), (half, w, mid, p + h)], [(0, half, mid, p + h), (half, w, p, mid)]]
        for side, boxes in enumerate(sides):
            out[k, side, : len(boxes)] = boxes
    return out


FILTERS = np.minimum(filters(), [WIDTH, WIDTH, 12, 12])


def pitch_bins(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequency bins from 65 Hz to just under half the rate, ordered by pitch class, and where each class begins."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = np.flatnonzero((hz >= 65) & (hz < rate / 2 * 0.95))
    pitch = np.round(12 * np.log2(hz[heard] / 440.0)).astype(int) % 12
    order = np.argsort(pitch, kind="stable")
    return heard[order], np.searchsorted(pitch[order], np.arange(12))


def chroma_frames(blocks: Blocks, rate: int = RATE) -> np.ndarray:
    """(frame, 12) energies of pitch classes, a frame's sum UNIT give or take rounding; silence is all zero. Samples come in blocks of any length."""
    heard, begins = pitch_bins(rate)
    window, parts, rest = np.hanning(FRAME).astype(np.float32), [np.zeros((0, 12), np.int64)], np.zeros(0, np.float32)
    for block in blocks:
        samples = np.concatenate([rest, block.astype(np.float32)])
        n = max(0, (len(samples) - FRAME) // HOP + 1)
        if n:
            views = sliding_window_view(samples, FRAME)[::HOP]
            for at in range(0, n, 256):
                spectrum = np.fft.rfft(views[at : at + 256] * window, axis=1)
                power = spectrum.real**2 + spectrum.imag**2
                energy = np.add.reduceat(power[:, heard], begins, axis=1).astype(np.float64)
                total = energy.sum(axis=1, keepdims=True)
                parts.append(np.rint(UNIT * np.divide(energy, total, out=np.zeros_like(energy), where=total > 1e-9)).astype(np.int64))
        rest = samples[n * HOP :]
    return np.concatenate(parts)


def packed(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each frame that WIDTH - 1 more follow."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13), np.int64)
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t0, t1, p0, p1 = (FILTERS[..., i, None] for i in range(4))
    out = np.zeros(n, np.uint32)
    for first in range(0, n, BLOCK):
        at = np.arange(first, min(n, first + BLOCK))
        boxes = image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]
        sides = np.log1p(boxes.sum(axis=2) / UNIT)
        ratio = sides[:, 0] - sides[:, 1]
        level = sum((ratio > c).astype(np.uint32) for c in CUTS)
        for code in level ^ (level >> np.uint32(1)):
            out[at] = (out[at] << np.uint32(2)) | code
    return out


def pcm(raw: pa.Scalar) -> Blocks:
    """Blocks of 16-bit little-endian mono samples."""
    data = raw.as_buffer()
    for at in range(0, len(data) // 2, 1 << 18):
        yield np.frombuffer(data, "<i2", min(1 << 18, len(data) // 2 - at), 2 * at)


def _notes() -> np.ndarray:
    """Two octaves from 220 Hz, a row a semitone: one hop each, with its octave at less strength."""
    t = np.arange(HOP) / RATE
    shape = np.minimum(1, np.minimum(t, t[::-1]) * 200)
    f = 220.0 * 2 ** (np.arange(24)[:, None] / 12)
    return ((np.sin(2 * np.pi * f * t) + 0.4 * np.sin(4 * np.pi * f * t)) * shape * 12000).astype(np.int16)


NOTE_SAMPLES = _notes()


def tones(text: pa.Scalar) -> Blocks:
    """A text as a melody: each white-space separated word of the whole text a note of one hop, its pitch by the word's CRC-32."""
    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
    for at in range(0, len(words), NOTES):
        yield NOTE_SAMPLES[[zlib.crc32(w) % 24 for w in words[at : at + NOTES]]].ravel()


def fingerprint(recordings: DataFrame, column: str = "audio", kind: str = "binary", samples: Callable[[pa.Scalar], Blocks] = pcm) -> DataFrame:
    """(rec_id, n_frames, fp binary) from (rec_id, ``column``): little-endian unsigned 32-bit integers.

    ``samples`` makes blocks of samples of a value: ``pcm`` of audio, ``tones`` of a text. Audio of under WIDTH frames, or null,
    has no integers. One recording is worked on at a time, a block at a time. Repeated rows give repeated rows,
    an empty table gives none; other columns are ignored.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [packed(chroma_frames(samples(one))).astype("<u4") if one.is_valid else np.zeros(0, "<u4") for one in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in fps], pa.int64()), pa.array([x.tobytes() for x in fps], pa.binary())], names=["rec_id", "n_frames", "fp"])

    return recordings.select(F.col("rec_id").cast("string").alias("rec_id"), F.col(column).cast(kind).alias("own")).mapInArrow(kernel, "rec_id string, n_frames long, fp binary")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys (two successive integers, mixed): of any ANCHORS successive keys the rightmost least, so equal stretches share theirs."""
    wide = fp.astype(np.uint64)
    key = ((wide[:-1] << np.uint64(32)) | wide[1:]) * np.uint64(0x9E3779B97F4A7C15)
    if len(key) < ANCHORS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    back = sliding_window_view(key, ANCHORS)[:, ::-1].argmin(axis=1)
    at = np.unique(np.arange(len(back)) + ANCHORS - 1 - back)
    return at, key[at].view(np.int64)


def _differences(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distinct places of ``right`` less those of ``left``, both rising: by pairs where these are few, else by the product of the places' spectra."""
    pairs, low = len(left) * len(right), right[0] - left[-1]
    if pairs <= FEW_PAIRS:
        return np.unique(right[:, None] - left[None, :])
    size = int(right[-1] - left[0] - low) + 1
    seen = np.zeros(size, bool)
    if pairs <= size * size.bit_length():
        for at in range(0, len(left), step := max(1, FEW_PAIRS // len(right))):
            seen[right[:, None] - left[None, at : at + step] - low] = True
    else:
        n = 1 << size.bit_length()
        a, b = np.zeros(n), np.zeros(n)
        a[left[-1] - left], b[right - right[0]] = 1, 1
        seen = np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), n)[:size] > 0.5
    return np.flatnonzero(seen) + low


def best_offset(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(offset, votes): the place in b less that in a which most distinct common keys agree on; ties go to the nearest to zero, then the smaller. (0, 0) for no common key."""
    keys = np.intersect1d(a[1], b[1])
    if not len(keys):
        return 0, 0
    sides = []
    for at, own in (a, b):
        order = np.argsort(own, kind="stable")
        sides.append((at[order], np.searchsorted(own[order], keys), np.searchsorted(own[order], keys, side="right")))
    (left, a0, a1), (right, b0, b1) = sides
    least = int(b[0].min() - a[0].max())
    votes = np.zeros(int(b[0].max() - a[0].min()) - least + 1, np.int64)
    for k in range(len(keys)):
        votes[_differences(left[a0[k] : a1[k]], right[b0[k] : b1[k]]) - least] += 1
    most = int(votes.max())
    found = (np.flatnonzero(votes == most) + least).tolist()
    return min(found, key=lambda x: (abs(x), x)), most


def aligned(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """(overlap in integers, share of differing bits in it) of b moved back by ``offset``."""
    start = max(0, -offset)
    n = min(len(a) - start, len(b) - start - offset)
    if n <= 0:
        return 0, 1.0
    return n, float(np.bitwise_count(a[start : start + n] ^ b[start + offset : start + offset + n]).sum()) / (32.0 * n)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, offset, votes, bit_error) of the rows (a, b, integers of both) that align."""
    last = left = own = None
    for batch in batches:
        rows = []
        for a, b, item_a, item_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if a != last:
                last, left = a, np.frombuffer(item_a.as_py(), "<u4")
                own = anchors(left)
            right = np.frombuffer(item_b.as_py(), "<u4")
            other = anchors(right)
            offset, votes = best_offset(own, other)
            n, error = aligned(left, right, offset)
            fewer = min(len(np.unique(own[1])), len(np.unique(other[1])))
            if votes >= max(1, math.ceil(MIN_VOTES * fewer)) and n >= MIN_OVERLAP and error <= MAX_BIT_ERROR:
                rows.append((a, b, offset, votes, error))
        kinds = [pa.int64()] * 4 + [pa.float64()]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["a", "b", "offset", "votes", "bit_error"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, key, m): the m distinct anchors of each class (cid, fp)."""
    for batch in batches:
        found = [np.unique(anchors(np.frombuffer(one.as_py(), "<u4"))[1]) for one in batch.column(1)]
        sizes = [len(x) for x in found]
        cid = np.repeat(batch.column(0).to_numpy(), sizes)
        yield pa.record_batch([pa.array(cid), pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(np.repeat(sizes, sizes), pa.int64())], names=["cid", "key", "m"])


def align(fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (rec_id, n_frames, class_id, group_id) of (rec_id, n_frames, fp), links (a, b, offset, votes, bit_error) between classes.

    Recordings with the same integers are one class, named by its least rec_id, so copies are never paired. Two classes align if
    at the offset that most of their common anchors agree on (ties: the nearest to zero) at least MIN_VOTES of the distinct
    anchors of the class with fewer agree, MIN_OVERLAP integers or more overlap, and at most MAX_BIT_ERROR of their bits differ.
    Groups are connected over aligned classes and named by their least rec_id; links are enough to connect each group, and judged in
    the order that the buckets of anchors give, so a hot anchor needs no pair of each two classes. An anchor among the
    commonest of a class, as many as could all be missing from an alignment, brings it no candidates: every alignment has a
    rarer one too. Recordings without integers are one class without links. A null rec_id is never a name unless
    its group has no other. Repeated rows give repeated rows, an empty table gives none.
    """
    own = fingerprints.select("rec_id", "n_frames", F.xxhash64("fp").alias("cid"), "fp")
    classes = materialise(own.groupBy("cid").agg(F.min("rec_id").alias("class_id"), F.first("fp").alias("fp")), "audio-classes")
    entries = materialise(classes.select("cid", "fp").mapInArrow(_keys, "cid long, key long, m long"), "audio-anchors")
    met = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # the commonest first: one fewer than the least number that must agree may go
    common = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("n"), "key"))
    shared = entries.join(met, "key").select("key", "cid", F.col("m").alias("size"), (common > F.ceil(MIN_VOTES * F.col("m")) - 1).alias("asks"))
    items = classes.select("cid", F.col("fp").alias("item"))
    judge = lambda pairs: judged_pairs(pairs, items, _links, "a long, b long, offset long, votes long, bit_error double")
    links = group_links(materialise(shared, "shared-anchors"), judge, lambda x, y: F.lit(True))
    named = classes.select("cid", "class_id").join(connected_components(links).withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    group = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    members = own.drop("fp").join(named.join(group, "root").select("cid", "class_id", "group_id"), "cid").drop("cid")
    name = classes.select("cid", "class_id")
    links = links.join(name.withColumnsRenamed({"cid": "a", "class_id": "class_a"}), "a").join(name.withColumnsRenamed({"cid": "b", "class_id": "class_b"}), "b")
    return members, links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "offset", "votes", "bit_error")


def conversation_groups(conversations: DataFrame) -> DataFrame:
    """(rec_id, n_frames, class_id, group_id): each conversation turn rendered as a recording, and the recordings that it aligns with.

    rec_id is ``conv_id/turn``, with ``null`` for nulls; rows that share it keep their own rows. A null or empty text is silent. Very long
    texts are rendered and analysed whole, in blocks. Ties, repeated rows and empty tables as ``align`` has them; other columns are ignored.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    rows = conversations.select(F.concat_ws("/", part("conv_id"), part("turn")).alias("rec_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return align(materialise(fingerprint(rows, "text", "string", tones), "audio"))[0]
