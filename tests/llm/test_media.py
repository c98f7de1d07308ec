"""Audio fingerprints and alignment against versions that share nothing with the operator but its parameters."""

import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import media


def samples_of(text):
    return np.concatenate([*media.tones(pa.scalar(text)), np.zeros(0, np.int16)])


def slow_fingerprint(samples):
    """Frame by frame and box by box, by sums over the frames themselves."""
    frames = []
    for at in range(0, len(samples) - media.FRAME + 1, media.HOP):
        own = samples[at : at + media.FRAME].astype(float) * np.hanning(media.FRAME)
        spectrum = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME) @ own
        classes = [0.0] * 12
        for i, z in enumerate(spectrum):
            hz = i * media.RATE / media.FRAME
            if 65 <= hz < media.RATE / 2 * 0.95:
                classes[int(round(12 * math.log2(hz / 440))) % 12] += abs(z) ** 2
        total = sum(classes)
        frames.append([x / total if total > 1e-9 else 0.0 for x in classes])

    def box(t, a, b, p, q):
        return sum(frames[t + i][j] for i in range(a, b) for j in range(p, q))

    out = []
    for t in range(len(frames) - media.WIDTH + 1):
        value = []
        for k in range(16):
            p, w = 5 * k % 9, 4 + k // 4 * 4
            h = 5 if k % 4 >= 2 and p < 8 else 3
            m, mid = w // 2, p + h // 2
            if k % 4 == 0:
                q = (p + 6) % (13 - h)
                first, second = box(t, 0, w, p, p + h), box(t, 0, w, q, q + h)
            elif k % 4 == 1:
                first, second = box(t, 0, m, p, p + h), box(t, m, w, p, p + h)
            elif k % 4 == 2:
                first, second = box(t, 0, w, p, mid), box(t, 0, w, mid, p + h)
            else:
                first = box(t, 0, m, p, mid) + box(t, m, w, mid, p + h)
                second = box(t, 0, m, mid, p + h) + box(t, m, w, p, mid)
            ratio = math.log(1 + first) - math.log(1 + second)
            value.append((0, 1, 3, 2)[sum(ratio > c for c in media.CUTS)])
        out.append(int("".join(f"{v:02b}" for v in value), 2))
    return np.array(out, np.uint32)


def test_fingerprints_equal_slow_ones():
    rng = np.random.default_rng(1)
    samples = samples_of(" ".join(f"w{x}" for x in rng.integers(0, 900, 40)))
    fast = media.packed(media.chroma_frames(iter([samples[:700], samples[700:5000], samples[5000:]])))
    slow = slow_fingerprint(samples)
    assert len(fast) == len(slow) > 20
    # shares are counted in steps, so values at a quarter point may fall either way
    assert np.bitwise_count(fast ^ slow).sum() <= 0.005 * 32 * len(fast)
    # noise is not silence, and blocks make no difference
    noise = rng.normal(0, 3000, 30_000).astype(np.int16)
    whole, cut = (media.packed(media.chroma_frames(iter(x))) for x in ([noise], np.array_split(noise, 11)))
    assert (whole == cut).all() and np.bitwise_count(whole ^ slow_fingerprint(noise)).sum() <= 0.005 * 32 * len(whole)


def slow_anchors(fp):
    keys = [(int(a) << 32 | int(b)) * 0x9E3779B97F4A7C15 % 2**64 for a, b in zip(fp, fp[1:], strict=False)]
    at = {max(range(i, i + media.ANCHORS), key=lambda j: (-keys[j], j)) for i in range(len(keys) - media.ANCHORS + 1)}
    return sorted((j, keys[j]) for j in at)


def slow_link(a, b):
    one, two = slow_anchors(a), slow_anchors(b)
    votes = Counter(offset for offset, _ in {(y - x, k) for x, k in one for y, m in two if k == m})
    if not votes:
        return None
    offset = min(votes, key=lambda o: (-votes[o], abs(o), o))
    pairs = [(a[i], b[i + offset]) for i in range(len(a)) if 0 <= i + offset < len(b)]
    fewer = min(len({k for _, k in one}), len({k for _, k in two}))
    error = sum(bin(int(x) ^ int(y)).count("1") for x, y in pairs) / (32 * max(1, len(pairs)))
    ok = votes[offset] >= media.MIN_VOTES * fewer and len(pairs) >= media.MIN_OVERLAP and error <= media.MAX_BIT_ERROR
    return (offset, votes[offset], error) if ok else None


def test_offset_votes_equal_all_pairs():
    rng = np.random.default_rng(8)
    for n, kinds, few in ((40, 3, 1 << 16), (300, 2, 10), (300, 40, 10), (1, 1, 1), (900, 1, 100)):
        a, b = ((np.sort(rng.choice(4 * n, n, replace=False)), rng.integers(0, kinds, n)) for _ in "ab")
        votes = Counter(o for o, _ in {(int(y - x), int(k)) for x, k in zip(*a, strict=True) for y, m in zip(*b, strict=True) if k == m})
        want = min(votes, key=lambda o: (-votes[o], abs(o), o))
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(media, "FEW_PAIRS", few)
            assert media.best_offset(a, b) == (want, votes[want])
    assert media.best_offset((np.arange(3), np.array([1, 2, 3])), (np.arange(2), np.array([4, 5]))) == (0, 0)
    # an hour of one note against another: 40,000 places of one key on either side
    long = np.arange(40_000), np.zeros(40_000, np.int64)
    began = time.time()
    assert media.best_offset(long, long) == (0, 1) and time.time() - began < 5


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10_000, n)]
    passage, common = words(60), words(30)
    rows = [("q", " ".join(passage)), ("copy", " ".join(passage)), ("later", " ".join(words(20) + passage)), ("none", None), ("empty", ""), ("short", "a b c")]
    # a phrase that many recordings share links none of them
    rows += [(f"x{i}", " ".join(words(60) + common + words(60))) for i in range(12)]
    for i in range(12):
        own = list(passage)
        own[int(rng.integers(0, 60))] = f"n{i}"
        rows.append((f"near{i}", " ".join(own)))
    return [*rows, ("q", " ".join(passage)), ("long", " ".join(words(3000) + passage)), ("same", " ".join(["la"] * 400)), ("same too", " ".join(["la"] * 300))]


def test_groups_equal_those_of_all_pairs(spark, recordings):
    table = spark.createDataFrame(recordings, "rec_id string, text string").selectExpr("*", "1 as fp", "2 as cid", "3 as key", "'a' as audio")
    fps = media.fingerprint(table, "text", "string", media.tones)
    members, links = media.align(fps)
    got = members.collect()
    assert Counter(r.rec_id for r in got) == Counter(i for i, _ in recordings)
    own = {i: media.packed(media.chroma_frames(media.tones(pa.scalar(t or "")))) for i, t in recordings}
    assert {r.rec_id: r.n_frames for r in got} == {i: len(x) for i, x in own.items()}
    least = {}
    for i in sorted(own):
        least.setdefault(own[i].tobytes(), i)
    assert {r.rec_id: r.class_id for r in got} == {i: least[x.tobytes()] for i, x in own.items()}
    names = sorted(least.values())
    found = {(a, b): x for k, b in enumerate(names) for a in names[:k] if (x := slow_link(own[a], own[b]))}
    assert len(found) > 40 and not any(a[0] == "x" or b[0] == "x" for a, b in found)
    root = {i: i for i in names}
    for _ in names:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.rec_id: r.group_id for r in got} == {i: root[least[x.tobytes()]] for i, x in own.items()}
    group = {r.rec_id: r.group_id for r in got}
    assert group["q"] == group["later"] == group["near3"] == group["long"] and group["x1"] != group["x2"]
    for r in links.collect():
        turned = r.a > r.b
        want = found[min(r.a, r.b), max(r.a, r.b)]
        assert (abs(r.offset), r.votes, round(r.bit_error, 9)) == (abs(want[0]), want[1], round(want[2], 9))
        assert turned or r.offset == want[0]


def test_audio_column_equals_rendered_text(spark, recordings):
    rows = [(i, samples_of(t).tobytes() if t is not None else None) for i, t in recordings]
    audio = media.fingerprint(spark.createDataFrame(rows, "rec_id string, audio binary"))
    text = media.fingerprint(spark.createDataFrame(recordings, "rec_id string, text string"), "text", "string", media.tones)
    assert Counter((r.rec_id, bytes(r.fp)) for r in audio.collect()) == Counter((r.rec_id, bytes(r.fp)) for r in text.collect())


def test_conversations(spark):
    line = " ".join(f"word{i}" for i in range(40))
    rows = [(0, 1, line), (20, 1, None), (1, 1, ""), (None, None, "a b"), (0, 1, line), (3, 2, line)]
    got = media.conversation_groups(spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "'x' as rec_id", "1 as n")).collect()
    assert Counter(r.rec_id for r in got) == Counter({"0/1": 2, "20/1": 1, "1/1": 1, "null/null": 1, "3/2": 1})
    assert {r.group_id for r in got if r.n_frames} == {"0/1"}
    assert media.conversation_groups(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0
