"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are built in one Arrow pass. Each structured bit mask of ``covering_masks`` is one hash
table; any two fingerprints that differ in at most ``radius`` bits agree on all bits of at least
one mask, so no link is missed. Tables hold distinct fingerprints, so exact copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.components import connected_components
from tracewell.llm.groups import group_links, judged_pairs
from tracewell.llm.storage import materialise

BITS = 64
#: Buckets of up to this many fingerprints are compared within one row.
BUCKET = 512


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2**(radius+1) - 1 masks; every set of at most ``radius`` bit places is missed by one of them.

    Bit place i has a non-zero vector m(i) of radius+1 binary digits; mask v keeps the places with
    odd parity of m(i) & v. At most ``radius`` vectors leave a v orthogonal to all of them.
    """
    n = (1 << (radius + 1)) - 1
    places = [1 + (i * 0x9E3779B1 >> 7) % n for i in range(bits)] if n > bits else [1 + i % n for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(places) if bin(m & v).count("1") & 1) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of each run of ``size`` words joined by a space; of all words if fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, size = ends - lens, min(size, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - size + 1)


def majority_bits(hashes: np.ndarray, step: int = 1 << 15) -> int:
    """The 64-bit number whose bit is 1 where over half of ``hashes`` have a 1; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[at : at + step]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def _ascii_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id long, fp long): whole texts, A-Z lower-cased, words split at ASCII white space.

    A null or blank text has fingerprint 0. Other columns of ``docs`` are ignored.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [signed(majority_bits(shingle_hashes(_ascii_words(t.as_py()), shingle))) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, "doc_id long, fp long")


def _local_edges(radius: int):
    """Spanning edges among the fingerprints of each bucket."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for one in batch.column(0):
                fps = np.unique(np.array(one.as_py(), np.int64)).view(np.uint64)
                near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
                left = np.ones(len(fps), bool)
                for k in range(len(fps)):
                    if left[k]:
                        seen = front = near[k] & left
                        while front.any():
                            grown = near[front].any(axis=0) & left & ~seen
                            seen, front = seen | grown, grown
                        left &= ~seen
                        rest = np.flatnonzero(seen)[1:]
                        a += [int(fps.view(np.int64)[k])] * len(rest)
                        b += fps.view(np.int64)[rest].tolist()
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return kernel


def bucket_rows(fps: DataFrame, radius: int) -> DataFrame:
    """(table int, key long, *columns of fps): each fingerprint once a mask."""
    masks = [F.lit(signed(m)).cast("long") for m in covering_masks(radius)]
    return fps.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(m) for m in masks])).alias("table", "key"))


def fingerprint_links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect just the components of the graph "at most ``radius`` bits differ".

    ``fps``: distinct fp long. Buckets of two are compared in SQL, those up to ``bucket`` in one
    row each. Members of larger buckets, whatever their number, are linked without comparing pairs:
    two fingerprints at most ``radius`` apart share a point at most radius/2 from both, and all
    that share such a point are within ``radius`` of each other. So each one is spread to the points around
    it (2081 for radius 4), and each point, which no more than 2081 fingerprints can share,
    links its fingerprints in a star.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    rows = bucket_rows(fps, radius)
    met = materialise(rows.groupBy("table", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    pairs = met.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    more = rows.join(met.where("n > 2").select("table", "key", "n"), ["table", "key"])
    small = more.where(F.col("n") <= bucket).groupBy("table", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_local_edges(radius), "a long, b long")
    hot = more.where(F.col("n") > bucket).select("fp").distinct()
    point = hot.select("fp", F.col("fp").alias("point"))
    flips = F.array(*[F.lit(signed(1 << i)).cast("long") for i in range(BITS)])
    for _ in range(radius // 2):
        step = F.explode(F.concat(F.array(F.lit(0).cast("long")), flips))
        point = point.select("fp", "point", step.alias("flip")).select("fp", F.col("point").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    star = point.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = star.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(small).unionByName(star)


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits.
    Repeated rows give repeated rows. Null and blank texts share the zero fingerprint and link like
    any other. A null doc_id never becomes a component_id unless its component has nothing else.
    Very long texts are hashed whole, one text at a time, their bits counted in blocks. A bit set in exactly half of the shingles is 0; where several paths
    lead to the same least doc_id, or rows share it, they have that one component. An empty table gives an empty table; columns other than doc_id and text are ignored.
    """
    own = materialise(fingerprints(docs, shingle), "fingerprints")
    fps = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fps")
    roots = connected_components(fingerprint_links(fps.select("fp"), radius))
    labelled = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return own.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


#: Near-duplicate documents: words a shingle, hash tables, MinHashes a table. At the least similarity S a pair shares no
#: table with probability (1 - S**ROWS)**TABLES = 4.7e-8, and less above.
NEAR_SHINGLE, TABLES, ROWS = 5, 32, 4
#: Least Jaccard similarity of the distinct shingles, in fifths: 4/5.
FIFTHS = 4
_MULTIPLIERS = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([k]), 42) for k in range(TABLES * ROWS)), np.uint64) | np.uint64(1)


def distinct_shingles(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(_ascii_words(text), NEAR_SHINGLE))


def table_keys(shingles: np.ndarray, step: int = 512) -> list[int]:
    """One key a table, of the least of ``shingles`` under each of its ROWS hash functions; none for no shingles."""
    if not len(shingles):
        return []
    least = np.full(len(_MULTIPLIERS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), step):
        x = _MULTIPLIERS[:, None] * shingles[None, at : at + step]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=1), out=least)
    raw, size = least.tobytes(), 8 * ROWS
    return [signed(xxhash.xxh64_intdigest(raw[size * k : size * (k + 1)], k)) for k in range(TABLES)]


def sketched(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_key, cid, size, fp, keys): texts of the same distinct shingles have one cid; fp as ``fingerprints`` has it, keys in the hash tables."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sizes, fps, keys = [], [], [], []
            for one in batch.column(2):
                words = _ascii_words(one.as_py())
                shingles = np.unique(shingle_hashes(words, NEAR_SHINGLE))
                cids.append(signed(xxhash.xxh64_intdigest(shingles.tobytes(), 42)))
                sizes.append(len(shingles))
                fps.append(signed(majority_bits(shingle_hashes(words, shingle))))
                keys.append(table_keys(shingles))
            found = [pa.array(x, pa.int64()) for x in (cids, sizes, fps)]
            yield pa.record_batch([batch.column(0), batch.column(1), *found, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "cid", "size", "fp", "keys"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(kernel, "doc_id long, text_key long, cid long, size long, fp long, keys array<long>")


def simhash_groups(own: DataFrame, radius: int = 4) -> tuple[DataFrame, DataFrame]:
    """The SimHash links among the classes of ``own`` (cid, fp), as distinct pairs (a, b), and (key, cid), the members of each component of over one class.

    The pairs join the classes of one fingerprint, and one class of each to one of the fingerprints that ``fingerprint_links`` links it to. Texts of a class may
    have several fingerprints; the class is then in each of their components.
    """
    members = materialise(own.select("cid", "fp").distinct(), "fingerprints")
    fps = materialise(members.groupBy("fp").agg(F.min("cid").alias("least")), "distinct-fps")
    links = materialise(fingerprint_links(fps.select("fp"), radius), "fingerprint-links")
    ends = links.join(fps.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y")
    same = members.join(fps, "fp").select(F.col("least").alias("x"), F.col("cid").alias("y"))
    pairs = ends.unionByName(same).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    roots = connected_components(links).withColumnRenamed("node", "fp")
    named = materialise(members.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("key"), "cid").distinct(), "components")
    return pairs, named.join(named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, text_a, text_b) whose distinct shingles have the least similarity."""
    last, left = None, np.zeros(0, np.uint64)
    for batch in batches:
        keep = []
        for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if a != last:
                last, left = a, distinct_shingles(text_a.as_py())
            right = distinct_shingles(text_b.as_py())
            both = len(np.intersect1d(left, right, assume_unique=True))
            keep.append(5 * both >= FIFTHS * (len(left) + len(right) - both))
        own = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column(0).filter(own), batch.column(1).filter(own)], names=["a", "b"])


def alike_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose ``texts`` (cid, text) are near duplicates, by exact Jaccard similarity."""
    return judged_pairs(pairs, texts.select("cid", F.col("text").alias("item")), _alike, "a long, b long")


def _sizes_allow(x: str, y: str) -> F.Column:
    """A similarity of s needs sizes in a ratio of s at least."""
    return F.least(x, y) * 5 >= F.greatest(x, y) * FIFTHS


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, shingle, size): the distinct shingles of each text (cid, text), hashed."""
    for batch in batches:
        for cid, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = distinct_shingles(one.as_py()).view(np.int64)
            yield pa.record_batch([pa.array(np.full(len(own), cid, np.int64)), pa.array(own), pa.array(np.full(len(own), len(own), np.int64))], names=["cid", "shingle", "size"])


def prefix_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of the ``members`` (cid, root) with different roots whose texts may be near duplicates; none that are is missing.

    Shingles are put in order, the rarest first. Two texts of sizes x and y with a similarity of s have at least
    s / (1 + s) * (x + y) of them in common, so the first common one leaves that many, itself included, in both. It is among the first x - s * x + 1 of
    either, and texts that differ by rare shingles of their own have none there. Of a shingle, only members of
    different roots meet, root by root.
    """
    own = texts.join(members.select("cid"), "cid", "left_semi").select("cid", "text")
    rows = materialise(own.mapInArrow(_shingle_rows, "cid long, shingle long, size long"), "shingles")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("n", "shingle"))
    first = rows.join(counts, "shingle").withColumn("left", F.col("size") - place + 1).where((F.col("n") > 1) & (F.col("left") * 5 >= F.col("size") * FIFTHS))
    first = materialise(first.select("cid", "shingle", "size", "left").join(members.select("cid", "root"), "cid"), "prefixes")
    # the size of the largest text that can be near this one with this shingle as the first common one
    first = first.withColumn("reach", F.floor(F.col("left") * (5 + FIFTHS) / FIFTHS) - F.col("size"))
    roots = first.groupBy("shingle", "root").agg(F.max("reach").alias("reach"), F.min("size").alias("size"))
    root_a, root_b = (roots.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("root", "reach", "size")]) for side in "ab")
    met = root_a.join(root_b, "shingle").where("root_a < root_b and reach_a >= size_b and reach_b >= size_a").select("shingle", "root_a", "root_b", F.col("reach_b").alias("most"), F.col("size_b").alias("least"))
    a, b = (first.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("cid", "size", "reach", "root")]) for side in "ab")
    pairs = met.join(a, ["shingle", "root_a"]).where("reach_a >= least and size_a <= most")
    pairs = pairs.join(b, ["shingle", "root_b"]).where(F.expr("reach_a >= size_b and reach_b >= size_a") & _sizes_allow("size_a", "size_b"))
    return pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def near_links(shared: DataFrame, texts: DataFrame, stars: int = 1, known: DataFrame | None = None, **rounds: int) -> DataFrame:
    """Edges (a, b) that connect just the groups which the near duplicates among the texts of each bucket make.

    ``shared``: (key, cid, size) of the buckets with more than one text; ``stars``, ``known`` and ``rounds`` as ``group_links`` has them.
    """
    return group_links(shared.withColumn("asks", F.lit(True)), lambda pairs: alike_pairs(pairs, texts), _sizes_allow, lambda members: prefix_pairs(members, texts), stars=stars, known=known, **rounds)


def drop_near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, with its columns, of which each group of near duplicates keeps the one of least doc_id.

    Two texts are near duplicates at an exact Jaccard similarity of their distinct five-word shingles of 0.8 or
    more; groups are connected. First the links of ``simhash_components`` (fingerprints at most ``radius`` bits apart, none missed) are decided by that
    similarity, and what they leave apart in a component meets too. Near duplicates whose fingerprints are further apart meet
    in the buckets of TABLES MinHash tables, which a pair misses with probability 4.7e-8 at 0.8; there, buckets of one group are done. Texts of the same shingles
    are one candidate, so copies cost one row. A-Z is lower-cased, words split at ASCII white space;
    a text of fewer than five words is one shingle.
    Null and blank texts are one group. Very long texts are read whole. Repeated rows leave one; of rows with the same least
    doc_id, the one of the least text hash stays. Names of other columns may clash with those used inside. A null doc_id stays only if its
    group has no other. An empty table gives none.
    """
    own = materialise(sketched(docs), "sketches")
    classes = materialise(own.groupBy("cid").agg(F.min("size").alias("size"), F.first("keys").alias("keys"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("least")), "sketch-classes")
    rows = classes.select("cid", "size", F.explode("keys").alias("key"))
    met = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "buckets")
    pairs, components = simhash_groups(own, radius)
    components = components.join(classes.select("cid", "size"), "cid").select(F.xxhash64(F.lit("fp"), "key").alias("key"), "cid", "size")
    shared = materialise(rows.join(met, "key").select("key", "cid", "size").unionByName(components), "shared-buckets")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"))
    needed = classes.join(shared.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("least.doc_id").alias("need_d"), F.col("least.text_key").alias("need_k"))
    texts = keyed.select("d", "k", F.col("row")["text"].cast("string").alias("text")).join(needed, F.col("d").eqNullSafe(F.col("need_d")) & (F.col("k") == F.col("need_k")))
    texts = materialise(texts.select("cid", "text").dropDuplicates(["cid"]), "candidate-texts")
    sizes = classes.select("cid", "size")
    pairs = pairs.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b").where(_sizes_allow("size_a", "size_b")).select("a", "b")
    known = materialise(alike_pairs(materialise(pairs, "simhash-pairs"), texts), "simhash-links")
    roots = connected_components(near_links(shared, texts, known=known))
    kept = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").groupBy(F.coalesce("root", "cid").alias("root")).agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.doc_id").alias("need_d"), F.col("least.text_key").alias("need_k"))
    one = keyed.join(kept.distinct(), keyed["d"].eqNullSafe(kept["need_d"]) & (keyed["k"] == kept["need_k"]), "left_semi").dropDuplicates(["d", "k"])
    return one.select("row.*")
