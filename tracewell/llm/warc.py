"""WARC archives: writing with revisit records, and splittable reading by boundary-chain verification.

Archives are written by Spark's text sink with the record terminator as line separator, and read by its
text source with the record magic as line separator, so files split, and any store that
Spark reads will do. Every magic is a candidate record start; a task follows the
content lengths of its split and emits each candidate's successor. Splits of a file are then joined
by pointer jumping from the file's start, which leaves only true records: a magic inside a
payload is never on the chain.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.storage import fresh_path, materialise

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records over several candidates are put together from pieces in blocks of this many bytes.
BLOCK = 1 << 20


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 SHA-1, from 20 bits (five hex digits) at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_HEX, BASE32)


def duplicate_payloads(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to): the page that each page's payload repeats, null for responses.

    Of pages with equal payloads of at least ``min_bytes`` the largest page_id is the response.
    Only ids and digests are shuffled, and counted before they are.
    """
    keyed = pages.select("page_id", base32_sha1("payload").alias("digest"), (F.octet_length("payload") >= min_bytes).alias("counts"))
    last = keyed.where("counts").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(last, "digest", "left").where("counts and last is not null and (page_id < last or page_id is null)").select("page_id", "digest", F.col("last").alias("refers_to")).distinct()


def record_text(url: F.Column, page_id: F.Column, digest: F.Column, payload: F.Column, refers_to: F.Column, date: str) -> F.Column:
    """A response or revisit record without its terminator."""
    urn = lambda i: F.concat(F.lit("<urn:tracewell:page:"), i.cast("string"), F.lit(">"))
    one_line = F.regexp_replace(F.coalesce(url, F.lit("urn:unknown")), r"[\x00-\x20\x7f]", "%20")
    size = F.octet_length(payload)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    again = refers_to.isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, payload))
    head = F.concat(
        F.lit(MAGIC), F.when(again, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.lit("WARC-Record-ID: "), urn(F.coalesce(page_id.cast("string"), F.lit("null"))), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), one_line,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), urn(refers_to), F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, block)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record a row of ``pages`` (page_id, url, html) into WARC files under ``path``.

    A null html is an empty payload, a null url ``urn:unknown``. Rows that repeat a page_id with
    the same html are alike response or revisit. An empty table writes files without records.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    again = materialise(duplicate_payloads(own, min_bytes), "revisits")
    full = own.withColumn("digest", base32_sha1("payload"))
    if again.isEmpty():
        full = full.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        same = full["page_id"].eqNullSafe(again["page_id"]) & (full["digest"] == again["digest"])
        full = full.join(again, same, "left").select(full["page_id"], "url", "payload", full["digest"], "refers_to")
    text = record_text(F.col("url"), F.col("page_id"), F.col("digest"), F.col("payload"), F.col("refers_to"), date)
    full.select(text.alias("value")).write.option("lineSep", END).text(path)


LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n")
FIELD = {k: re.compile(rb"(?i)\r\n" + k.encode() + rb":[ \t]*([^\r\n]*)") for k in ("WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Target-URI", "Content-Type")}
CANDIDATE = "file string, split long, chunk long, at long, next long, whole boolean, record_type string, record_id string, refers_to string, stated_digest string, payload_bytes long, payload_digest string, split_bytes long"
_NAMES = [x.split()[0] for x in CANDIDATE.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in CANDIDATE.split(", ")]


def parse_record(raw: bytes) -> tuple | None:
    """(head and body length, whole, type, id, refers_to, stated digest, payload bytes, payload digest) of a record without its magic."""
    end = raw.find(b"\r\n\r\n")
    head = b"\r\n" + raw[: max(end, 0)] + b"\r\n"
    m = LENGTH.search(head)
    if end < 0 or not m:
        return None
    body, size = raw[end + 4 :], int(m[1])
    field = {k: (x[1].decode("utf-8", "replace").strip() if (x := p.search(head)) else None) for k, p in FIELD.items()}
    whole, payload = len(body) >= size, body[:size]
    stated = (field["WARC-Payload-Digest"] or "").removeprefix("sha1:") or None
    count, digest = None, None
    if whole:
        if (field["Content-Type"] or "").startswith("application/http") and (cut := payload.find(b"\r\n\r\n")) >= 0:
            http, payload = b"\r\n" + payload[:cut] + b"\r\n", payload[cut + 4 :]
        else:
            http = b""
        if field["WARC-Type"] == "revisit":
            count, digest = (int(x[1]) if (x := LENGTH.search(http)) else None), stated
        else:
            count, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return end + 4 + size, whole, field["WARC-Type"], field["WARC-Record-ID"], field["WARC-Refers-To"], stated, count, digest


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a magic, with offsets from its split's start (``at``: of the magic's end), and one a split (``at`` null) with its bytes."""
    place, at, rows, first, chunk = None, 0, [], False, 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    for batch in batches:
        for file, split, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = one.as_py()
            if (file, split) != place:
                if place:
                    rows.append((*place, None, None, None, None, *[None] * 6, at))
                place, at, chunk, first = (file, split), 0, 0, split == 0
            # text before a file's first magic is no record
            if not first and (found := parse_record(raw)):
                size, whole, *rest = found
                rows.append((*place, chunk, at, at + size + len(END), whole, *rest, None))
            at, chunk, first = at + len(raw) + len(MAGIC), chunk + 1, False
            if len(rows) >= 4096:
                yield batch_of(rows)
                rows = []
    if place:
        rows.append((*place, None, None, None, None, *[None] * 6, at))
    if rows:
        yield batch_of(rows)


def raw_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value binary): what stands between magics, in the order of each split."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _exits(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The first successor outside the split of each candidate of one split."""
    at, nxt = table["at"].to_numpy(), table["next"].to_numpy()
    order = np.argsort(at)
    out, known = nxt.copy(), {}
    for i in order[::-1]:
        out[i] = known.get(int(nxt[i]), int(nxt[i]))
        known[int(at[i])] = int(out[i])
    return table.select(["file", "split", "at", "next"]).append_column("exit", pa.array(out, pa.int64()))


def _walk(keys: tuple[pa.Scalar, ...], entries: pa.Table, table: pa.Table) -> pa.Table:
    """The candidates of one split on the chains from its entries."""
    follow = dict(zip(table["at"].to_pylist(), table["next"].to_pylist(), strict=True))
    seen = set()
    for at in entries["at"].to_pylist():
        while at in follow and at not in seen:
            seen.add(at)
            at = follow[at]
    return table.filter(pa.array([x in seen for x in table["at"].to_pylist()], pa.bool_())).select(["file", "split", "at"])


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, split, at) of candidates on the chain from their file's start; ``at`` and ``next`` are offsets in the file.

    Within a split a task follows successors; across splits, entry points jump to the exits of
    their exits, twice as far each round, until no file has a new entry point.
    """
    spots = candidates.select("file", "split", "at", "next")
    jumps = materialise(spots.groupBy("file", "split").applyInArrow(_exits, "file string, split long, at long, next long, exit long"), "exits")
    start = jumps.groupBy("file").agg(F.min("at").alias("at")).where(F.col("at") == len(MAGIC))
    # only candidates that a split's chain can enter by
    ends = jumps.select("file", F.col("exit").alias("at")).distinct()
    hop = materialise(jumps.join(ends.unionByName(start).distinct(), ["file", "at"], "left_semi").select("file", "at", F.col("exit").alias("to")), "hops")
    entries, n = materialise(start, "entries"), -1
    while n != (n := entries.count()):
        onward = entries.join(hop, ["file", "at"]).select("file", F.col("to").alias("at"))
        entries = materialise(entries.unionByName(onward.join(hop, ["file", "at"], "left_semi")).distinct(), "entries")
        twice = hop.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        hop = materialise(hop.join(twice, ["file", "to"], "left").select("file", "at", F.coalesce("far", "to").alias("to")), "hops")
    inside = jumps.select("file", "split", "at")
    entered = entries.join(inside, ["file", "at"]).select("file", "split", "at")
    return entered.groupBy("file", "split").cogroup(spots.groupBy("file", "split")).applyInArrow(_walk, "file string, split long, at long")


def _joined(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    raw = MAGIC.encode().join(table["value"].to_pylist())
    _, whole, kind, rid, refers, stated, count, digest = parse_record(raw)
    row = [table["file"][0].as_py(), table["at"][0].as_py(), kind, rid, refers, stated, count, digest]
    return pa.table([[x] for x in row], schema=pa.schema(list(zip(["file", "at", *_NAMES[6:12]], [pa.string(), pa.int64(), *_KINDS[6:12]], strict=True))))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record_type, record_id, refers_to, stated_digest, payload_bytes, payload_digest) of each true record.

    payload_bytes of a revisit is the length its HTTP block states, its payload_digest the stated
    one. Records after a broken link of their file's chain are not read; a file that does not
    begin with the magic has none. Payloads may hold the magic, also across splits.
    """
    found = materialise(raw_chunks(spark, path).mapInArrow(_candidates, CANDIDATE), "candidates")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.where("split_bytes is not null").select("file", "split", F.coalesce(F.sum("split_bytes").over(before), F.lit(0)).alias("base"))
    placed = found.where("at is not null").join(bases, ["file", "split"])
    placed = placed.withColumn("at", F.col("at") + F.col("base")).withColumn("next", F.col("next") + F.col("base") + len(MAGIC))
    placed = materialise(placed.drop("split_bytes", "base"), "placed")
    true = materialise(placed.join(reachable(placed), ["file", "split", "at"], "left_semi"), "records")
    kept = ["file", "at", *_NAMES[6:12]]
    rare = true.where(~F.col("whole"))
    if rare.isEmpty():
        return true.select(kept)
    # true records that hold a magic: gather their pieces, a block of the file at a time
    span = rare.select("file", "at", "next", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor(F.col("next") / BLOCK))).alias("block"))
    pieces = raw_chunks(spark, path).mapInArrow(_numbered, "file string, split long, start long, value binary").join(bases, ["file", "split"])
    pieces = pieces.select("file", (F.col("start") + F.col("base")).alias("place"), "value").withColumn("block", F.floor(F.col("place") / BLOCK))
    of = pieces.join(span, ["file", "block"]).where("place >= at and place < next").select("file", "at", "place", "value")
    kinds = "file string, at long, record_type string, record_id string, refers_to string, stated_digest string, payload_bytes long, payload_digest string"
    return true.where("whole").select(kept).unionByName(of.groupBy("file", "at").applyInArrow(_joined, kinds))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, at = None, 0
    for batch in batches:
        starts = []
        for file, split, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [len(x.as_buffer() or b"") for x in batch.column(2)], strict=True):
            place, at = ((file, split), 0) if (file, split) != place else (place, at)
            starts.append(at)
            at += n + len(MAGIC)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), batch.column(2)], names=["file", "split", "start", "value"])


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row a page, as read back from archives in the shared folder.

    A null html is an empty payload; very long ones are written and read whole. Rows of one page_id are records of their own; of equal payloads the
    one with the largest page_id is the response, and so are all rows of that id. A null page_id comes back null. An empty table gives no rows; columns other than
    page_id, url and html are ignored, whatever their names.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:tracewell:page:(.*)>$', 1) as long)")
    return read_warc(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
