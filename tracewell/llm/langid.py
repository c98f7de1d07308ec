"""Language ID by n-gram filters that hold a bit for each language.

A Bloom filter whose cells are language bit masks: the masks at an n-gram's hash places are
ANDed, which gives all languages that may contain it in one look-up. Bits are counted a
language over the whole text and corrected by each language's false-positive rate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.batches import text_or_row, texts_of
from tracewell.llm.storage import materialise

LETTER = regex.compile(r"\p{L}")
#: The filter is fitted on about this many labelled documents of a language, chosen by hash, each whole.
DOCS_PER_LANGUAGE = 1500
#: Least share of a text's n-grams that its language must explain: this part of what all but EVIDENCE_TAIL of the sample reach.
EVIDENCE_PART, EVIDENCE_TAIL = 0.5, 0.005
GRAM, CELLS_LOG2, PROBES = 4, 20, 3
STEP = 1 << 20


def grams(text: bytes) -> Iterator[np.ndarray]:
    """64-bit hashes of the byte n-grams of each stretch of ``text``; all stretches together have every n-gram once."""
    for at in range(0, max(1, len(text) - GRAM + 1), STEP):
        part = np.frombuffer(text[at : at + STEP + GRAM - 1], np.uint8).astype(np.uint64)
        if len(part) >= GRAM:
            packed = np.zeros(len(part) - GRAM + 1, np.uint64)
            for k in range(GRAM):
                packed = (packed << np.uint64(8)) | part[k : k + len(packed)]
            packed *= np.uint64(0x9E3779B97F4A7C15)
            yield packed ^ (packed >> np.uint64(29))


def places(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << CELLS_LOG2) - 1)
    return [((hashes >> np.uint64(20 * k)) & mask).astype(np.int64) for k in range(PROBES)]


def folded(text: str) -> bytes:
    """Lower case, everything but letters as one space, a space at both ends."""
    return (" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode("utf-8", "surrogatepass")


class LanguageFilter:
    """Cells of language bits, a 64-bit word for each 64 languages, and what they say of a text."""

    def __init__(self, frequent: dict[str, np.ndarray], least_evidence: float = 0.0):
        """``frequent``: the hashes of each language's frequent n-grams."""
        self.languages, self.least_evidence = sorted(frequent), least_evidence
        self.cells = np.zeros((-(-len(self.languages) // 64), 1 << CELLS_LOG2), np.uint64)
        rates = []
        for i, lang in enumerate(self.languages):
            own, bit = self.cells[i // 64], np.uint64(1 << i % 64)
            for p in places(frequent[lang]):
                np.bitwise_or.at(own, p, bit)
            rates.append(np.mean((own & bit) != 0) ** PROBES)
        self.false_rate = np.array(rates)

    def evidence(self, text: str) -> np.ndarray:
        """The share of a text's n-grams that each language explains, corrected for false positives."""
        counts, total = np.zeros(len(self.languages)), 0
        for h in grams(folded(text)):
            total += len(h)
            at = places(h)
            for k, cells in enumerate(self.cells):
                found = cells[at[0]]
                for more in at[1:]:
                    found = found & cells[more]
                for i in range(64 * k, min(len(counts), 64 * k + 64)):
                    counts[i] += np.count_nonzero(found & np.uint64(1 << i % 64))
        return np.maximum(counts - total * self.false_rate, 0) / np.maximum(1 - self.false_rate, 1e-9) / max(1, total)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language, how far it stands above the runner-up (its share of what both have), and its evidence.

        ("und", 0, 0) without letters or learned languages; a text with letters but no known n-gram gets the first language with a score of 0.
        """
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, 0.0
        found = self.evidence(text)
        best = int(np.argmax(found))
        if not found[best]:
            return self.languages[0], 0.0, 0.0
        second = np.partition(found, -2)[-2] if len(found) > 1 else 0.0
        return self.languages[best], float(min(1.0, found[best] / (found[best] + second))), float(min(1.0, found[best]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram) of each text (lang, text), each once a text."""
    for batch in batches:
        for lang, one in zip(batch.column(0), batch.column(1), strict=True):
            own = np.unique(np.concatenate([*grams(folded(one.as_py())), np.zeros(0, np.uint64)])).view(np.int64)
            yield pa.record_batch([pa.array([lang.as_py()] * len(own), pa.string()), pa.array(own)], names=["lang", "gram"])


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, least_share: float = 0.02) -> LanguageFilter:
    """From text and lang of documents that are not held out: about ``per_language`` whole texts of each language, chosen by hash.

    An n-gram is a language's if at least ``least_share`` of its texts have it. They are counted on the executors; what
    comes to the driver is the frequent ones, at most 1 / least_share times as many as a text has on average, and one number for the evidence.
    Any number of languages is learned; no labelled document gives an empty filter.
    """
    usable = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageFilter({})
    # a share of all hashes, so any order or place of rows gives the same sample
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])[F.col("lang")]
    sample = materialise(usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < share * float(1 << 40)).select("lang", "text"), "language-sample")
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    seen = sample.mapInArrow(_distinct_grams, "lang string, gram long").groupBy("lang", "gram").agg(F.count("*").alias("n"))
    least = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1.0, least_share * n))])[F.col("lang")] if sizes else F.lit(1.0)
    kept = seen.where(F.col("n") >= least).groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    model = LanguageFilter({lang: np.zeros(0, np.uint64) for lang in counts} | {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in kept})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def own_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {lang: i for i, lang in enumerate(shared.value.languages)}
        for batch in batches:
            texts = [(lang.as_py(), t.as_py()) for lang, t in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.record_batch([pa.array([float(shared.value.evidence(t)[at[lang]]) for lang, t in texts if LETTER.search(t)], pa.float64())], names=["evidence"])

    tail = sample.mapInArrow(own_evidence, "evidence double").agg(F.percentile_approx("evidence", EVIDENCE_TAIL, 10_000)).first()[0]
    model.least_evidence = EVIDENCE_PART * float(tail or 0.0)
    return model


def identify(docs: DataFrame, model: LanguageFilter, keep_row: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, evidence) for each row of ``docs``, from its whole text alone; with ``keep_row`` the row as a struct ``row`` too.

    evidence is the share of the text's n-grams that the language explains. Null, empty or letterless texts are ``und`` with score 0. Repeated rows give repeated rows, an
    empty table gives none. A null doc_id is never held out nor learned from. Other columns
    are ignored. Ties go to the first language in alphabetical order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in texts_of(batch.column(2))]
            out = [pa.array([x[0] for x in found], pa.string()), *(pa.array([x[k] for x in found], pa.float64()) for k in (1, 2))]
            row = batch.columns[2:] if keep_row else []
            yield pa.record_batch([*batch.columns[:2], *out, *row], names=["doc_id", "held_out", "lang_pred", "score", "evidence", *["row"] * len(row)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), *text_or_row(docs, keep_row))
    kinds = T.StructType().add("doc_id", "long").add("held_out", "boolean").add("lang_pred", "string").add("score", "double").add("evidence", "double")
    return source.mapInArrow(kernel, kinds.add("row", source.schema["row"].dataType) if keep_row else kinds)
