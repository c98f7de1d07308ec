"""Secret scans: fixed patterns, and password values whose guess cost is high.

The guess cost of a value is the least sum, over its cuts into spans, of the spans' log10 guesses:
known words (by rank), dates, repeats, keyboard walks, sequences and brute force. A dynamic
programme over end positions finds it. It is applied to values in a credential context.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.batches import text_or_row, texts_of
from tracewell.llm.storage import materialise

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words that announce a credential. Each match of the longer pattern below contains one of them.
CUES = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"pin")
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)?[_-]?key|credentials?|auth|pin)["']?\x20*(?::|=|=>|\bis\b)\x20*["']?([!-&(-~]{6,})""", re.I | re.A)
KINDS = ("assign", "access", "hex", "guess")
#: Values of at least this many log10 guesses are secrets.
MIN_COST = 9.0
#: Frequent passwords and words, the most frequent first. Those of a corpus follow them.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login abc iloveyou sunshine princess football "
    "shadow secret test guest root default changeme hello freedom whatever trustno summer winter spring autumn love "
    "user server system access token key example sample the and for with this that from have your not are you was all "
    "can one new use our out day get has him his how man now old see two way who its did yes her may say she time"
).split()
#: Words that a corpus adds, of so many letters.
CORPUS_WORDS, LETTERS = 20_000, (3, 20)
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!$57", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


def tandem_runs(value: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of the longest stretches in which each character stands again ``unit`` places later, at least two units long, units ascending.

    Such a stretch holds a multiple of its unit, so only these places are tried and extended both ways: n log n trials. Units that repeat a shorter one are left out.
    """
    out, n = [], len(value)
    for unit in range(1, n // 2 + 1):
        for x in range(0, n - unit, unit):
            if value[x] != value[x + unit] or any(unit % q == 0 and a <= x and x + unit < b for a, b, q in out):
                continue
            a, b = x, x + unit + 1
            while a and value[a - 1] == value[a - 1 + unit]:
                a -= 1
            while b < n and value[b] == value[b - unit]:
                b += 1
            if b - a >= 2 * unit:
                out.append((a, b, unit))
    return out


class GuessCost:
    """log10 of the guesses that the cheapest cut of a value needs.

    A repeat costs the cheapest cut of its unit, of any length, and the number of times. Costs up to ``limit`` are exact; above it, units that cost more
    alone are not looked into, so that a long value is costed in proportion to its length.
    """

    def __init__(self, words: list[str] = WORDS, limit: float = MIN_COST):
        self.limit = limit
        self.cost = {}
        for rank, w in enumerate(words, 1):
            self.cost.setdefault(w, math.log10(rank + 1))
        self.longest = max(map(len, self.cost), default=0)
        self.next_key = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
        self.next_key |= {(b, a) for a, b in self.next_key}

    @staticmethod
    def _alphabet(value: str) -> int:
        return sum(n for test, n in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10), (lambda c: not c.isalnum(), 33)) if any(map(test, value))) or 1

    @staticmethod
    def _runs(hits: list[bool]) -> list[int]:
        """How many hits in a row begin at each place."""
        out, run = [], 0
        for hit in reversed(hits):
            run = run + 1 if hit else 0
            out.append(run)
        return out[::-1]

    def spans(self, value: str) -> Iterator[tuple[int, int, str, float]]:
        """(start, end, kind, cost) of all spans but repeats and brute force."""
        low, n = value.lower(), len(value)
        plain = low.translate(LEET)
        # from each place on, how many characters continue a walk or sequence: one pass each
        near = {"walk": lambda a, b: (a, b) in self.next_key, "sequence": lambda a, b: abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum()}
        steps = {kind: [*self._runs([test(a, b) for a, b in zip(low, low[1:], strict=False)]), 0] for kind, test in near.items()}
        for i in range(n):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                for form, extra in ((low, 0.0), (plain, 0.6)):
                    if (c := self.cost.get(form[i:j])) is not None:
                        mixed = 0.0 if value[i:j].islower() or not value[i:j].isalpha() else 0.3 if value[i:j].istitle() or value[i:j].isupper() else 1.0
                        yield i, j, "word", c + extra + mixed
            for kind, run in steps.items():
                if run[i] >= 2:
                    yield i, i + 1 + run[i], kind, 2.0 + math.log10(1 + run[i])
        for m in DATE.finditer(value):
            yield *m.span(), "date", math.log10(36_500 if m.end() - m.start() > 4 else 130)

    def _unit_cost(self, spans: dict[int, list], start: int, size: int, per: float) -> float | None:
        """The cheapest cut of ``size`` characters from ``start`` on; None above the limit."""
        best, reached = {0: 0.0}, 0
        for at in range(size):
            if at > reached:
                return None
            if (cost := best.pop(at, self.limit + 1)) > self.limit:
                continue
            more = 0.3 * (at > 0)
            for end, step in [(at + 1, per), *((j - start, c + more) for j, _, c in spans.get(start + at, ()))]:
                if end <= size and cost + step <= min(self.limit, best.get(end, self.limit)):
                    best[end], reached = cost + step, max(reached, end)
        return best.get(size)

    def segment(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """The least cost and its spans in order."""
        per, spans = math.log10(self._alphabet(value)), {}
        for i, j, kind, c in self.spans(value):
            spans.setdefault(i, []).append((j, kind, c))
        for a, b, unit in tandem_runs(value.lower()):
            own = math.log10(self._alphabet(value[a : a + unit]))
            for first in range(a, min(a + unit, b - 2 * unit + 1)):
                if (cost := self._unit_cost(spans, first, unit, own)) is not None:
                    for i in range(first, b - 2 * unit + 1, unit):
                        if (times := (b - i) // unit) * unit >= 3:
                            spans.setdefault(i, []).append((i + unit * times, "repeat", cost + math.log10(times)))
        by_end: dict[int, list] = {}
        for i, own in spans.items():
            for j, kind, c in own:
                by_end.setdefault(j, []).append((i, kind, c))
        best: list[tuple[float, int, str]] = [(0.0, 0, "")]
        for j in range(1, len(value) + 1):
            options = [(best[j - 1][0] + per, j - 1, "brute")]
            options += [(best[i][0] + c + 0.3 * (i > 0), i, kind) for i, kind, c in by_end.get(j, ())]
            best.append(min(options))
        cut, at = [], len(value)
        while at:
            _, start, kind = best[at]
            cut.append((start, at, kind))
            at = start
        return best[-1][0], cut[::-1]


def find_secrets(text: str, guess: GuessCost, min_cost: float = MIN_COST) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind; base spans whatever the guess cost, and others at ``min_cost`` or more."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if any(c in raw for c in CUES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        taken = sorted((a, b) for a, b, _ in found)
        starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            value = m[1].rstrip(".,;:)\"")
            b = a + len(value)
            before = bisect_right(starts, a)
            if len(value) >= 6 and not (before and ends[before - 1] >= b) and guess.segment(value)[0] >= min_cost:
                found.append((a, b, "guess"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def ranked_words(docs: DataFrame, most: int = CORPUS_WORDS) -> list[str]:
    """WORDS, then the ``most`` words of ASCII letters that most documents hold (ties: in order of the alphabet), lower-cased; whole texts are read.

    Null and empty texts, and an empty table, add none. The list has a bounded length and goes to every task.
    """
    words = F.array_distinct(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+"))
    counts = docs.select(F.explode(words).alias("word")).where(F.length("word").between(*LETTERS)).groupBy("word").agg(F.count("*").alias("n"))
    # tasks send only words of the steps of frequency that are needed, an eighth of an octave each
    counts = materialise(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "word-counts")
    held, least = 0, 0
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):
        held, least = held + r["count"], r["step"]
        if held >= most:
            break
    found = [r["word"] for r in counts.where(F.col("step") >= least).orderBy(F.desc("n"), "word").limit(most).collect()]
    return list(dict.fromkeys([*WORDS, *found]))


def _spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, min_cost: float = MIN_COST, words: list[str] = WORDS, redact: str | None = None, keep_row: bool = False) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans and redacted.

    spans has all spans, base_sha256 the SHA-256 of the spelled base spans. redacted is the text
    with each covered stretch replaced by ``redact`` (null if that is None or the text is null); ``keep_row`` adds the row as a struct ``row``. A null
    text counts as empty; repeated rows give repeated rows; an empty table gives none; other
    columns are ignored. Very long texts are scanned and values costed whole; spans that begin together come in the order of their kinds. A value in a credential context that a base span
    covers only in part has a span of its own, which overlaps the base span.
    """

    def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
        if redact is None or text is None:
            return None
        out, at, till = [], 0, 0
        for a, b, _ in spans:
            if a >= till:
                out += [text[at:a], redact]
            at = till = max(till, b)
        return "".join([*out, text[at:]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = GuessCost(words, min_cost)
        for batch in batches:
            rows = []
            for one in texts_of(batch.column(1)):
                text = one.as_py()
                spans = find_secrets(text or "", guess, min_cost)
                base = [s for s in spans if s[2] != "guess"]
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:3]), hashlib.sha256(_spelled(base).encode()).hexdigest(), _spelled(spans), redacted(text, spans)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)), *[batch.column(1)] * keep_row], names=[*names, *["row"] * keep_row])

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_or_row(docs, keep_row))
    kinds = T.StructType()
    for name in names:
        kinds = kinds.add(name, "long" if name.startswith(("doc", "n_")) else "string")
    return source.mapInArrow(kernel, kinds.add("row", source.schema["row"].dataType) if keep_row else kinds)
