"""Secret scan: fixed patterns, and values in credential context that are costly to guess.

Patterns find assignments to credential names, access keys and long hexadecimal runs. On top of them, every
value in a credential context (an assignment, also to rarer names, or a phrase like "password is ...")
gets a guess cost: the cheapest segmentation of the value into words, dates, repeats,
keyboard walks, sequences and brute-force stretches, found by dynamic programming over end positions. A
value whose cost reaches ``least_cost`` (log10 of guesses) is a secret and adds a ``guess`` span; so an
assignment of "password" to itself or of a word and a year is told from a random key.

Texts are scanned whole, row by row, so no key can be hot. Long values are segmented in time
linear in their length, because no segment but a brute-force stretch or a repeat is longer than
``LONGEST`` characters. Defined cases: null text is empty; values of fewer than 6 characters are ignored;
offsets are code points, ends exclusive; equal rows give equal spans; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.tables import sha256_hex, table

LEAST_VALUE = 6
LEAST_COST = 10.0
LONGEST = 24

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# these take a whole run, so that the least length (20 and 24 characters) can be part of the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Further credential contexts; group 1 is the value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api_?key|private_?key|access_?key|credentials?|auth|login|bearer)["']?"""
    r"""(?:\x20*(?:[:=]|=>|:=)\x20*|\x20+(?:is|was|=)\x20+)["']?([^\s"'<>,;]{6,})""",
    re.I | re.A,
)
#: What a text must hold for any context to match: cheap to look for.
HINT = re.compile(r"pass|pwd|pin|secret|token|key|credential|auth|login|bearer", re.I | re.A)

# fixed values: usual words in passwords, the commonest first
WORDS = (
    "password pass admin login welcome letmein qwerty dragon monkey master hello love secret token key test user guest root default "
    "changeme example sample dummy public private access system server database service account summer winter spring autumn "
    "football baseball soccer hockey princess sunshine shadow michael jordan super magic trust freedom whatever computer internet "
    "iloveyou batman superman pokemon starwars cookie banana orange cheese flower purple yellow silver golden black white green blue red "
    "monday friday january march april june july august october december "
    "the and for you not with that this from your mail email phone name home work your none null true false empty value string"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(dict.fromkeys(WORDS))))}
KEYS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@310$57", "aaeiosst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)")
REPEAT = re.compile(r"(.{1,24}?)\1+", re.S)
KEY_AT = {c: (row, col) for row, line in enumerate(KEYS) for col, c in enumerate(line)}


def _alphabet(text: str) -> int:
    """Size of the character classes that a value draws from."""
    size = 0
    size += 10 if re.search(r"[0-9]", text) else 0
    size += 26 if re.search(r"[a-z]", text) else 0
    size += 26 if re.search(r"[A-Z]", text) else 0
    size += 33 if re.search(r"[^A-Za-z0-9]", text) else 0
    return max(10, size)


def segments(value: str) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, log10 guesses) of every guessable stretch."""
    lower, n = value.lower(), len(value)
    plain = lower.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = RANK.get(lower[i:j])
            kind = "word"
            if rank is None:
                rank, kind = RANK.get(plain[i:j]), "leet"
            if rank is not None:
                part = value[i:j]
                case = 1 if part == lower[i:j] else 2 if part == part.capitalize() or part.isupper() else 2 ** min(12, sum(c.isupper() for c in part))
                yield i, j, "word", math.log10(2 * rank * case * (1 if kind == "word" else 4))
    for m in re.finditer(r"(?=(" + DATE.pattern + "))", value):
        size = len(m[1])
        yield m.start(1), m.end(1), "date", math.log10(150 * (1 if size == 4 else 12 if size <= 7 else 365))
    for m in REPEAT.finditer(value):
        unit = m[1]
        yield m.start(), m.end(), "repeat", math.log10(_alphabet(unit) ** min(len(unit), 12) * (m.end() - m.start()) / len(unit))
    at = 0
    while at < n - 2:
        end = at + 1
        turns, last = 0, None
        while end < n and end - at < LONGEST:
            a, b = KEY_AT.get(lower[end - 1]), KEY_AT.get(lower[end])
            step = (b[0] - a[0], b[1] - a[1]) if a and b else None
            if step is None or max(map(abs, step)) != 1:
                break
            turns += step != last
            last, end = step, end + 1
        if end - at >= 4:
            yield at, end, "walk", math.log10(94 * (end - at) * 8.0**turns)
        end = at + 1
        step = 0
        while end < n and end - at < LONGEST:
            d = ord(value[end]) - ord(value[end - 1])
            if abs(d) != 1 or (step and d != step):
                break
            step, end = d, end + 1
        if end - at >= 3:
            yield at, end, "sequence", math.log10(26 * (end - at))
        at += 1


def guess_cost(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """Least log10 guesses over all segmentations of ``value``, and the segmentation."""
    n = len(value)
    unit = math.log10(_alphabet(value))
    by_end: dict[int, list[tuple[int, str, float]]] = {}
    for i, j, kind, cost in segments(value):
        by_end.setdefault(j, []).append((i, kind, cost))
    # a segment costs a little more, for the attacker must guess where it ends
    best = [0.0] + [math.inf] * n
    came: list[tuple[int, str]] = [(0, "")] * (n + 1)
    for j in range(1, n + 1):
        brute = best[j - 1] + unit + (0.3 if came[j - 1][1] != "brute" else 0.0)
        best[j], came[j] = brute, (j - 1, "brute")
        for i, kind, cost in by_end.get(j, ()):
            total = best[i] + cost + 0.3
            if total < best[j]:
                best[j], came[j] = total, (i, kind)
    parts: list[tuple[int, int, str]] = []
    j = n
    while j:
        i, kind = came[j]
        if kind == "brute" and parts and parts[-1][2] == "brute" and parts[-1][0] == j:
            parts[-1] = (i, parts[-1][1], kind)
        else:
            parts.append((i, j, kind))
        j = i
    return best[n], parts[::-1]


ORDER = {"assign": 0, "access": 1, "hex": 2, "guess": 3}


def scan_text(text: str, least_cost: float = LEAST_COST) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, each ordered by start and kind.

    Base matches are leftmost and do not overlap within a kind; a match with a short value is consumed but dropped.
    """
    base = [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]
    costly = []
    if HINT.search(text):
        values = {m.span(1) for m in CONTEXT.finditer(text)}
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                base.append(("assign", *m.span()))
                values.add(m.span(2))
        costly = [("guess", a, b) for a, b in values if guess_cost(text[a:b])[0] >= least_cost]
    order = lambda s: (s[1], ORDER[s[0]], s[2])
    base.sort(key=order)
    return base, sorted(base + costly, key=order)


def scan_documents(docs: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every whole text of ``docs(doc_id, text)``."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py() or "", least_cost) for t in batch.column(1)]
            cols = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f[side]] for f in found], span) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "base", "spans"])

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = "array<struct<kind:string,start:long,end:long>>"
    return picked.mapInArrow(run, f"doc_id {picked.schema[0].dataType.simpleString()}, base {kind}, spans {kind}")


def redact(docs: DataFrame, least_cost: float = LEAST_COST, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one); all other columns and rows stay."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t in batch.column(at):
                text = t.as_py()
                if text:
                    out, end = [], 0
                    for _, a, b in scan_text(text, least_cost)[1]:
                        if b <= end:
                            continue
                        if a >= end:
                            out += [text[end:a], mark]
                        end = b
                    text = "".join(out) + text[end:] if end else text
                texts.append(text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def shown(spans: str):
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts and digest of the base spans, and all spans."""
    found = scan_documents(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, sha256_hex(shown("base")).alias("base_sha256"), shown("spans").alias("spans"))
