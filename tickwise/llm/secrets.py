"""Secret scan: fixed patterns, and a guess-cost estimate for values in credential context.

The estimate is the cost, as log10 of guesses, of the cheapest segmentation of the value into words,
words that read plainly (every two neighbours are a pair that prose uses), dates, repeats, keyboard walks
and brute-force spans, found by dynamic programming over its end positions. A value near a credential word
whose cost reaches the threshold is a secret; one made of a word or two, dates or walks is cheap to guess
and stays. Nothing but the cost decides, and a value is costed whole, however long it is.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from tickwise.llm.common import map_batches, texts_of, with_fields

# The base patterns. Letters of the keywords match in either case (ASCII only).
KINDS = ("assign", "access", "hex", "value")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs that are long enough
# Credential context of the method: a wider set of words, a separator or "is", and any run of visible characters.
_CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_ -]?key)?|(?:access|auth|bearer|refresh)?[_ -]?token|api[_ -]?key|private[_ -]?key|credentials?|pin)["'`]?(?:\x20{0,3}[:=]{1,2}>?\x20{0,3}|\x20is:?\x20)["'`]?([^\x00-\x20\x7f-\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]{6,})""", re.ASCII | re.IGNORECASE)
_HINTS = re.compile(r"pass|pwd|secret|token|key|credential|pin", re.ASCII | re.IGNORECASE)

# Frequent words of passwords, most frequent first; a caller may give its own.
COMMON_WORDS = ("password", "pass", "admin", "welcome", "love", "secret", "monkey", "dragon", "master", "login", "user", "test", "root", "hello", "sunshine", "princess", "football", "baseball", "summer", "winter", "spring", "autumn", "shadow", "superman", "letmein", "changeme", "default", "guest", "example", "sample", "demo", "temp", "token", "key", "value", "your", "here", "none", "null", "true", "false", "string", "the", "and", "for", "you", "that", "with", "this", "from")
# The letters that follow each letter in at least eight words of prose (English, French, German, Spanish).
PAIRS = dict(zip("abcdefghijklmnopqrstuvwxyz", (
    "abcdefghijklmnopqrstuvwxyz abcdeijlmnoprstuy abcdefhiklmnoprstuvy abcdefghilmnoprstuvwxy abcdefghijklmnopqrstuvwxyz acdefgilmnoprstuy abcdeghilmnoprstuvwz "
    "abcdeghiklmnoprstuvwyz abcdefghijklmnopqrstvwxz aeou adefgilnrstuwy abcdefgilmnoprstuvy abdefiklmnopstuy abcdefghiklmnopqrstuvwyz abcdefgijklmnopqrstuvwx "
    "acdefhiklnoprstuwy u abcdefghiklmnoprstuvwyz abcdefghijklmnopqrstuvwy abcdefghiklmnoprstuvwxyz abcdefghilmnoprstuvwx aefimo acdefhilnorst acdefhilmoprsty "
    "abcdefhilmnoprstwz aeiostu"
).split(), strict=True))
# A plain word is guessed as one of so many, and is no longer than so many letters; longer ones are several.
PLAIN_WORDS, PLAIN_LENGTH = 60_000, 14
# Repeats and walks: every length up to this many units, then the doubled ones and the longest.
EVERY = 64
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_DATES = (
    (re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"), 36_500),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"), 36_500),
    (re.compile(r"(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\1(?:19|20)\d\d"), 36_500),
    (re.compile(r"(?:19|20)\d\d"), 120),
)


def _alphabet(part: str) -> int:
    return (26 if re.search("[a-z]", part) else 0) + (26 if re.search("[A-Z]", part) else 0) + (10 if re.search("[0-9]", part) else 0) + (33 if re.search("[!-/:-@[-`{-~]", part) else 0) + (0 if part.isascii() else 100)


def _folded(value: str) -> str:
    """Lower case without accents, one character for each of the value's."""
    return "".join(unicodedata.normalize("NFD", c)[0].lower()[:1] if not c.isascii() else c.lower() for c in value)


def _capitals(part: str) -> float:
    """log10 of the ways to place as many capitals."""
    n = sum(c.isupper() for c in part)
    return 0.0 if not n else math.log10(2) if n == len(part) or (n == 1 and part[0].isupper()) else math.log10(math.comb(len(part), n))


def _lengths(most: int, least: int) -> list[int]:
    """least to most; above EVERY only doubled lengths, and the longest."""
    out = list(range(least, min(most, EVERY) + 1))
    step = 2 * EVERY
    while step < most:
        out.append(step)
        step *= 2
    return [*out, most] if most > EVERY else out


def _next_to(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 and p != q


def guess_cost(value: str, words: tuple[str, ...] = COMMON_WORDS) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for an empty value.

    best[j] is the least cost of value[:j], over the spans that end at j: a dictionary word (its
    rank, and its capitals), a plain word of 3 to PLAIN_LENGTH letters (one of PLAIN_WORDS, and its
    capitals; accents are ignored), a date, a repeat of a unit of up to 8 (the unit's brute force, times
    the count), a keyboard walk of three keys or more, or brute force (one span for each run of such
    characters, over the alphabet of the whole value). Each span after the first doubles the guesses.
    The number of spans that end at one place is bounded, so the time grows with the length.
    """
    n = len(value)
    if not n:
        return 0.0
    lower = _folded(value)
    size = math.log10(max(10, _alphabet(value)))
    join = math.log10(2)
    rank = {w: i + 1 for i, w in enumerate(words)}
    longest = max(map(len, words), default=0)
    plain_cost = math.log10(PLAIN_WORDS)
    best = [math.inf] * (n + 1)  # value[:j]
    loose = [math.inf] * (n + 1)  # value[:j], where its last span is brute force
    best[0] = 0.0
    walk = plain = 0
    same = [0] * 9  # how many characters up to here equal the one a unit before them, by unit
    for j in range(1, n + 1):
        def put(i: int, guesses: float, j: int = j) -> None:
            best[j] = min(best[j], best[i] + max(guesses, 0.0) + (join if i else 0))

        loose[j] = min(loose[j - 1] + size, best[j - 1] + size + (join if j > 1 else 0))
        best[j] = loose[j]
        for i in range(max(0, j - longest), j):
            if (r := rank.get(lower[i:j])) is not None:
                put(i, math.log10(r) + _capitals(value[i:j]))
        here = lower[j - 1]
        plain = 0 if here not in PAIRS else plain + 1 if plain and here in PAIRS[lower[j - 2]] else 1
        for width in range(3, min(plain, PLAIN_LENGTH) + 1):
            put(j - width, plain_cost + _capitals(value[j - width : j]))
        if here.isdigit():
            for pattern, guesses in _DATES:
                for width in (4, 8, 10):
                    if j >= width and pattern.fullmatch(value, j - width, j):
                        put(j - width, math.log10(guesses))
        for unit in range(1, min(8, j - 1) + 1):
            same[unit] = same[unit] + 1 if value[j - 1] == value[j - 1 - unit] else 0
            if same[unit] >= unit:
                for times in _lengths(same[unit] // unit + 1, 3 if unit == 1 else 2):
                    put(j - times * unit, unit * size + math.log10(times))
        walk = walk + 1 if j > 1 and _next_to(lower[j - 2], here) else 0
        for steps in _lengths(walk, 2):
            put(j - 1 - steps, math.log10(47) + steps * math.log10(3))
    return best[n]


def _inside(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether sorted spans together cover start to end."""
    for s, e in spans:
        if s <= start:
            start = max(start, e)
    return start >= end


def scan(text: str, *, threshold: float = 10.0, words: tuple[str, ...] = COMMON_WORDS) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost) of the text's secrets by start, then kind; code points, end exclusive."""
    found: list[tuple[str, int, int, float | None]] = []
    hinted = _HINTS.search(text) is not None
    if hinted:
        found += [("assign", m.start(), m.end(), guess_cost(m[2], words)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    if hinted:
        taken = sorted((s, e) for _, s, e, _ in found)
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip("\"'`,;.!?)")
            start, end = m.start(1), m.start(1) + len(value)
            if len(value) < 6 or _inside(taken, start, end):
                continue
            cost = guess_cost(value, words)
            if cost >= threshold:
                found.append(("value", start, end, cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_SCHEMA = "array<struct<kind:string,start:int,end:int,cost:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))


def find_secrets(docs: DataFrame, *, threshold: float = 10.0, words: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """docs(text, ...) -> the same columns plus secrets array<struct<kind, start, end, cost>>.

    Kinds: assign, access and hex by pattern, value by guess cost in credential context, the whole run of
    visible characters of any script (a value inside the patterns' spans adds nothing; one that reaches beyond them overlaps). cost is log10 of guesses, null for access and hex. A null
    or empty text has an empty array. No shuffle; each row stands alone. An input column named
    secrets is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c != "secrets"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": k, "start": s, "end": e, "cost": c} for k, s, e, c in scan(t, threshold=threshold, words=words)] for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, type=_SPAN)], names=[*batch.schema.names, "secrets"])

    return map_batches(docs, run, with_fields(docs, f"secrets {_SCHEMA}"))


def redact_secrets(docs: DataFrame, *, threshold: float = 10.0, words: tuple[str, ...] = COMMON_WORDS, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret of text replaced by the mark; overlapping spans become one. Null texts stay null."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, start, end, _ in scan(text, threshold=threshold, words=words):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if at else text

    where = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.set_column(where, "text", pa.array([clean(t) for t in batch.column(where).to_pylist()], type=pa.string()))

    return map_batches(docs, run, docs.schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
