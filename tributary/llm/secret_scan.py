"""Secret scans: three base patterns, and values in credential contexts judged by their guess cost.

The cost of a value is the least total of a segmentation into known words, dates, repeats, keyboard walks
and brute-force spans, in bits, found by dynamic programming over its end positions. Placeholders
such as `changeme2024` are cheap; a generated key is not. Each position looks at words and dates of
bounded length and at the one repeat and the one walk that ends there, so the work is linear in the value.

Texts are scanned whole, row by row, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Kinds of spans, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "guess")
#: A value in a credential context is a secret if it takes at least so many bits to guess ...
MIN_BITS = 40.0
#: ... and has at least so many characters.
MIN_LENGTH = 8

# The case of letters is spelled out: re.IGNORECASE would also match letters outside ASCII.
either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + ")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
# A context begins at a word's start: not inside letters, but where case changes (dbPassword).
CONTEXT = re.compile(
    "(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?:" + "|".join(map(either, ("password", "passphrase", "passwd", "passcode", "pwd", "secret", "token", "api[_ -]?key", "access[_ -]?key", "private[_ -]?key", "credentials?", "auth", "bearer", "pin"))) + ")"
    "[\"']?\\s{0,8}(?:[:=]|=>|:=)\\s{0,8}[\"'`]?(?:" + either("bearer") + "\\s{1,8})?([^\\s\"'`,;<>()\\[\\]{}|]+)"
)
#: Bearer tokens behind a blank. In prose a word may follow: outside of a header the token has a digit or changes case.
BEARER = re.compile("(?:" + either("authorization") + "[\"']?\\s{0,8}[:=]\\s{0,8}[\"'`]?" + either("bearer") + "\\s{1,8}|" + either("bearer") + "\\s{1,8}(?=\\S{0,512}?(?:[0-9]|[a-z][A-Z])))(?![:=])([^\\s\"'`,;<>()\\[\\]{}|]+)")

#: Words that people put into passwords and placeholders, the more frequent first: a word costs log2 of its place.
WORDS = """password admin test user secret login welcome letmein master dragon monkey qwerty hello change me
token key example sample demo default guest root pass access public private none null true false abc love
sun moon summer winter spring autumn monday friday sunday football baseball shadow michael jordan star super
hunter ninja angel prince princess flower cookie cheese coffee orange apple banana purple blue green red black white
silver gold money power magic happy lucky secure safe server client host database data service system admin
company office team work home house my your the this that is not here there new old big one two three four five
api app web dev prod stage local changeme placeholder xxx insert value string todo fixme""".split()
COST_OF_WORD = {w: math.log2(i + 2) for i, w in reversed(list(enumerate(WORDS)))}
LONGEST_WORD = max(map(len, WORDS))
LEET = str.maketrans("0134578@$!", "oieastbasi")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
NEIGHBOURS = {pair for row in ROWS for line in (row, row[::-1]) for pair in zip(line, line[1:])}
DATE = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?$|(?:0?[1-9]|[12]\d|3[01])([-/.]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d$")


def brute_bits(c: str) -> float:
    """Bits of one character that no pattern explains, by its class."""
    return math.log2(10) if c in "0123456789" else math.log2(26) if c.isascii() and c.isalpha() else math.log2(33) if c.isascii() else 8.0


#: Punctuation that joins words and doesn't widen the alphabet of a value.
JOINERS = "-_./:@"


def brute_of(value: str) -> Callable[[str], float]:
    """The cost of a character if the value's letters, digits and symbols are drawn from all classes that occur in it.

    A capital at the start alone is no class, nor are joiners."""
    body = value.rstrip(".!?")
    lower, upper, digit = any("a" <= c <= "z" for c in body), any("A" <= c <= "Z" for c in body[1:]), any("0" <= c <= "9" for c in body)
    symbol = any(c.isascii() and not c.isalnum() and c not in JOINERS for c in body)
    wide = math.log2(max(1, 26 * (lower + upper) + 10 * digit + 33 * symbol))
    narrow = lambda c: not c.isascii() or not c.isalnum() and not symbol or lower + upper + digit + symbol < 2
    return lambda c: brute_bits(c) if narrow(c) else max(wide, brute_bits(c))


@dataclass(frozen=True)
class Costs:
    """Words with the bits that each costs, and the length of the longest."""

    of: dict[str, float]
    longest: int

    @classmethod
    def ranked(cls, words: Sequence[str]) -> Costs:
        """The more frequent first: a word costs log2 of its place."""
        return cls({w: math.log2(i + 2) for i, w in reversed(list(enumerate(words)))}, max(map(len, words)))


def guess_bits(value: str, brute_bits: Callable[[str], float] = brute_bits, costs: Costs | None = None) -> float:
    """The least cost of any segmentation of the value, in bits. Each segment besides the first costs one bit more."""
    cost_of, longest = (costs.of, costs.longest) if costs else (COST_OF_WORD, LONGEST_WORD)
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    run = walk = 0  # where the repeat and the walk that end here begin
    for end in range(1, n + 1):
        c, joint = value[end - 1], lambda start: best[start] + (start > 0)
        cost = best[end - 1] + brute_bits(c)
        if end > 1:
            run = run if c == value[end - 2] else end - 1
            walk = walk if (low[end - 2], low[end - 1]) in NEIGHBOURS else end - 1
        if end - run >= 3:
            cost = min(cost, joint(run) + brute_bits(c) + math.log2(end - run))
        if end - walk >= 3:
            cost = min(cost, joint(walk) + math.log2(47) + math.log2(end - walk))
        for start in range(max(0, end - longest), end - 1):
            word = cost_of.get(low[start:end])
            if word is None and (word := cost_of.get(plain[start:end])) is not None:
                word += 1.0
            if word is not None:
                case = 0.0 if value[start:end] == low[start:end] else 1.0 if value[start + 1 : end] == low[start + 1 : end] else end - start
                cost = min(cost, joint(start) + word + case)
        if c in "0123456789":
            for start in range(max(0, end - 10), end - 3):
                if DATE.match(value[start:end]):
                    cost = min(cost, joint(start) + math.log2(365.25 * 100) + (0 if value[start:end].isdigit() else 2))
        best[end] = cost
    return best[n]


def frequent_words(definition: str) -> list[str]:
    """`WORDS`, and then the whole words of a public tokenizer's vocabulary: pieces behind a blank, in order of their
    rank, which is about that of their frequency. Words of less than four letters cost no less than their letters."""
    vocabulary = json.loads(definition)["model"]["vocab"]
    found = (token[1:] for token, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if re.fullmatch("\u0120[a-z]{4,16}", token))
    return list(dict.fromkeys([*WORDS, *found]))


def find_spans(text: str, min_bits: float = MIN_BITS, min_length: int = MIN_LENGTH, costs: Costs | None = None) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text by start, then kind: code points, end exclusive."""
    spans, found = [], {}
    if ":" in text or "=" in text:
        assigned = [m for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        spans += [("assign", *m.span()) for m in assigned]
        based = {m.start(2) for m in assigned}
        found = {m.start(1): m for m in CONTEXT.finditer(text) if m.start(1) not in based}
    if "bearer" in text.lower():
        based = {s[2] for s in spans}
        found = {m.start(1): m for m in BEARER.finditer(text) if m.end() not in based} | found
    for start, m in found.items():
        # Punctuation behind a value is its own if it's too short without.
        value = stripped if len(stripped := m[1].rstrip(".!?")) >= min_length else m[1]
        if len(value) >= min_length and guess_bits(value, brute_of(value), costs) >= min_bits:
            spans.append(("guess", start, start + len(value)))
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if long_hex(text):
        spans += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


AS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def long_hex(text: str) -> bool:
    """Whether a run of 32 hex digits is there at all: one table pass over the bytes, far quicker than the pattern."""
    return b"x" * 32 in text.encode("utf-8", "surrogatepass").translate(AS_HEX)


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_bits: float = MIN_BITS, min_length: int = MIN_LENGTH, words: Sequence[str] = WORDS) -> DataFrame:
    """(id, spans): for each row the array of (kind, start, end) structs, as `find_spans` orders them.

    `words`: the dictionary, the more frequent first. Null texts count as empty; null ids, ties and repeated rows are kept
    row by row; very long texts are scanned whole in linear time; an empty table gives an empty result; further columns are dropped.
    """
    costs = Costs.ranked(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            told = [[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t.as_py() or "", min_bits, min_length, costs)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, kind)], ["key", "spans"])

    rows = pick(documents, key=id_column, text=text_column)
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, spans array<struct<kind:string,start:int,end:int>>")
    return found.select(F.col("key").alias(id_column), "spans")


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
