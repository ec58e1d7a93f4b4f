"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Besides the patterns, every longer token of letters and digits is a candidate.
Its encoding is inferred (the smallest alphabet that holds it), and four tests
ask whether its symbols look drawn evenly from that alphabet: chi-squared on
the symbol counts, the runs above and below the middle, the runs of symbols of
one sort (digits, small and capital letters, signs), of which names and slugs
have few and long ones, and the correlation of neighbours.  Fisher's method
joins their p-values.  A random token's joint p-value is uniform; that of a
word or a structured name is small.

How small is too small is settled per class of encoding and length from all
distinct candidates of the corpus: p-values above one half tell how many random
tokens the class holds, so for each cut the surplus above what they explain is
the share of false discoveries.  The lowest cut that keeps it within ``rate``
stands, but none leaves out more than ``MOST`` of the random tokens: what is
left in a text by mistake is worse than what is hidden by mistake.  A class with
few random tokens of its own is settled with those of other lengths of its
encoding, else with all of its length, else with all; where even these are few,
a fixed level stands, higher for short tokens, in which structure is hard to
tell.  So a token that is alone in its class is found for its own sake.  Only a
histogram of fixed size reaches the driver.

Defined cases: a null text counts as empty; an empty text has no spans;
positions are code points, ends exclusive; repeated documents are scanned row
by row, but a token counts once in the histogram; an empty table gives no rows.
Tokens without a letter are no candidates, nor those of letters alone unless
capitals and small ones change more than words' do.  Spans of the battery that touch a span of the patterns are left to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import fresh, map_texts, named, small_batches, table, text_rows

# The patterns of the base kinds, in the order of the kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

#: Candidates: the shortest, the share of false discoveries, the bins of the p-value histogram.
LEAST_TOKEN, RATE, BINS = 16, 0.05, 40
#: The largest cut; the random tokens (by those above one half) that settle a class; the levels where there are fewer, by length class.
MOST, ENOUGH, LEVELS = 0.1, 40, (0.1, 0.05, 0.025)
#: Changes between capital and small letters that make a candidate of letters alone.
CHANGES = 4
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "base64any": _UPPER + _LOWER + _DIGITS + "+/-_",
}
_SORTS = {c: sort for sort, members in enumerate((_DIGITS, _LOWER, _UPPER, "+/-_")) for c in members}
LENGTHS = (20, 24, 32, 40, 64, 128)


@dataclass
class _Patterns:
    assign: re.Pattern = field(default_factory=lambda: re.compile(ASSIGN, re.IGNORECASE | re.ASCII))
    access: re.Pattern = field(default_factory=lambda: re.compile(ACCESS))
    hex: re.Pattern = field(default_factory=lambda: re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}"))
    letter: re.Pattern = field(default_factory=lambda: re.compile("[A-Za-z]"))
    digit: re.Pattern = field(default_factory=lambda: re.compile("[0-9]"))
    change: re.Pattern = field(default_factory=lambda: re.compile("[a-z](?=[A-Z])|[A-Z](?=[a-z])"))
    token: re.Pattern = field(default_factory=lambda: re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}"))


def base_spans(text: str, patterns: _Patterns) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in patterns.assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in patterns.access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in patterns.hex.finditer(text)]
    return sorted(out)


def candidates(text: str, patterns: _Patterns) -> list[tuple[int, int]]:
    """Start and end of the tokens that hold a letter, and a digit or many changes of case."""
    if not any(len(w) >= LEAST_TOKEN and not (w.isalpha() and (w.islower() or w[1:].islower())) for w in text.split()):
        return []
    found = (m for m in patterns.token.finditer(text))
    return [m.span() for m in found if patterns.letter.search(m[0]) and (patterns.digit.search(m[0]) or len(patterns.change.findall(m[0])) >= CHANGES)]


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token."""
    used = set(token)
    return next((name for name, alphabet in ENCODINGS.items() if used <= set(alphabet)), None)


def length_class(n: int) -> int:
    return sum(n >= edge for edge in LENGTHS)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _few_changes(token: str, alphabet: str) -> float:
    """The chance of so few changes between sorts of symbols, or fewer; 1 where the alphabet has one sort."""
    shares = np.bincount([_SORTS[c] for c in alphabet]) / len(alphabet)
    same = float((shares**2).sum())
    if same == 1:
        return 1.0
    sorts = np.array([_SORTS[c] for c in token])
    n = len(sorts) - 1
    # Neighbouring changes hang together: two of them in a row need three unequal sorts.
    twice = 1 - 2 * same + float((shares**3).sum())
    variance = n * same * (1 - same) + 2 * (n - 1) * (twice - (1 - same) ** 2)
    z = (int((sorts[1:] != sorts[:-1]).sum()) + 0.5 - n * (1 - same)) / math.sqrt(variance)
    return 0.5 * math.erfc(-z / math.sqrt(2))


def p_values(token: str, alphabet: str) -> tuple[float, ...]:
    """Of chi-squared, both runs tests and serial correlation, under even and independent symbols."""
    n, k = len(token), len(alphabet)
    place = {c: i for i, c in enumerate(alphabet)}
    symbols = np.array([place[c] for c in token], float)
    counts = np.bincount(symbols.astype(int), minlength=k)
    ratio = (float((counts**2).sum()) * k / n - n) / (k - 1)
    spread = 2 / (9 * (k - 1))  # Wilson and Hilferty: the cube root is about normal
    chi = 0.5 * math.erfc((ratio ** (1 / 3) - 1 + spread) / math.sqrt(2 * spread)) if ratio > 0 else 1.0
    high = symbols >= k / 2
    up = int(high.sum())
    down = n - up
    runs_p = 0.0
    if up and down:
        mean = 2 * up * down / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        runs_p = _two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else float(runs == mean)
    centred = symbols - symbols.mean()
    energy = float((centred**2).sum())
    serial = _two_sided(float((centred[1:] * centred[:-1]).sum()) / energy * math.sqrt(n)) if energy else 0.0
    one_sort = len({_SORTS[c] for c in alphabet}) == 1
    return (chi, runs_p, serial) if one_sort else (chi, runs_p, serial, _few_changes(token, alphabet))


def joint(ps: tuple[float, ...]) -> float:
    """Fisher's method: the chance of a smaller product of uniform p-values."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(ps)))


def judged(token: str) -> tuple[str, int, float] | None:
    """Encoding, length class and joint p-value."""
    name = encoding_of(token)
    return name and (name, length_class(len(token)), joint(p_values(token, ENCODINGS[name])))


def _cut(counts: np.ndarray, rate: float) -> float:
    """The lowest p-value that keeps false discoveries within ``rate``, MOST at most."""
    bins = len(counts)
    random = 2 * counts[bins // 2 :].sum()
    above = counts[::-1].cumsum()[::-1]
    for i in range(int(bins * MOST) + 1):
        if above[i] - random * (1 - i / bins) <= rate * above[i]:
            return i / bins
    return MOST


class Cuts:
    """The least joint p-value of a random token, by class."""

    def __init__(self, histogram: dict[tuple[str, int], np.ndarray] | None = None, rate: float = RATE) -> None:
        histogram = histogram or {}
        self.own = {kind: _cut(h, rate) for kind, h in histogram.items() if self._enough(h)}
        self.pooled: dict[object, float] = {}
        pools: dict[object, np.ndarray] = {}
        for (name, length), counts in histogram.items():
            for pool in (name, length, None):
                pools[pool] = pools.get(pool, 0) + counts
        self.pooled = {pool: _cut(h, rate) for pool, h in pools.items() if self._enough(h)}

    @staticmethod
    def _enough(counts: np.ndarray) -> bool:
        return 2 * counts[len(counts) // 2 :].sum() >= ENOUGH

    def of(self, name: str, length: int) -> float:
        if (name, length) in self.own:
            return self.own[name, length]
        found = [self.pooled[pool] for pool in (name, length, None) if pool in self.pooled]
        return found[0] if found else LEVELS[min(length, len(LEVELS) - 1)]


def learn_cuts(docs: DataFrame, text: str = "text", rate: float = RATE) -> Cuts:
    """The cuts from the distinct candidates of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _Patterns()
        for batch in text_rows(batches, 0):
            rows = []
            for value in batch.column(0).to_pylist():
                for start, end in candidates(value or "", patterns):
                    if found := judged(value[start:end]):
                        digest = hashlib.blake2b(value[start:end].encode(), digest_size=8).digest()
                        rows.append((*found[:2], min(BINS - 1, int(found[2] * BINS)), int.from_bytes(digest, "big", signed=True)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["encoding", "length", "bin", "token"])

    seen = docs.select(F.col(text).alias("text")).transform(small_batches).mapInArrow(run, "encoding string, length int, bin int, token long").distinct()
    out: dict[tuple[str, int], np.ndarray] = {}
    for r in seen.groupBy("encoding", "length", "bin").count().collect():
        out.setdefault((r["encoding"], r["length"]), np.zeros(BINS))[r["bin"]] = r["count"]
    return Cuts(out, rate)


def all_spans(text: str, patterns: _Patterns, limits: Cuts) -> list[tuple[int, int, int]]:
    """The spans of the patterns and those the battery adds, in order."""
    base = base_spans(text, patterns)
    found = []
    for start, end in candidates(text, patterns):
        if any(s < end and start < e for s, _, e in base):
            continue
        what = judged(text[start:end])
        if what and what[2] >= limits.of(*what[:2]):
            found.append((start, 3, end))
    return sorted(base + found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanned(docs: DataFrame, limits: Cuts, keys: list[str], text: str = "text") -> DataFrame:
    """The keys with ``spans``, an array of (kind, start, end)."""
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def work():
        patterns = _Patterns()
        return lambda texts: [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t or "", patterns, limits)] for t in texts]]

    return map_texts(docs, keys, text, [T.StructField("spans", T.ArrayType(kind))], work)


def hide(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All documents with their secrets hidden; ``n_chars``, where there is one, follows the text."""
    limits = learn_cuts(docs, text)
    names = docs.columns

    def work():
        patterns = _Patterns()

        def each(texts):
            out = []
            for t in texts:
                spans = all_spans(t or "", patterns, limits)
                out.append(hide(t, spans) if spans else None)
            return [out]

        return each

    found = fresh("__hidden", names)
    done = map_texts(docs, names, text, [T.StructField(found, T.StringType())], work)
    columns = {text: F.coalesce(F.col(found), named(text))}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col(found).isNotNull(), F.length(found).cast(kind)).otherwise(F.col("n_chars"))
    return done.select(*(columns[c].alias(c) if c in columns else named(c) for c in names))


def secrets_of_documents(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans of every document."""
    docs = table(spark, directory, "documents")
    limits = learn_cuts(docs)
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def work():
        patterns = _Patterns()

        def each(texts):
            columns: list[list] = [[] for _ in fields]
            for t in texts:
                spans = all_spans(t or "", patterns, limits)
                base = [s for s in spans if s[1] < 3]
                row = [*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            return columns

        return each

    return map_texts(docs, ["doc_id"], "text", fields, work)
