"""Quality scores of documents: boosted trees over statistics of the text.

The statistics of a text need nothing but the text, so scoring is one pass
without a shuffle.  The trees are fitted on the driver, on a sample of labelled
rows bounded by ``sample_rows``; everything else covers all rows.

Defined cases: a null text counts as empty; an empty text has all statistics
zero and gets a score like any other; a document with several label rows counts
with the mean of those that are not null (0.5 and more is 1); without usable
labels every score is 0.5; repeated documents are scored row by row; an empty
table gives no rows.  Columns besides the named ones are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import fold, fresh, map_texts, named, table
from inkveil.llm.gbt import Forest, Settings, fit

SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
KEEP_FROM = 0.3

_MARKS = ".,;:!?\"'()-"
NAMES = (
    "log_chars", "log_words", "word_length", "distinct_words", "same_as_before", "top_word",
    "upper", "digits", "letters", "spaces", "marks", "symbols", "odd_ends", "upper_words",
    "marked_words", "log_lines", "line_words", "repeated_lines", "longest_word", "short_words",
    "bars", "shouts", "packed", "distinct_chars",
)


def statistics(text: str | None) -> list[float]:
    """The statistics in NAMES; each is zero for an empty text."""
    if not text:
        return [0.0] * len(NAMES)
    size = len(text)
    upper = digits = letters = spaces = marks = symbols = 0
    chars = Counter(text)
    for c, n in chars.items():
        if c.isalpha():
            letters += n
            upper += n if c.isupper() else 0
        elif c.isspace():
            spaces += n
        elif c.isdigit():
            digits += n
        elif c in _MARKS:
            marks += n
        else:
            symbols += n
    words = text.split()
    count = max(1, len(words))
    kinds = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    odd_ends = upper_words = marked = short = longest = total = 0
    for w, n in kinds.items():
        length = len(w)
        total += n * length
        longest = max(longest, length)
        short += n if length <= 3 else 0
        end = w[-1]
        if not end.isalnum():
            marked += n
            odd_ends += n if end not in _MARKS else 0
        upper_words += n if length > 1 and w.isupper() else 0
    lines = [x for x in text.split("\n") if x]
    some = max(1, len(lines))
    data = text.encode("utf-8", "surrogatepass")
    return [
        np.log1p(size), np.log1p(len(words)), total / count, len(kinds) / count, same / count,
        max(kinds.values(), default=0) / count, upper / max(1, letters), digits / size,
        letters / size, spaces / size, marks / size, symbols / size, odd_ends / count,
        upper_words / count, marked / count, np.log1p(len(lines)), len(words) / some,
        1 - len(set(lines)) / some, np.log1p(longest), short / count, chars["|"] / count,
        chars["!"] / count, len(zlib.compress(data, 1)) / len(data), np.log1p(len(chars)),
    ]


def label_sample(labels: DataFrame, sample_rows: int, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """One (key, y) row per labelled document outside the held-out fold, at most ``sample_rows``.

    Which documents are taken depends on a hash of the key alone.
    """
    usable = (
        labels.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__y"))
        .filter(F.col("__key").isNotNull() & F.col("__y").isNotNull() & (fold(F.col("__key"), FOLDS) != HELD_OUT))
        .groupBy("__key")
        .agg((F.avg("__y") >= 0.5).cast("int").alias("__y"))
    )
    there = usable.count()
    spread = 4 * sample_rows**0.5
    part = min(1.0, max(1.0, sample_rows - spread) / max(1, there))
    lucky = F.pmod(F.xxhash64("__key", F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30))
    return (usable.filter(lucky) if part < 1 else usable).limit(sample_rows)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    settings: Settings = Settings(),
) -> Forest:
    """Learn from at most ``sample_rows`` labelled documents.

    The sample's keys are few by that bound, so they are broadcast and the
    documents are read without a shuffle; of a key with several documents one
    counts.
    """
    sample = label_sample(labels, sample_rows, key)
    picked = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(sample), "__key")
    values = map_texts(picked, ["__key", "__y"], "__text", [T.StructField("x", T.ArrayType(T.DoubleType()))], _worker)
    rows = values.groupBy("__key", "__y").agg(F.min("x").alias("x")).orderBy("__key").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(NAMES))
    return fit(x, rows["__y"].to_numpy(dtype=float), settings)


def _worker():
    return lambda texts: [[[float(v) for v in statistics(t)] for t in texts]]


def score_quality(docs: DataFrame, forest: Forest, keys: list[str], text: str = "text", score: str = "score") -> DataFrame:
    """The keys with the column ``score``, the probability of label 1."""

    def worker():
        def each(texts):
            x = np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))
            return [forest.probability(x).tolist()]

        return each

    return map_texts(docs, keys, text, [T.StructField(score, T.DoubleType())], worker)


def quality_of_documents(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    docs = table(spark, directory, "documents")
    forest = fit_quality(docs, table(spark, directory, "labels"))
    return score_quality(docs, forest, ["doc_id"]).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be of quality, with all their columns."""
    names = docs.columns
    score = fresh("__score", names)
    scored = score_quality(docs, fit_quality(docs, labels), names, score=score)
    return scored.filter(F.col(score) >= KEEP_FROM).select(*map(named, names))
