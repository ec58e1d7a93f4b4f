"""Regions of a page that hold sensitive text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.sql import name
from inkveil.functions.text import strip
from inkveil.operators.audit import masked
from inkveil.operators.redact import ALL_PHASES, redact
from inkveil.operators.verdict import verdict
from inkveil.rules import DEFAULT_RULES, RuleSet


def word_boxes(words: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Sensitive words among recognised ones, with their boxes and audit tags.

    Takes ``text`` and ``conf`` beside any box columns.  Unsure and short words
    go first, then each word is judged where it stands: words need no shuffle.
    """
    word = words.withColumn("text", F.expr(strip("text"))).where(
        f"int(conf) > {rules.ocr_confidence} AND char_length(text) >= 3"
    )
    found = word.withColumn("__verdict", F.expr(verdict("text", rules))).where(
        "__verdict.sensitive"
    )
    kept = [name(c) for c in words.columns if c not in ("text", "conf")]
    return found.selectExpr(
        *kept,
        f"{masked('text')} AS masked_original",
        "concat('<visual_', __verdict.reason, '>') AS redacted_to",
        "'Image OCR' AS reason",
    )


def span_boxes(
    spans: DataFrame,
    text: str = "text",
    rules: RuleSet = DEFAULT_RULES,
    phases: Sequence[str] = ALL_PHASES,
) -> DataFrame:
    """Boxes of the text spans that redaction changes."""
    before = spans.withColumn("__before", F.col(name(text)))
    return redact(before, text, rules, phases).where(f"__before <> {name(text)}").drop(
        "__before", text
    )
