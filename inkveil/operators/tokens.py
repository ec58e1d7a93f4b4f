"""Words of a corpus: each judged once, or in place where that is cheaper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.entropy import entropy, looks_random
from inkveil.functions.regex import any_word
from inkveil.functions.sql import Sql, matches, name, string
from inkveil.functions.text import strip, words
from inkveil.operators.verdict import verdict, whitelisted
from inkveil.rules import DEFAULT_RULES, RuleSet


def distinct_words(df: DataFrame, text: str) -> DataFrame:
    """The different words of all texts.

    Repetitions go first within each text, then within each task, and only then
    over the network, so a word that is everywhere costs one row per task.
    """
    return df.selectExpr(f"explode(array_distinct({words(name(text))})) AS token").distinct()


def word_entropy(tokens: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    return tokens.withColumns(
        {
            "entropy": F.expr(entropy("token")),
            "is_random": F.expr(looks_random("token", rules.entropy_threshold)),
        }
    )


def secret_words(text: Sql, rules: RuleSet = DEFAULT_RULES) -> Sql:
    """The random-looking words of a text, as an array.

    Judged inside the row: sending every word through a shuffle to judge it once
    would cost far more than judging the few long mixed words again.
    """
    return f"filter({words(text)}, w -> {looks_random('w', rules.entropy_threshold)})"


def is_whitelisted(tokens: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    return tokens.withColumn("is_whitelisted", F.expr(whitelisted("token", rules)))


def drop_whitelisted(tokens: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Tokens not in a whitelist table of any size (column ``word``).

    Tokens are unique, so the join has no hot key; Spark broadcasts the list if
    its size is below the session's limit.
    """
    listed = whitelist.select("word").distinct()
    keyed = tokens.withColumn("__word", F.expr(f"lower({strip('token')})"))
    return keyed.join(listed, keyed["__word"] == listed["word"], "left_anti").drop("__word")


def keyword_hits(tokens: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """One row per word and keyword inside it, case aside.

    The keywords are an array literal: the pairs tested never become rows, only
    the hits do.  Most words hold none, which one search settles.
    """
    rows = ", ".join(
        f"named_struct('category', {string(c)}, 'keyword', {string(k)}, 'low', {string(k.lower())})"
        for c, k, _ in rules.keyword_rows()
    )
    hits = f"filter(array({rows}), k -> contains(lower(token), k.low))"
    held = matches("lower(token)", any_word(k.lower() for _, k, _ in rules.keyword_rows()))
    return tokens.where(held).selectExpr("token", f"inline({hits})").drop("low")


def judged(
    tokens: DataFrame, rules: RuleSet = DEFAULT_RULES, context: Sql | None = None
) -> DataFrame:
    """Every token with its verdict."""
    return tokens.withColumn("verdict", F.expr(verdict("token", rules, context))).select(
        *tokens.columns, "verdict.sensitive", "verdict.reason"
    )


def words_in_order(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per word occurrence with its place, from 0."""
    return df.selectExpr(*[name(k) for k in keys], f"posexplode({words(name(text))}) AS (i, text)")
