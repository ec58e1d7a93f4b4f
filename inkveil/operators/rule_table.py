"""Rules and keywords that are tables.

A rule set (``rules.RuleSet``) travels inside the plan and is meant to be
hundreds of entries.  These take tables of any length: a text meets only the
rules whose required words it holds.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions.regex import EDGE, WORD
from inkveil.functions.sql import Sql, let, matches, name, string
from inkveil.operators.containment import contained
from inkveil.sources.shared import written

#: Rules without any required characters, which every text has to try.
MOST_WITHOUT_LITERAL = 1000

#: Keywords that are part of a tag.
MOST_IN_TAGS = 1000
#: Signs with a meaning in patterns, or in replacements; a backslash goes before them.
_PLAIN = r"\A[a-z0-9]\z"
_SPECIAL, _DOLLAR, _QUOTED = r"([^\p{L}\p{N}_\p{Z}\s])", r"([\\$])", r"\\$1"

_QUANTIFIER = re.compile(r"[?*+]|\{(\d+)(,\d*)?\}")


def required_literal(pattern: str | None) -> str | None:
    """The longest run of characters, in lower case, that every match of a Java pattern holds.

    None if there is none or the pattern is not simple enough to tell.  Only
    ASCII characters count, as others may change their length with their case.
    """
    if not pattern:
        return None
    folds = ""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    if flags:
        if set(flags[1]) - set("iu"):
            return None
        # With Unicode case these also stand for signs that are no ASCII letters.
        folds = "ksi" if "u" in flags[1] else ""
        pattern = pattern[flags.end() :]
    runs, run, i = [], "", 0
    while i < len(pattern):
        at, i = pattern[i], i + 1
        if at == "|":
            return None
        literal = None
        if at == "(":
            depth = 1
            while i < len(pattern) and depth:
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    i = _after_class(pattern, i + 1) - 1
                elif pattern[i] in "()":
                    depth += 1 if pattern[i] == "(" else -1
                i += 1
        elif at == "[":
            i = _after_class(pattern, i)
        elif at == "\\":
            if i == len(pattern) or pattern[i] in "QE":
                return None
            if not pattern[i].isalnum():
                literal = pattern[i]
            elif pattern[i] in "pPxukNc0123456789":
                # What follows these belongs to them.
                brace = re.match(r"\{[^}]*\}|<[^>]*>|[0-9A-Fa-f]{0,4}", pattern[i + 1 :])
                i += brace.end()
            i += 1
        elif at not in ".^$":
            literal = at
        quantifier = _QUANTIFIER.match(pattern, i)
        if literal is not None and (not literal.isascii() or literal.lower() in folds):
            literal = None
        if quantifier:
            least = int(quantifier[1]) if quantifier[1] else 1 if quantifier[0] == "+" else 0
            run += literal if literal is not None and least else ""
            runs.append(run)
            run, i = "", quantifier.end()
            i += 1 if pattern[i : i + 1] in ("?", "+") else 0
        elif literal is None:
            runs.append(run)
            run = ""
        else:
            run += literal
    longest = max([*runs, run], key=len)
    return longest.lower() or None


def _after_class(pattern: str, i: int) -> int:
    """Where the character class that began before ``i`` ends; classes may hold classes."""
    depth, i = 1, i + 1 if pattern[i : i + 1] == "^" else i
    if pattern[i : i + 1] == "]":
        i += 1
    while i < len(pattern) and depth:
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] in "[]":
            depth += 1 if pattern[i] == "[" else -1
        i += 1
    return i


@F.pandas_udf(T.StringType())
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_literal)


def rule_hits(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """(text, ord, tag): every rule of a table (ord, tag, pattern) that is found in a text.

    Texts are taken once each.  A rule is tried on the texts that hold the
    characters its pattern requires; rules that require none are few (at most
    MOST_WITHOUT_LITERAL) and are tried within the rows.
    """
    rules = rules.select("ord", "tag", "pattern", _literals("pattern").alias("__literal"))
    distinct = written(texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct(), "texts")
    folded = distinct.withColumn("__low", F.lower("text"))
    told = rules.where("__literal IS NOT NULL")
    met = contained(folded, ["text"], "__low", told, "__literal").join(told, "__literal")
    found = met.where("text RLIKE pattern").select("text", "ord", "tag")

    rest = rules.where("__literal IS NULL").limit(MOST_WITHOUT_LITERAL + 1).collect()
    if len(rest) > MOST_WITHOUT_LITERAL:
        raise ValueError(f"more than {MOST_WITHOUT_LITERAL} rules require no characters at all")
    if rest:
        kind = rules.schema["ord"].dataType.simpleString()
        tried = ", ".join(
            f"if({matches('text', r['pattern'])}, named_struct('ord', CAST({r['ord']} AS {kind}),"
            f" 'tag', {string(r['tag'])}), null)"
            for r in rest
        )
        found = found.unionByName(distinct.selectExpr("text", f"inline(array_compact(array({tried})))"))
    return found


def first_rules(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """(text, ord, tag): the first rule of the table that is found in each text."""
    hits = rule_hits(texts, text, rules)
    return hits.groupBy("text").agg(F.min(F.struct("ord", "tag")).alias("first")).select("text", "first.*")


def keyword_table_hits(tokens: DataFrame, keywords: DataFrame) -> DataFrame:
    """(token, category, keyword) for each keyword of a table (category, keyword) inside a token, case aside."""
    folded = tokens.select("token", F.lower("token").alias("__low"))
    listed = keywords.select("category", "keyword", F.lower("keyword").alias("__word")).distinct()
    met = contained(folded, ["token"], "__low", listed, "__word")
    return met.join(listed, "__word").select("token", "category", "keyword")


def _folded(text: Sql) -> Sql:
    """Equal for texts that a pattern takes for equal when it ignores case."""
    # Letters whose lower case is not that of their capital.
    # ``translate`` is slow, and most texts hold none of them (a capital sigma becomes either of the small ones).
    folded = f"translate(lower(translate({text}, 'İ', 'i')), 'ſıςµ', 'siσμ')"
    return f"if({matches(text, '[İſıςµΣ]')}, {folded}, lower({text}))"


def redact_keyword_table(df: DataFrame, key: str, column: str, keywords: DataFrame, tag: str = "tag") -> DataFrame:
    """Replace the keywords of a table (ord, keyword, tag) that stand by themselves, in their order.

    What the keyword phase of ``redact`` does with the few of a rule set, for
    lists of any length: a text meets only the keywords that it holds, and these
    are replaced one after another within its row.  A keyword may stand in a tag
    that was put in before; such keywords are few, as they are part of a tag,
    and are tried on every text in which another one is found.  Keywords with a
    "<" are passed over.  ``key`` is unique in ``df``.
    """
    text = name(column)
    listed = keywords.select("ord", "keyword", F.col(tag).alias("tag")).where("keyword <> '' AND NOT contains(keyword, '<')")
    listed = listed.withColumn("__word", F.expr(_folded("keyword")))
    own = F.col(name(key))
    low = df.select(own.alias("__key"), F.expr(_folded(text)).alias("__low")).where("__low IS NOT NULL")
    met = contained(low, ["__key"], "__low", listed, "__word").select("__key", "__word")
    tags = listed.select(F.expr(_folded("tag")).alias("__low")).distinct()
    inside = contained(tags, ["__low"], "__low", listed, "__word").select("__word").distinct()
    inside = inside.limit(MOST_IN_TAGS + 1).collect()
    if len(inside) > MOST_IN_TAGS:
        raise ValueError(f"more than {MOST_IN_TAGS} keywords are part of a tag")
    if inside:
        always = F.explode(F.array(*(F.lit(r[0]) for r in inside)))
        met = met.union(met.select("__key").distinct().select("__key", always)).distinct()
    # The keywords of a text are bounded by the text.
    entry = F.struct("ord", "keyword", "tag")
    found = met.join(listed, "__word").groupBy("__key").agg(F.array_sort(F.collect_list(entry)).alias("__found"))
    # The first letter is looked at first, as in ``starting_with``.
    alike = "CASE c WHEN 's' THEN '\u017f' WHEN 'k' THEN '\u212a' WHEN 'i' THEN '\u0130\u0131' ELSE '' END"
    look = let("c", "lower(left(k.keyword, 1))", f"if({matches('c', _PLAIN)}, concat('(?=[', c, upper(c), {alike}, '])'), '')")
    pattern = f"concat({look}, {string(EDGE + '(?iu)')}, regexp_replace(k.keyword, {string(_SPECIAL)}, {string(_QUOTED)}), {string(EDGE)})"
    literal = f"regexp_replace(k.tag, {string(_DOLLAR)}, {string(_QUOTED)})"
    # Most keywords are only part of a word; a look at the words of the text, and of the tags, settles that for those that are one word.
    # (One that begins or ends with a sign can set its neighbour free.)
    word, sign = string(f"\\A[{WORD}]+\\z"), string(f"\\A[^{WORD}]|[^{WORD}]\\z")
    tags_too = f"concat_ws(' ', {text}, transform(__found, k -> k.tag))"
    words = f"split({_folded(tags_too)}, {string(f'[^{WORD}]+')})"
    likely = f"filter(__found, k -> NOT k.keyword RLIKE {word} OR array_contains(own, {_folded('k.keyword')}))"
    chosen = f"if(exists(__found, k -> k.keyword RLIKE {sign}), __found, {let('own', words, likely)})"
    done = f"aggregate({chosen}, {text}, (t, k) -> regexp_replace(t, {pattern}, {literal}))"
    met_rows = df.join(found, own == F.col("__key"), "left").withColumn("__done", F.expr(f"if(__found IS NULL, {text}, {done})"))
    return met_rows.select(*[F.col("__done").alias(c) if c == column else F.col(name(c)) for c in df.columns])
