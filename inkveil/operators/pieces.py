"""Long texts in pieces, so that one text is many tasks' work.

A text is cut where no match of a pattern rule, of a keyword, or of two equal
tags can reach over the cut.  Such a place is a blank between plain words: the
word before the cut and the one before that are letters only, neither is, or
ends like, a word after which a rule goes on (``token``, ``password``), none is
part of a keyword, and so the word before the cut cannot become a tag.
Between the first line that begins a private key and the last that ends one
there is no cut.

Trigger phrases reach to the next number, wherever it is, so they run on the
whole text before it is cut; they are a small part of the work.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.sql import Sql, let, name, string
from inkveil.operators.redact import ALL_PHASES, EMPTY_LOG, PATTERN, redact
from inkveil.rules import DEFAULT_RULES, RuleSet
from inkveil.rules.patterns import PATTERN_RULES

#: Characters of a piece, about.
PIECE = 1 << 18

#: Words after which a pattern rule goes on over a blank.
_LEADERS = ("key", "token", "bearer", "password", "passwd", "pwd", "pass", "secret", "pin", "passcode", "date", "of")
#: Small letters, and letters without case; not those that fold to an ASCII letter.
_LETTER = r"[\p{Ll}\p{Lo}&&[^\x{17f}\x{131}]]"


def cut_pattern(rules: RuleSet, piece: int) -> str:
    """Matches a piece: so many characters and what follows up to a safe place, or all the rest."""
    if set(rules.patterns) - set(PATTERN_RULES):
        raise ValueError("only the built-in pattern rules are known not to reach over a cut")
    fold = str.maketrans("ſKİı", "skii")
    parts = {w for _, word, redacts in rules.keyword_rows() if redacts for w in re.split(r"\s+", word.lower().translate(fold))}
    single = {w for p in parts for w in re.findall(r"\w+", p)}
    leads = rf"(?!\p{{L}}*+(?<={'|'.join(_LEADERS)})\x20)"
    listed = rf"(?!(?:{'|'.join(sorted(single))})\x20)" if single else ""
    word = rf"{leads}{listed}{_LETTER}++\x20"
    return rf"(?s).{{{piece},}}?(?<=\x20){word}{word}(?={_LETTER}{{3}})|.+"


def cut_text(text: Sql, rules: RuleSet = DEFAULT_RULES, piece: int = PIECE) -> Sql:
    """An array of pieces that together are the text."""
    def pieces(of: Sql) -> Sql:
        return f"regexp_extract_all({of}, {string(cut_pattern(rules, piece))}, 0)"

    around = r"(?s)\A(.*?)(-----BEGIN.*KEY-----)(.*)\z"
    before, keys, behind = (f"regexp_extract({text}, {string(around)}, {g})" for g in (1, 2, 3))
    # What is between the keys, and up to the next safe places, stays together.
    joined = f"concat(coalesce(try_element_at(b, -1), ''), {keys}, coalesce(try_element_at(a, 1), ''))"
    split = (
        f"concat(slice(b, 1, greatest(size(b) - 1, 0)), array({joined}), slice(a, 2, greatest(size(a) - 1, 0)))"
    )
    has_keys = f"(contains({text}, '-----BEGIN') AND {text} RLIKE {string(around)})"
    return f"if({has_keys}, {let('b', pieces(before), let('a', pieces(behind), split))}, {pieces(text)})"


def redact_in_pieces(
    df: DataFrame,
    column: str,
    rules: RuleSet = DEFAULT_RULES,
    phases: Sequence[str] = ALL_PHASES,
    log: bool = False,
    piece: int = PIECE,
) -> DataFrame:
    """``redact`` of one column, texts longer than ``piece`` characters in pieces.

    Rows with shorter texts, or none, are not shuffled.  The pieces of a text
    are dealt over tasks and then put together by their numbers, as are their
    logs by rule and place.
    """
    if "context" in phases[1:]:
        raise ValueError("trigger phrases come first")
    rest = [p for p in phases if p != "context"]
    text, log_name = name(column), column + "_log"
    length = f"coalesce(char_length({text}), 0)"
    short = redact(df.where(f"{length} <= {piece}"), column, rules, phases, log)

    long = df.where(f"{length} > {piece}")
    if len(rest) < len(phases):
        long = redact(long, column, rules, ("context",), log)
    elif log:
        long = long.withColumn(log_name, F.expr(EMPTY_LOG))
    others = [c for c in long.columns if c != column]
    beside = f"if(__n = 0, struct({', '.join(map(name, others))}), null) AS __beside" if others else "null AS __beside"
    cut = long.withColumn("__row", F.monotonically_increasing_id())
    cut = cut.selectExpr("__row", *map(name, others), f"posexplode({cut_text(text, rules, piece)}) AS (__n, __piece)")
    dealt = cut.selectExpr("__row", "__n", "__piece", beside).repartition("__row", "__n")
    done = redact(dealt, "__piece", rules, rest, log)
    gathered = {
        "__pieces": F.collect_list(F.struct("__n", "__piece")),
        "__beside": F.first("__beside", ignorenulls=True),
    }
    if log:
        # By phase, by the rules' order, by place.
        order = ", ".join(str(r.ord) for r in rules.patterns) or "0"
        step = f"if(e.phase = {PATTERN}, array_position(array({order}), e.ord), e.ord)"
        placed = f"transform(__piece_log, (e, i) -> struct(e.phase, {step} AS step, __n, i, e))"
        gathered["__logs"] = F.flatten(F.collect_list(F.expr(placed)))
    whole = done.groupBy("__row").agg(*(c.alias(n) for n, c in gathered.items()))
    joined = {column: "array_join(transform(array_sort(__pieces), p -> p.__piece), '')"}
    if log:
        joined[log_name] = f"concat(__beside.{name(log_name)}, transform(array_sort(__logs), l -> l.e))"
    outputs = [f"{joined.get(c, f'__beside.{name(c)}')} AS {name(c)}" for c in short.columns]
    return short.unionByName(whole.selectExpr(*outputs))
