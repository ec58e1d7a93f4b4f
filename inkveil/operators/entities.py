"""Entities found by an outside tagger.

The tagger reads the text after the pattern phase and hands back spans
(``doc_id, start_char, end_char, label, text``; offsets from 0, end excluded).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.sql import Sql, any_of, let, name, string, strings
from inkveil.functions.text import all_digits, chunks
from inkveil.functions.text import cut as part
from inkveil.operators.redact import EMPTY_LOG, ENTITY, log_entry, redact
from inkveil.operators.verdict import whitelisted
from inkveil.rules import DEFAULT_RULES, RuleSet
from inkveil.rules.words import NOT_PERSONS, TELLING_YEARS


def _tag(label: Sql, rules: RuleSet) -> Sql:
    hits = " ".join(
        f"WHEN {string(k)} THEN {string(v) if v else 'null'}" for k, v in rules.entity_tags.items()
    )
    return f"CASE {label} {hits} END"


def _redactable(span: str, rules: RuleSet) -> Sql:
    """Whether a span (a prefix like ``s.``) is to be replaced."""
    text, label = f"{span}text", f"{span}label"
    person = (
        f"{label} = 'PERSON' AND (char_length({text}) < 3 OR lower({text}) IN ({strings(NOT_PERSONS)}))"
    )
    return (
        f"({_tag(label, rules)} IS NOT NULL AND NOT contains({text}, '<')"
        f" AND NOT {whitelisted(text, rules)} AND NOT ({person}))"
    )


def redactable(spans: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The spans that are to be replaced, with their tags."""
    return spans.where(_redactable("", rules)).withColumn("tag", F.expr(_tag("label", rules)))


def telling_labels(
    spans: DataFrame, keys: Sequence[str], rules: RuleSet = DEFAULT_RULES
) -> DataFrame:
    """Label of the first span of each text that makes the text sensitive."""
    years = any_of(f"contains(text, {string(y)})" for y in TELLING_YEARS)
    telling = spans.where(
        f"label IN ({strings(rules.entity_tags)})"
        f" AND NOT (label = 'CARDINAL' AND {all_digits('text', up_to=2)})"
        f" AND NOT (label = 'DATE' AND NOT {years})"
    )
    return telling.groupBy(*keys).agg(
        F.min_by("label", F.struct("start_char", "end_char", "label")).alias("entity_label")
    )


def redact_entities(
    df: DataFrame,
    key: str,
    column: str,
    spans: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    log: bool = False,
) -> DataFrame:
    """Replace the spans of each text by their tags.

    Spans of a text may not overlap: of two that do, the one that starts first
    stands (the longer one if both start there), and others are listed in
    ``rejected_spans``, as are spans outside the text.  Of the spans that start
    at one place only the longest inside the text can stand, so only that one
    and the longest outside are collected: the text's length bounds them,
    however many a tagger gives.

    ``df`` is read twice, for its lengths and its texts, so it should be a
    table; with the spans beside the text, ``redact_entity_arrays`` needs no
    join at all.
    """
    lengths = df.select(F.col(name(key)).alias("__key"), F.char_length(name(column)).alias("__length"))
    placed = redactable(spans, rules).withColumnRenamed(key, "__key").join(lengths, "__key")
    inside = "start_char >= 0 AND start_char < end_char AND end_char <= __length"
    place = "greatest(-1L, least(bigint(start_char), bigint(__length)))"
    span = "struct(bigint(start_char) AS first, bigint(-end_char) AS back, label, tag)"
    longest = placed.groupBy("__key", F.expr(place).alias("place")).agg(
        F.expr(f"min(CASE WHEN {inside} THEN {span} END)").alias("inside"),
        F.expr(f"min(CASE WHEN NOT ({inside}) THEN {span} END)").alias("outside"),
    )
    grouped = longest.groupBy("__key").agg(
        F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array("inside", "outside"))))).alias("__spans")
    )
    joined = df.join(grouped, F.col(name(key)) == F.col("__key"), "left").drop("__key")
    return _spliced(joined, df.columns, column, log)


def redact_entity_arrays(
    df: DataFrame, column: str, spans: str, rules: RuleSet = DEFAULT_RULES, log: bool = False
) -> DataFrame:
    """The same for texts with an array of (start_char, end_char, label, text) beside them.

    The array goes; everything happens within the row.
    """
    chosen = (
        f"array_sort(transform(filter({name(spans)}, s -> {_redactable('s.', rules)}), s ->"
        f" struct(bigint(s.start_char) AS first, bigint(-s.end_char) AS back, s.label AS label,"
        f" {_tag('s.label', rules)} AS tag)))"
    )
    listed = let("every", chosen, "filter(every, (s, i) -> i = 0 OR s <> every[i - 1])")
    kept = [c for c in df.columns if c != spans]
    return _spliced(df.selectExpr(*map(name, kept), f"{listed} AS __spans"), kept, column, log)


# Places are gathered in pieces, as appending to an array copies it.
_PIECE = 512


def _spliced(df: DataFrame, columns: Sequence[str], column: str, log: bool) -> DataFrame:
    """Choose among the sorted ``__spans`` and put their tags in.

    A span that starts where the last kept one ended, or later, is kept.
    """
    text = name(column)
    fits = "s.first >= acc.done AND s.first < -s.back AND -s.back <= length"
    none, nothing = "CAST(array() AS array<int>)", "CAST(array() AS array<array<int>>)"
    piece = "concat(acc.piece, array(acc.n))"
    chosen = (
        f"aggregate(__spans, named_struct('done', 0L, 'piece', {none}, 'pieces', {nothing}, 'n', 0),"
        f" (acc, s) -> CASE WHEN NOT ({fits}) THEN"
        " named_struct('done', acc.done, 'piece', acc.piece, 'pieces', acc.pieces, 'n', acc.n + 1)"
        f" WHEN size(acc.piece) < {_PIECE} THEN"
        f" named_struct('done', bigint(-s.back), 'piece', {piece}, 'pieces', acc.pieces, 'n', acc.n + 1)"
        f" ELSE named_struct('done', bigint(-s.back), 'piece', {none},"
        f" 'pieces', concat(acc.pieces, array({piece})), 'n', acc.n + 1) END,"
        " acc -> flatten(concat(acc.pieces, array(acc.piece))))"
    )
    placed = df.withColumn("__places", F.expr(let("length", f"char_length({text})", chosen)))
    every = "if(size(__spans) > 0, sequence(0, size(__spans) - 1), CAST(array() AS array<int>))"
    chosen_spans = placed.selectExpr(
        *map(name, columns),
        "transform(__places, n -> __spans[n]) AS __kept",
        f"transform(array_except({every}, __places), n -> __spans[n]) AS __rejected",
        f"if(size(__places) > 0, {chunks(text)}, null) AS __chunks",
    )

    def between(first: Sql, last: Sql) -> Sql:
        return part("__chunks", first, last)

    gap = between("if(n = 0, 0, -__kept[n - 1].back)", "s.first")
    tail = between("-element_at(__kept, -1).back", f"char_length({text})")
    spliced = f"concat(array_join(transform(__kept, (s, n) -> concat({gap}, s.tag)), ''), {tail})"
    some = "coalesce(size(__kept) > 0, false)"
    outputs = [f"if({some}, {spliced}, {text}) AS {text}" if c == column else name(c) for c in columns]
    span_type = "array<struct<start_char:bigint,end_char:bigint,label:string>>"
    rejected = (
        "transform(__rejected, s -> named_struct('start_char', s.first,"
        " 'end_char', -s.back, 'label', s.label))"
    )
    outputs.append(f"coalesce(CAST({rejected} AS {span_type}), array()) AS rejected_spans")
    if log:
        original = between("s.first", "-s.back")
        entry = log_entry(ENTITY, "0", "s.tag", original, "concat('NER: ', s.label)")
        outputs.append(f"if({some}, transform(__kept, s -> {entry}), {EMPTY_LOG}) AS entity_log")
    return chosen_spans.selectExpr(*outputs)


def redact_with_entities(
    df: DataFrame,
    key: str,
    column: str,
    spans: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    log: bool = False,
) -> DataFrame:
    """The full cascade with the entity phase between patterns and keywords."""
    before = redact(df, column, rules, ("context", "pattern"), log)
    return _finished(redact_entities(before, key, column, spans, rules, log), column, rules, log)


def redact_with_entity_arrays(
    df: DataFrame,
    column: str,
    tagger: Callable[[DataFrame], DataFrame],
    rules: RuleSet = DEFAULT_RULES,
    log: bool = False,
) -> DataFrame:
    """The full cascade; ``tagger`` adds an array column ``spans`` to the texts after the patterns."""
    before = tagger(redact(df, column, rules, ("context", "pattern"), log))
    return _finished(redact_entity_arrays(before, column, "spans", rules, log), column, rules, log)


def _finished(tagged: DataFrame, column: str, rules: RuleSet, log: bool) -> DataFrame:
    first_log = name(column + "_log")
    if log:
        tagged = tagged.withColumnRenamed(column + "_log", "__first_log")
    after = redact(tagged, column, rules, ("keyword", "merge"), log)
    if not log:
        return after.drop("rejected_spans")
    whole = f"concat(__first_log, entity_log, {first_log}) AS {first_log}"
    return after.selectExpr(
        f"* EXCEPT (__first_log, entity_log, {first_log}, rejected_spans)", whole
    )
