"""Redaction that spares what a whitelist table of any size lists.

Which matches a rule finds depends on which ones the rules before it spared, so
the whitelist cannot be joined to the matches once.  The texts are redacted as
if nothing were listed; what was replaced is looked up in the list (an equal
join of the different matches); texts in which something turns out to be listed
are redacted again with those few words beside them, until no new one turns up.
In the end no match that was replaced is listed and every match that was spared
is, so each rule decided as it would have with the whole list at hand.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.sql import name
from inkveil.functions.text import strip
from inkveil.operators.redact import ALL_PHASES, PATTERN, redact
from inkveil.rules import DEFAULT_RULES, RuleSet
from inkveil.sources.shared import written

_ALLOWED, _LOG = "__allowed", "__log"


def redact_with_whitelist(
    df: DataFrame,
    key: str,
    column: str,
    whitelist: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    phases: Sequence[str] = ALL_PHASES,
    log: bool = False,
) -> DataFrame:
    """``redact`` of ``column``, sparing matches that the column ``word`` of ``whitelist`` lists.

    Words and matches are compared trimmed and in lower case.  ``key`` is unique
    in ``df``, which is read again for the texts in which something is listed.
    """
    rules = replace(rules, whitelist_column=_ALLOWED)
    listed = whitelist.select(F.expr(f"lower({strip('word')})").alias("__word")).where("__word <> ''").distinct()
    todo = df.withColumn(_ALLOWED, F.expr("CAST(array() AS array<string>)"))
    own, parts = F.col(name(key)), []
    while True:
        done = redact(todo, column, rules, phases, log=True)
        done = written(done.withColumnRenamed(column + "_log", _LOG), "redacted")
        originals = f"transform(filter({_LOG}, e -> e.phase = {PATTERN}), e -> lower({strip('e.original')}))"
        hits = done.select(own.alias("__key"), F.explode(F.expr(f"array_distinct({originals})")).alias("__word"))
        # The different words first: a match that is everywhere meets the list once.
        known = hits.select("__word").distinct().join(listed, "__word")
        spared = hits.join(known, "__word").groupBy("__key").agg(F.collect_set("__word").alias("__more"))
        spared = written(spared, "spared")
        if spared.isEmpty():
            parts.append(done)
            break
        parts.append(done.join(spared, own == F.col("__key"), "left_anti"))
        before = done.select(own.alias("__key"), _ALLOWED).join(spared, "__key")
        allowed = before.select("__key", F.concat(_ALLOWED, "__more").alias(_ALLOWED))
        todo = df.join(allowed, own == F.col("__key")).drop("__key")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    columns = [F.col(name(c)) for c in df.columns]
    return out.select(*columns, F.col(_LOG).alias(column + "_log")) if log else out.select(*columns)
