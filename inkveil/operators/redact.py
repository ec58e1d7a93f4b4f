"""The redaction cascade.

A text goes through the phases in order, each working on what the last one
left: trigger phrases, pattern rules, (entities, see ``operators.entities``),
keywords, merging of equal neighbours.  Everything is a built-in expression
over one row, so a whole cascade runs within one scan, without a shuffle, for
any string columns, in batch or in a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame

from inkveil.functions.guards import facts, has_whole_word, has_word, may_match
from inkveil.functions.regex import (
    DIGIT,
    EDGE,
    SPACE,
    WORD,
    quote,
    quote_replacement,
    rule_pattern,
    starting_with,
    to_java,
)
from inkveil.functions.sql import Sql, any_of, fenced, let, name, replace_all, string
from inkveil.functions.text import has_content, strip
from inkveil.operators.verdict import reason, whitelisted
from inkveil.rules import DEFAULT_RULES, REST_OF_LINE, ContextRule, PatternRule, RuleSet
from inkveil.rules.words import keyword_tag

CONTEXT, PATTERN, ENTITY, KEYWORD = 1, 2, 3, 4
ALL_PHASES = ("context", "pattern", "keyword", "merge")
PATTERN_PHASES = ("pattern", "merge")

# One replacement: where in the order it happened, what it was and why.
LOG_TYPE = (
    "array<struct<phase:int,ord:int,tag:string,original:string,reason:string>>"
)
EMPTY_LOG = f"CAST(array() AS {LOG_TYPE})"

# Steps of one projection at most; longer chains resolve slowly.
_SEGMENT_SIZE = 8
# Steps, times columns, whose code is compiled as one method at most.
_METHOD_SIZE = 24
_FACTS, _WORK, _WORDS = "__facts_", "__work_", "__words_"

Test = Callable[[Sql], Sql]


@dataclass(frozen=True)
class Step:
    """Replace every match of a pattern by a tag.

    ``group`` is the part that is replaced; group 1 before it is kept.
    ``may`` tells from the facts of a text whether a match is possible.
    ``spare`` tells which matches are left alone, and ``spare_if`` which texts
    can hold such a match.  Neighbouring steps of one ``key`` share their test.
    Every match ends with one of ``ends``; what follows the last of those is not
    searched, so that no start runs to the end of the text in vain.
    """

    phase: int
    ord: int
    pattern: str
    tag: str
    reason: str
    key: str
    group: int = 0
    may: Test = field(default=lambda f: "true", compare=False)
    spare: Test | None = field(default=None, compare=False)
    spare_if: Test | None = field(default=None, compare=False)
    ends: str = ""

    def replaced(self, text: Sql, f: Sql) -> Sql:
        """``f`` are the facts of the text; a search to its end is made only where a match is possible."""
        if not self.ends:
            return self._replaced(text)
        rest = "substring(body, char_length(head) + 1)"
        parts = let("head", self._head("body"), f"concat({self._replaced('head')}, {rest})")
        return let("body", text, f"if({self.may(f)}, {parts}, body)")

    def _head(self, text: Sql) -> Sql:
        return f"regexp_extract({text}, {string(rf'(?s)\A.*(?:{self.ends})')}, 0)"

    def _replaced(self, text: Sql) -> Sql:
        tag = quote_replacement(self.tag)
        plain = replace_all(text, self.pattern, "$1" + tag if self.group else tag)
        if self.spare is None:
            return plain
        return f"if({self.spare_if(text)}, {self._one_by_one(text)}, {plain})"

    def _one_by_one(self, text: Sql) -> Sql:
        """Cut the text at the matches, decide on each, put it together again."""
        gaps = f"split({text}, {string(self.pattern)}, -1)"
        kept = f"CASE WHEN hit IS NULL THEN '' WHEN {self.spare('hit')} THEN hit"
        closed = f"concat(gap, {kept} ELSE {string(self.tag)} END)"
        return f"array_join(zip_with({gaps}, {self._hits(text)}, (gap, hit) -> {closed}), '')"

    def _hits(self, text: Sql) -> Sql:
        """All matches in a text, or in its head."""
        return f"regexp_extract_all({text}, {string(self.pattern)}, {self.group})"

    def entries(self, text: Sql) -> Sql:
        hits = self._hits(self._head(text) if self.ends else text)
        if self.spare is not None:
            hits = f"filter({hits}, hit -> NOT {self.spare('hit')})"
        entry = log_entry(self.phase, str(self.ord), string(self.tag), "hit", string(self.reason))
        return f"transform({hits}, hit -> {entry})"


def log_entry(phase: int, ord_: Sql, tag: Sql, original: Sql, why: Sql) -> Sql:
    return (
        f"named_struct('phase', {phase}, 'ord', {ord_}, 'tag', {tag},"
        f" 'original', {original}, 'reason', {why})"
    )


# ---------------------------------------------------------------- the steps


def context_steps(rules: RuleSet) -> list[Step]:
    return [_context_step(rule) for rule in rules.contexts]


def _context_step(rule: ContextRule) -> Step:
    trigger, start = quote(rule.trigger), starting_with(rule.trigger)
    if rule.target == REST_OF_LINE:
        # The value may not hold a tag; blanks after the trigger may hold line
        # breaks, so that an empty line hands over to the next one.
        same_line = SPACE.replace(r"\t-\r", r"\t\x0b-\r")
        pattern = (
            rf"{start}(?iu)({trigger}[{SPACE}]*+:?+[{SPACE}]*+)"
            rf"([^\n<]*[^<{SPACE}])(?=[{same_line}]*(?:\n|\z))"
        )
    else:
        # The next number, wherever it is; a comma counts as one.
        pattern = rf"{start}(?iu)({trigger}[^,{DIGIT}]*+)([,{DIGIT}]+(?:\.[{DIGIT}]{{2}})?)"
    may = _word_test(rule.trigger)
    return Step(
        phase=CONTEXT,
        ord=rule.ord,
        pattern=pattern,
        tag=rule.tag,
        reason=f"Contextual: '{rule.trigger}'",
        key="context" if may else f"context {rule.ord}",
        group=2,
        may=may or (lambda f: "true"),
        ends=f"[,{DIGIT}]" if rule.target != REST_OF_LINE else "",
    )


def pattern_steps(rules: RuleSet) -> list[Step]:
    return [_pattern_step(rule, rules) for rule in rules.patterns]


def _pattern_step(rule: PatternRule, rules: RuleSet) -> Step:
    spares: list[Test] = []
    doubts: list[Test] = []
    if rule.crosses_tags:
        spares.append(lambda hit: f"contains({hit}, '<')")
        doubts.append(lambda text: f"contains({text}, '<')")
    if rule.recheck:
        # Its own rule need not match any more once the neighbours are gone.
        spares.append(lambda hit: f"(endswith({hit}, '-') AND {reason(hit, rules)} IS NULL)")
        doubts.append(lambda text: f"contains({text}, '--')")
    if rules.custom_whitelist:
        spares.append(lambda hit: whitelisted(hit, rules))
        doubts.append(lambda text: "true")
    if rules.whitelist_column:
        listed = name(rules.whitelist_column)
        spares.append(lambda hit: f"array_contains({listed}, lower({strip(hit)}))")
        doubts.append(lambda text: f"size({listed}) > 0")
    return Step(
        phase=PATTERN,
        ord=rule.ord,
        pattern=rule_pattern(rule),
        tag=rule.tag,
        reason="Regex",
        key=f"pattern {rule.ord}" if spares or not rule.needs else rule.needs[0],
        may=lambda f: may_match(f, rule.needs),
        spare=(lambda hit: any_of(t(hit) for t in spares)) if spares else None,
        spare_if=(lambda text: any_of(t(text) for t in doubts)) if spares else None,
        ends=to_java(rule.ends),
    )


def keyword_steps(rules: RuleSet) -> list[Step]:
    steps = []
    for n, (category, word, redacts) in enumerate(rules.keyword_rows(), start=1):
        if redacts and "<" not in word:
            may = _word_test(word, rules)
            steps.append(
                Step(
                    phase=KEYWORD,
                    ord=n,
                    pattern=f"{starting_with(word)}{EDGE}(?iu){quote(word)}{EDGE}",
                    tag=keyword_tag(category),
                    reason=f"Keyword: {category}",
                    key="keyword" if may else f"keyword {n}",
                    may=may or (lambda f: "true"),
                )
            )
    return steps


def _keyword_test(rules: RuleSet, text: Sql) -> Sql:
    """Whether the keyword phase can do anything: one look for all keywords.

    A keyword stands by itself, so its first word does.  The text is the one the
    phase starts with, as a tag put in next to a word sets the word free.
    """
    words = [word for _, word, redacts in rules.keyword_rows() if redacts]
    first = [re.match(r"[a-z0-9]+(?=\W|\Z)(?=.*[a-z0-9]\Z)", word.lower()) for word in words]
    if not all(first) or not all(_word_test(word, rules) for word in words):
        return "true"
    return has_whole_word(f"lower({text})", [m[0] for m in first])


def _word_test(word: str, rules: RuleSet | None = None) -> Test | None:
    """Look for the word in the original text, if that is sure to find it."""
    tags = "".join(rules.tags()).lower() if rules else ""
    if not word.isascii() or "<" in word or ">" in word or word.lower() in tags:
        return None
    return lambda f: has_word(f, [word])


# -------------------------------------------------------------- the cascade


@dataclass(frozen=True)
class Segment:
    """Neighbouring steps that share their test and run in one projection."""

    steps: tuple[Step, ...]

    def may(self, f: Sql) -> Sql:
        return any_of(dict.fromkeys(step.may(f) for step in self.steps))

    def on_text(self, text: Sql, f: Sql) -> Sql:
        for step in self.steps:
            text = step.replaced(text, f)
        return text

    def on_state(self, out: Sql, f: Sql) -> Sql:
        """The same on struct(text, log), with an entry for each replacement."""
        for step in self.steps:
            logged = f"named_struct('text', new, 'log', concat(s.log, {step.entries('s.text')}))"
            out = let(
                "s",
                out,
                let("new", step.replaced("s.text", f), f"if(new = s.text, s, {logged})"),
            )
        return out


def _segments(rules: RuleSet, phases: Sequence[str]) -> list[Segment]:
    makers = {"context": context_steps, "pattern": pattern_steps, "keyword": keyword_steps}
    out: list[Segment] = []
    for phase in phases:
        if phase in makers:
            for _, run in groupby(makers[phase](rules), key=lambda step: step.key):
                steps = list(run)
                out += [
                    Segment(tuple(steps[n : n + _SEGMENT_SIZE]))
                    for n in range(0, len(steps), _SEGMENT_SIZE)
                ]
    return out


def redact(
    df: DataFrame,
    columns: str | Sequence[str],
    rules: RuleSet = DEFAULT_RULES,
    phases: Sequence[str] = ALL_PHASES,
    log: bool = False,
) -> DataFrame:
    """Replace everything sensitive in the string columns by tags.

    With ``log``, a column ``<name>_log`` holds one entry per replacement
    (``LOG_TYPE``).  Texts of fewer than three characters, outer blanks aside,
    stay as they are.

    The steps become a stack of projections, one per segment, all in one stage:
    naming the text between the steps lets each test and each search run once.
    """
    targets = [columns] if isinstance(columns, str) else list(columns)
    kept = [name(c) for c in df.columns]

    def look(target: str) -> list[Sql]:
        text = name(target)
        start = f"named_struct('text', {text}, 'log', {EMPTY_LOG})" if log else text
        eligible = has_content(text, 3)
        return [
            f"named_struct('of', {facts(text)}, 'eligible', {eligible})"
            f" AS {name(_FACTS + target)}",
            f"{start} AS {name(_WORK + target)}",
        ]

    def run(segment: Segment, target: str, apart: bool) -> Sql:
        work, f = name(_WORK + target), name(_FACTS + target) + ".of"
        may = segment.may(f)
        if segment.steps[0].phase == KEYWORD:
            may = f"(({name(_WORDS + target)} OR {f}.folded) AND {may})"
        changed = segment.on_state(work, f) if log else segment.on_text(work, f)
        result = f"if({may}, {changed}, {work})"
        # A projection with a lambda is not compiled together with its neighbours.
        return f"{let('done', result, 'done') if apart else result} AS {work}"

    def look_again(target: str) -> Sql:
        work = name(_WORK + target)
        text = f"{work}.text" if log else work
        return f"{_keyword_test(rules, text)} AS {name(_WORDS + target)}"

    staged = df.selectExpr(*kept, *[c for t in targets for c in look(t)])
    found = [name(_FACTS + t) for t in targets]
    compiled = 0
    for segment in _segments(rules, phases):
        compiled += len(segment.steps) * len(targets)
        apart = compiled > _METHOD_SIZE and len(targets) > 1
        compiled = 0 if apart else compiled
        if segment.steps[0].phase == KEYWORD and name(_WORDS + targets[0]) not in found:
            work = [name(_WORK + t) for t in targets]
            staged = staged.selectExpr(*kept, *found, *work, *map(look_again, targets))
            found += [name(_WORDS + t) for t in targets]
        staged = staged.selectExpr(*kept, *found, *[run(segment, t, apart) for t in targets])

    def finish(target: str) -> dict[str, Sql]:
        work, eligible = name(_WORK + target), name(_FACTS + target) + ".eligible"
        text = f"{work}.text" if log else work
        done = merge_tags(text) if "merge" in phases else text
        out = {target: f"if({eligible}, {done}, {name(target)})"}
        if log:
            out[target + "_log"] = f"if({eligible}, {work}.log, {EMPTY_LOG})"
        return out

    results = {field: value for t in targets for field, value in finish(t).items()}
    others = [name(c) for c in df.columns if c not in targets]
    logs = [name(c) for c in results if c not in df.columns]
    return staged.selectExpr(*others, fenced(results)).select(*kept, *logs)


def merge_tags(text: Sql) -> Sql:
    """Equal tags side by side become one.

    One pass each for spaced and for touching tags, so three spaced tags leave
    two.
    """
    spaced = rf"(<[{WORD}]+>)[{SPACE}]+\1"
    touching = rf"(<[{WORD}]+>)(\1)+"
    merged = replace_all(replace_all(text, spaced, "$1"), touching, "$1")
    return f"if(contains({text}, '<'), {merged}, {text})"
