"""Is this word sensitive, and why: the first test that hits decides."""

from __future__ import annotations

from inkveil.functions.entropy import looks_random
from inkveil.functions.guards import facts, may_match
from inkveil.functions.regex import any_word, rule_pattern
from inkveil.functions.sql import Sql, any_of, let, matches, string, strings
from inkveil.functions.text import all_digits, strip
from inkveil.rules import DEFAULT_RULES, RuleSet

# No default rule matches a text without one of these.
_RULE_CHARACTERS = r"[\p{Nd}@:=.\-\t-\r\x1c-\x20\x85\p{Z}]"


def whitelisted(text: Sql, rules: RuleSet = DEFAULT_RULES) -> Sql:
    """A listed word, or a number of at most three digits."""
    return any_of(
        [f"lower({strip(text)}) IN ({strings(rules.whitelist)})", all_digits(text, up_to=3)]
    )


def first_rule(text: Sql, rules: RuleSet = DEFAULT_RULES) -> Sql:
    """Tag of the first pattern rule found anywhere in the text, else null."""
    hits = " ".join(
        f"WHEN {may_match('f', rule.needs)} AND {matches('f.text', rule_pattern(rule))}"
        f" THEN {string(rule.tag)}"
        for rule in rules.patterns
    )
    found = let("f", facts(text), f"CASE {hits} END") if hits else "string(null)"
    if rules.patterns == DEFAULT_RULES.patterns:
        found = f"if({matches(text, _RULE_CHARACTERS)}, {found}, null)"
    return found


def first_keyword(
    text: Sql, rules: RuleSet = DEFAULT_RULES, context: Sql | None = None
) -> Sql:
    """``<category>_<keyword>`` of the first keyword inside the text, else null.

    Categories that need a telling context are checked against it if there is
    one; without context the keyword alone is enough.
    """
    told = any_of(f"contains(lower({context}), {string(w)})" for w in rules.gate_words)
    telling = f"(coalesce({context}, '') = '' OR {told})"
    hits = []
    for category, keyword, _ in rules.keyword_rows():
        found = f"contains(low, {string(keyword.lower())})"
        if context is not None and category in rules.gated_categories:
            found += f" AND {telling}"
        hits.append(f"WHEN {found} THEN {string(f'{category}_{keyword}')}")
    if not hits:
        return "string(null)"
    cases = f"CASE {' '.join(hits)} END"
    # Most words hold none; one search settles that.
    held = matches(f"lower({text})", any_word(k.lower() for _, k, _ in rules.keyword_rows()))
    return f"if({held}, {let('low', f'lower({text})', cases)}, null)"


def reason(
    text: Sql,
    rules: RuleSet = DEFAULT_RULES,
    context: Sql | None = None,
    entity_label: Sql = "string(null)",
) -> Sql:
    """Why the text is sensitive, whitelist aside; null if it is not."""
    return (
        f"coalesce(if({looks_random(text, rules.entropy_threshold)}, 'high_entropy_string', null),"
        f" concat('regex_pattern_', {first_rule(text, rules)}),"
        f" concat('keyword_', {first_keyword(text, rules, context)}),"
        f" concat('ner_', {entity_label}))"
    )


def verdict(
    text: Sql,
    rules: RuleSet = DEFAULT_RULES,
    context: Sql | None = None,
    entity_label: Sql = "string(null)",
) -> Sql:
    """struct(sensitive, reason) for a word or a short text.

    ``entity_label`` is the first telling entity of the text
    (``operators.entities.telling_labels``), null if there is none.
    """
    judged = let(
        "why",
        reason(text, rules, context, entity_label),
        "named_struct('sensitive', why IS NOT NULL, 'reason', coalesce(why, ''))",
    )
    return (
        f"CASE WHEN coalesce({text}, '') = ''"
        " THEN named_struct('sensitive', false, 'reason', '')"
        f" WHEN {whitelisted(text, rules)}"
        " THEN named_struct('sensitive', false, 'reason', 'whitelisted')"
        f" ELSE {judged} END"
    )
