"""All rules of one run, as plain data that a user can replace piece by piece."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from collections.abc import Iterable

from inkveil.rules.context import CONTEXT_RULES, ContextRule
from inkveil.rules.patterns import PATTERN_RULES, PatternRule
from inkveil.rules.words import (
    ENTITY_TAGS,
    GATE_WORDS,
    GATED_CATEGORIES,
    KEYWORDS,
    REDACTED_CATEGORIES,
    WHITELIST,
    keyword_tag,
)


@dataclass(frozen=True)
class RuleSet:
    """The rules of a run; the defaults are the built-in ones.

    Rules travel to the tasks as literals inside the query plan, so a rule set
    is meant to be hundreds of entries, not millions.  Larger lists are tables:
    ``operators.rule_table`` for rules and keywords, ``operators.listed`` for a
    whitelist.
    """

    patterns: tuple[PatternRule, ...] = PATTERN_RULES
    contexts: tuple[ContextRule, ...] = CONTEXT_RULES
    keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(KEYWORDS))
    redacted_categories: tuple[str, ...] = REDACTED_CATEGORIES
    gated_categories: tuple[str, ...] = GATED_CATEGORIES
    gate_words: tuple[str, ...] = GATE_WORDS
    entity_tags: dict[str, str | None] = field(default_factory=lambda: dict(ENTITY_TAGS))
    whitelist: tuple[str, ...] = WHITELIST
    # Words added by the user may equal a match, the built-in ones cannot.
    custom_whitelist: bool = False
    # A column beside the text: an array of trimmed words in lower case that are spared in it.
    whitelist_column: str = ""
    entropy_threshold: float = 3.5
    ocr_confidence: int = 40

    def with_whitelist(self, words: Iterable[str]) -> RuleSet:
        """The same rules with more words that are never redacted."""
        cleaned = (w.strip().lower() for w in words)
        merged = dict.fromkeys([*self.whitelist, *(w for w in cleaned if w)])
        return replace(self, whitelist=tuple(merged), custom_whitelist=True)

    def private_keys_first(self) -> RuleSet:
        """Run the private key rule before all others.

        In rule order a number inside a key is tagged first, and the key, now
        crossing a tag, is left readable.  That order is the default because
        results have to agree with it; this one closes the leak.
        """
        first = [r for r in self.patterns if r.tag == "<private_key>"]
        rest = [r for r in self.patterns if r.tag != "<private_key>"]
        return replace(self, patterns=tuple(first + rest))

    def without_letters(self) -> RuleSet:
        """The pattern rules that can match a text of digits, points and signs."""
        shapes = tuple(r for r in self.patterns if r.letterless())
        return replace(self, patterns=shapes, contexts=(), keywords={})

    def tags(self) -> list[str]:
        """Every tag a run can put in, each once, in order of the phases."""
        tags = [r.tag for r in self.contexts]
        tags += [r.tag for r in self.patterns]
        tags += [t for t in self.entity_tags.values() if t]
        tags += [keyword_tag(c) for c in self.redacted_categories]
        return list(dict.fromkeys(tags))

    def keyword_rows(self) -> list[tuple[str, str, bool]]:
        """(category, keyword, redacts_text), in order."""
        return [
            (category, word, category in self.redacted_categories)
            for category, words in self.keywords.items()
            for word in words
        ]


DEFAULT_RULES = RuleSet()
