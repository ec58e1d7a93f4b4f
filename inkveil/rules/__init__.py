"""Rules as data."""

from inkveil.rules.context import NUMBER, REST_OF_LINE, ContextRule
from inkveil.rules.patterns import PatternRule
from inkveil.rules.ruleset import DEFAULT_RULES, RuleSet

__all__ = ["DEFAULT_RULES", "NUMBER", "REST_OF_LINE", "ContextRule", "PatternRule", "RuleSet"]
