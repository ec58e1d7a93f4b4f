"""Cheap tests that tell whether a rule can match a text at all.

Most texts are plain prose, and most rules need a digit, an "@", a hyphen or a
certain word.  Looking for those first spares such texts the pattern search.

The facts are taken from the text as it was before any rule ran.  That is safe:
rules only take characters away or put tags in, and no default rule matches
inside a tag.  A rule that could (a keyword spelled like a tag, say) is left
without a test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from inkveil.functions.regex import WORD
from inkveil.functions.sql import Sql, any_of, matches, string, strings

# Letters equal to an ASCII letter when case is ignored, but not in lower case:
# the long s, the Kelvin sign and the two Turkish letters i.
_FOLDED = ("\u017f", "\u212a", "\u0130", "\u0131")


def facts(text: Sql) -> Sql:
    """What the tests need to know about a text, found out once per text."""
    digit = matches(text, r"\p{Nd}")
    return (
        f"named_struct('text', {text}, 'low', lower({text}),"
        f" 'folded', {_contains(text, _FOLDED)}, 'digit', {digit})"
    )


def has_whole_word(low: Sql, words: Iterable[str]) -> Sql:
    """One of many words stands in the lower-case text by itself.

    The cost does not grow with the number of words.
    """
    found = f"split({low}, {string(f'[^{WORD}]+')})"
    return f"arrays_overlap({found}, array({strings(sorted(set(words)))}))"


def _contains(text: Sql, needles: Iterable[str]) -> Sql:
    return any_of(f"contains({text}, {string(n)})" for n in needles)


def has_word(f: Sql, needles: Iterable[str]) -> Sql:
    """One of the ASCII words is part of the text, case aside."""
    return any_of([_contains(f"{f}.low", [n.lower() for n in needles]), f"{f}.folded"])


def _has(*needles: str) -> Callable[[Sql], Sql]:
    return lambda f: _contains(f"{f}.text", needles)


def _has_word(*needles: str) -> Callable[[Sql], Sql]:
    return lambda f: has_word(f, needles)


def _inner_dot(f: Sql) -> Sql:
    return f"({_has('.')(f)} AND {matches(f + '.text', r'[a-zA-Z0-9]\.[a-zA-Z]{2}')})"


def _currency(f: Sql) -> Sql:
    return any_of([_has("₹")(f), has_word(f, ("rs", "inr"))])


TESTS: dict[str, Callable[[Sql], Sql]] = {
    "digit": lambda f: f"{f}.digit",
    "at": _has("@"),
    "dot": _has("."),
    "colon": _has(":"),
    "hyphen": _has("-"),
    "hyphen_or_colon": _has("-", ":"),
    "scheme": _has("://"),
    "inner_dot": _inner_dot,
    "pem_word": _has("PRIVATE"),
    "cvv_word": _has_word("cv", "cid"),
    "key_word": _has_word("key", "token", "bearer"),
    "secret_word": _has_word("pass", "pwd", "secret", "pin"),
    "ssh_word": _has_word("ssh-", "ecdsa-"),
    "birth_word": _has_word("dob", "birth"),
    "currency": _currency,
}


def may_match(f: Sql, needs: Iterable[str]) -> Sql:
    """All tests of a rule taken together."""
    return "(" + (" AND ".join(TESTS[need](f) for need in needs) or "true") + ")"
