"""How random a word looks."""

from __future__ import annotations

from inkveil.functions.regex import ANY_DIGIT
from inkveil.functions.sql import Sql, matches


def _characters(word: Sql) -> Sql:
    return f"array_distinct(split({word}, ''))"


def entropy(word: Sql) -> Sql:
    """Shannon entropy over the characters of a word, in bits; 0 for none."""
    size = f"char_length({word})"
    share = f"(({size} - char_length(replace({word}, ch, ''))) / {size})"
    shares = f"transform({_characters(word)}, ch -> {share})"
    bits = f"aggregate({shares}, 0D, (acc, p) -> acc - p * log2(p))"
    return f"if({size} > 0, {bits}, 0D)"


def looks_random(word: Sql, threshold: float = 3.5) -> Sql:
    """Long, of high entropy, and mixed as keys and tokens are.

    ``n`` different characters give at most log2(n) bits, which settles most
    words before the entropy is worked out.
    """
    fewest = int(2**threshold) + 1
    upper, lower = matches(word, r"\p{IsUppercase}"), matches(word, r"\p{IsLowercase}")
    sign = matches(word, rf"[{ANY_DIGIT}\-_+/=]")
    return (
        f"(char_length({word}) >= {max(8, fewest)} AND ({sign} OR ({upper} AND {lower}))"
        f" AND size({_characters(word)}) >= {fewest} AND {entropy(word)} > {threshold}D)"
    )
