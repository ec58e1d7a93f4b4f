"""Small text helpers, with Python's idea of blanks and digits."""

from __future__ import annotations

from inkveil.functions.regex import ANY_DIGIT, SPACE
from inkveil.functions.sql import Sql, let, matches, replace_all, string

# Line breaks as Python's splitlines sees them.
_LINE_BREAK = r"(?:\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029])"


def strip(text: Sql) -> Sql:
    # A run of blanks inside is looked at once, from its first blank.
    return replace_all(text, rf"\A[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z", "")


def has_content(text: Sql, length: int = 1) -> Sql:
    """The text without outer blanks has at least ``length`` (1 or 3) characters."""
    rest = {1: "", 3: rf"(?s:.)+?[^{SPACE}]"}[length]
    return f"coalesce({matches(text, f'[^{SPACE}]{rest}')}, false)"


def words(text: Sql) -> Sql:
    """The blank-separated words of a text."""
    return f"filter(split({text}, {string(f'[{SPACE}]+')}), w -> w <> '')"


def flatten_lines(text: Sql) -> Sql:
    """Lines joined by blanks; a line break at the very end vanishes."""
    return replace_all(replace_all(text, _LINE_BREAK + r"\z", ""), _LINE_BREAK, " ")


def all_digits(text: Sql, up_to: int) -> Sql:
    return matches(text, rf"\A[{ANY_DIGIT}]{{1,{up_to}}}\z")


# Characters of a text that are found together.
_CHUNK = 1024


def chunks(text: Sql) -> Sql:
    """The text in pieces, for many cuts out of it: a place in a string is found by counting."""
    return (
        f"transform(sequence(0L, char_length({text}) DIV {_CHUNK}),"
        f" i -> substring({text}, int(i * {_CHUNK}) + 1, {_CHUNK}))"
    )


def cut(pieces: Sql, first: Sql, last: Sql) -> Sql:
    """From character ``first`` (from 0) to before ``last`` of a text in ``chunks``."""
    begin, end = f"(({first}) DIV {_CHUNK})", f"(({last}) DIV {_CHUNK})"
    joined = f"array_join(slice({pieces}, int({begin}) + 1, int({end} - {begin}) + 1), '')"
    return f"substring({joined}, int(({first}) % {_CHUNK}) + 1, int(({last}) - ({first})))"


def around_matches(text: Sql, pattern: str, least: int, window: int = 50) -> Sql:
    """Array of struct(match, context): each match with ``window`` characters on either side.

    Matches are at least ``least`` characters long, which bounds how many of the
    neighbouring pieces a context can reach.
    """
    hits, gaps = f"regexp_extract_all({text}, {string(pattern)}, 0)", f"split({text}, {string(pattern)}, -1)"
    reach = 2 * (window // least + 1)
    first = f"greatest(2 * i + 1 - {reach}, 1)"
    before = f"right(array_join(slice(pieces, {first}, 2 * i + 2 - {first}), ''), {window})"
    after = f"left(array_join(slice(pieces, 2 * i + 3, {reach + 1}), ''), {window})"
    pieces = f"flatten(zip_with({gaps}, hits, (gap, hit) -> if(hit IS NULL, array(gap), array(gap, hit))))"
    context = f"named_struct('match', hit, 'context', concat({before}, hit, {after}))"
    return let("hits", hits, let("pieces", pieces, f"transform(hits, (hit, i) -> {context})"))
