"""Masked spellings for the audit log."""

from __future__ import annotations

from inkveil.functions.sql import Sql, let, matches


def mask(text: Sql) -> Sql:
    """Keep just enough of a redacted text to recognise it.

    Of a mail address: first and last letter of the user, first letter and last
    label of the host.
    """
    address = let(
        "parts",
        f"split({text}, '@', -1)",
        "concat(left(parts[0], 1), '...',"
        " if(char_length(parts[0]) > 2, right(parts[0], 1), ''), '@',"
        " left(parts[1], 1), '...', element_at(split(parts[1], '[.]', -1), -1))",
    )
    size = f"char_length({text})"
    return (
        f"CASE WHEN {matches(text, r'\A[^@]+@[^@]+\.[^@]+')} THEN {address}"
        f" WHEN {size} <= 2 THEN repeat('*', {size})"
        f" WHEN {size} <= 5 THEN"
        f" concat(left({text}, 1), repeat('*', {size} - 2), right({text}, 1))"
        f" ELSE concat(left({text}, 2), '...', right({text}, 2)) END"
    )
