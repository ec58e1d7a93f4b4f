"""Pieces of Spark SQL text.

Expressions here are strings of Spark SQL rather than ``Column`` objects: a
cascade has thousands of nodes, and as text they reach the JVM in one call per
projection instead of one call per node.  Use them with ``F.expr`` or
``selectExpr``.
"""

from __future__ import annotations

from collections.abc import Iterable

Sql = str


def string(value: str) -> Sql:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> Sql:
    return ", ".join(string(v) for v in values)


def name(column: str) -> Sql:
    """A column name, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def let(variable: str, value: Sql, body: Sql) -> Sql:
    """``body``, in which ``variable`` stands for ``value``, worked out once per row."""
    return f"transform(array({value}), {variable} -> {body})[0]"


def any_of(tests: Iterable[Sql]) -> Sql:
    """True if one of the tests is; false for no tests."""
    return "(" + (" OR ".join(tests) or "false") + ")"


def replace_all(text: Sql, pattern: str, replacement: str) -> Sql:
    """``replacement`` may hold ``$1`` and so on."""
    return f"regexp_replace({text}, {string(pattern)}, {string(replacement)})"


def matches(text: Sql, pattern: str) -> Sql:
    return f"({text} RLIKE {string(pattern)})"


def fenced(fields: dict[str, Sql]) -> Sql:
    """Named expressions that the optimizer keeps in one place.

    One row in, one row out: what is done with the results later, a filter above
    all, cannot be merged into the expressions and repeat them.
    """
    listed = ", ".join(f"{string(field)}, {value}" for field, value in fields.items())
    return f"inline_outer(array(named_struct({listed})))"
