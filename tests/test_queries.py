"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import DATA

QUERIES, ORACLES = queries(), oracle_sql()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    relation = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    got = multiset(df.columns, [tuple(r) for r in df.collect()])
    want = multiset(relation.columns, relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "redacted"]


def test_all_rules_fire(spark):
    """But for the one whose shape earlier rules take."""
    from inkveil.rules import DEFAULT_RULES
    from inkveil.rules.words import keyword_tag

    rows = QUERIES["all_rules_audit"](spark, str(DATA)).select("reason", "redacted_to").distinct().collect()
    by_pattern = {r["redacted_to"] for r in rows if r["reason"] == "Regex"}
    assert {r.tag for r in DEFAULT_RULES.patterns} - by_pattern == {"<ssn>"}
    triggers = {r["reason"] for r in rows if r["reason"].startswith("Contextual")}
    assert triggers == {f"Contextual: '{r.trigger}'" for r in DEFAULT_RULES.contexts}
    words = {r["redacted_to"] for r in rows if r["reason"].startswith("Keyword")}
    assert words == {keyword_tag(c) for c in DEFAULT_RULES.redacted_categories}
