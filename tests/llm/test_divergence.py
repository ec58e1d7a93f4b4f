"""Pairs of sources and telling terms against plain counting of every term."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkveil.llm.divergence import Audit, ranked, term_counts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain(docs, least=10, top=10):
    """All rows of the report, from (text, lang, source)."""
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall((text or "").translate(FOLD))
        counts[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        groups = {s: c for (own, s), c in counts.items() if own == lang}
        total = sum(groups.values(), Counter())

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(total)

        def apart(a, b):
            return (a - b) ** 2 // (a + b)

        for s, c in groups.items():
            parts = {
                "pair": [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s],
                "term": [(apart(p[s][t], q[t]), t) for t in kept if c[t] and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(items[: top if part == "term" else None], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def report(spark, docs, least=10, top=10, pieces=3):
    audit = Audit(spark.createDataFrame(docs, "text string, lang string, source string").repartition(pieces), least)
    rows = ranked(audit.pairs(), "pair").unionByName(ranked(audit.telling_terms(), "term", top))
    return sorted(map(tuple, rows.collect()))


def some_documents():
    rng = random.Random(3)
    terms = ["The", "the", "é", "ÉA", "Éa", "ǅ", "x", "Zz", "kK", "日本", "a b", "ſ", "K"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    weights = [1 / (1 + i) for i in range(len(terms))]
    docs = []
    for i in range(500):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "", "é", "d1", "d2"])
        lang = rng.choice(["en", "de", None])
        words = rng.choices(terms, weights, k=rng.choice([0, 1, 5, 40]))
        docs.append((rng.choice([" ", "1", "_", "\x00", "[", "{\n"]).join(words), lang, source))
    docs += docs[:40]
    docs += [(None, "en", "no text"), ("", "en", "empty"), ("only seldom", "rare", "one"), ("only seldom", "rare", "two"), ("12 34", None, None)]
    return docs


def test_report(spark):
    docs = some_documents()
    want = plain(docs)
    assert {r[2] for r in want} == {"pair", "term"} and len(want) > 100
    assert report(spark, docs) == want
    assert report(spark, docs, pieces=1) == want


def test_thresholds(spark):
    docs = some_documents()
    assert report(spark, docs, least=1, top=3) == plain(docs, least=1, top=3)
    assert {r[4] for r in report(spark, docs, least=1000)} == {0}


def test_one_source_with_a_long_text(spark):
    docs = [("so it is " * 200_000, "en", "a")] + [("so it was", "en", s) for s in "ab" * 6]
    assert report(spark, docs) == plain(docs)


def test_no_rows(spark):
    assert report(spark, []) == []


def test_partial_counts_are_handed_on(spark, monkeypatch):
    docs = spark.createDataFrame([("Aa aa b" + chr(97 + i % 20), "x", "y") for i in range(200)], "text string, lang string, source string")
    rows = {r.term: (r.n, r.documents) for r in term_counts(docs).collect()}
    assert rows["aa"] == (400, 200) and rows["bc"] == (10, 10)


@pytest.mark.parametrize("column", ["n", "term", "word", "bits", "a.b"])
def test_clashing_columns(spark, column):
    docs = some_documents()[:60]
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumn(column, F.lit(1))
    audit = Audit(df, 5)
    assert sorted(map(tuple, ranked(audit.pairs(), "pair").collect())) == [r for r in plain(docs, 5) if r[2] == "pair"]
