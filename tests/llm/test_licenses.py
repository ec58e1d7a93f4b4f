"""Licence matches against plain sets, and against the SQL."""

from __future__ import annotations

import random
import re
import string

import duckdb
import pytest

from inkveil.llm.license_texts import FULL
from inkveil.llm.licenses import LEAST, ORACLE, found, licenses_of_documents, telling_words, templates

DATA = "/root/testdata/sf0.01"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_bigrams(text):
    w = re.sub("[^a-z0-9]+", " ", text.translate(LOWER)).strip(" ").split(" ")
    return set(zip(w, w[1:], strict=False))


def plain(rows):
    known = [(name, part, plain_bigrams(t)) for name, part, t in templates()]
    out = []
    for doc_id, text in rows:
        text = text or ""
        parts = re.split(r"\n[ \t\r]*\n", text)
        units = [("line", i, t) for i, t in enumerate(text.split("\n"))] + [("paragraph", i, t) for i, t in enumerate(parts) if "\n" in t]
        units += [("text", 0, text)] if len(parts) > 1 else []
        sentences = re.split("\x01|\n[ \t\r]*\n", re.sub(r"([.!?])[ \t\r\n]+", "\\1\x01", text))
        units += [("sentence", i, t) for i, t in enumerate(sentences) if t not in text.split("\n")]
        for unit, number, t in units:
            b = plain_bigrams(t)
            scores = [(-2 * len(b & k) / (len(b) + len(k)), name, part) for name, part, k in known if b]
            if scores and -min(scores)[0] >= LEAST:
                low, name, part = min(scores)
                out.append((doc_id, unit, number, name, part, pytest.approx(-low)))
    return out


def key(row):
    return str(row[0]), row[1], row[2]


def test_against_plain_sets(spark):
    draw = random.Random(3)
    texts = [f"Intro words.\n{t}\n\nmore text here" for _, _, t in templates()]
    for t in FULL.values():
        words = t.split(" ")
        for changes in (1, 4, 12):
            copy = list(words)
            for _ in range(changes):
                copy[draw.randrange(len(copy))] = draw.choice(["x", "software", "the", ""])
            texts.append(" ".join(copy).replace(". ", ".\n"))
    texts += ["", None, "\n\n", "MIT", "x " * 40_000, "RELEASED   under\tthe *MIT* license", "Ünder the MIT License.", "a\n \t\r\nb\n\n\nc"]
    texts += [f"A library by the team. {t} See the file for more." for _, _, t in templates()]
    texts += [f"Made by us.\n{t.replace(' ', chr(10), 2)} def code(): pass\nx = 1. y = 2\x01z" for _, _, t in templates()[::4]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(0, texts[0], "x", 1)], "doc_id long, text string, unit string, number int")
    got = sorted(map(tuple, found(docs).collect()), key=key)
    assert got == sorted(plain([*rows, (0, texts[0])]), key=key) and len(got) > 150
    assert found(docs.filter("doc_id < 0")).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = licenses_of_documents(spark, DATA)
    relation = con.sql(ORACLE)
    assert df.columns == relation.columns
    got = sorted(map(tuple, df.collect()), key=key)
    assert got == sorted(relation.fetchall(), key=key) and len(got) > 10


def test_native(spark):
    plan = licenses_of_documents(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_notices_inside_lines(spark):
    rows = [(1, "Made by the team. Licensed under the MIT License. See LICENSE."), (2, FULL["BSD-3-Clause"]), (3, FULL["BSD-2-Clause"]), (4, "no such thing")]
    got = {(r.doc_id, r.unit, r.licence) for r in found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (1, "sentence", "MIT") in got and (2, "text", "BSD-3-Clause") in got and (3, "text", "BSD-2-Clause") in got
    assert {g[0] for g in got} == {1, 2, 3} and (2, "text", "BSD-2-Clause") not in got


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9, 1.0])
def test_what_holds_no_telling_word_is_like_no_template(least):
    texts = [t for *_, t in templates()]
    some = telling_words(texts, least)
    for t in texts:
        bigrams = plain_bigrams(t)
        without = {p for p in bigrams if not any(s in w for w in p for s in some)}
        # The best unit without these words shares all other bigrams and has no more.
        assert 2 * len(without) / (len(without) + len(bigrams)) < least
