"""The size-aware join against comparing all pairs."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest

from inkveil.llm import jaccard
from inkveil.llm.components import components
from inkveil.llm.jaccard import ORACLE, boundary, components_of_documents, forest, grouped, spare

DATA = "/root/testdata/sf0.01"


def plain_set(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def plain(rows, words=3, percent=90):
    sets = [plain_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[root(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def family(draw, words, size, changes):
    base = draw.choices(words, k=size)
    for _ in range(6):
        copy = list(base)
        for _ in range(draw.randrange(changes + 1)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        yield " ".join(copy)


@pytest.mark.parametrize("percent,words", [(90, 3), (80, 2)])
def test_fuzz(spark, monkeypatch, percent, words):
    draw = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [t for size in (1, 2, 3, 5, 11, 13, 17, 20, 21, 22, 23, 30, 40, 60, 90, 200) for t in family(draw, vocabulary, size, max(1, size // 25))]
    texts += ["a b", "A  b", "b a", "a", "a", "", None, "  ", "a b c", "\x85 x y z", "\x85 X Y z"]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 300)
    monkeypatch.setattr(jaccard, "COMMON_FROM", 4)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int")
    got = sorted(map(tuple, grouped(docs, words=words, percent=percent).collect()))
    assert got == plain(rows, words, percent)


def test_pieces_of_a_text_do_not_matter(monkeypatch):
    draw = random.Random(2)
    texts = [" ".join("x" * draw.randrange(1, 12) + str(draw.randrange(9)) for _ in range(draw.randrange(60))) for _ in range(50)] + ["y" * 500, "", None]
    whole = jaccard.Shingler().sets(texts)
    monkeypatch.setattr(jaccard, "BYTES_TOGETHER", 7)
    for a, b, t in zip(whole, jaccard.Shingler().sets(texts), texts, strict=True):
        assert (a == b).all() and len(a) == len(plain_set(t))


def test_hot_near_copies(spark, monkeypatch):
    """Many near copies of one text, most linked through the original only."""
    draw = random.Random(8)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        copy = list(base)
        for at in draw.sample(range(150), draw.choice([1, 2, 2, 3, 9])):
            copy[at] = f"v{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 2000)
    got = sorted(map(tuple, grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == plain(rows)


def test_equal_ids_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, "other words here"), (2, text + " x"), (2, text), (None, text), (None, None), (None, "lone words stand"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, grouped(docs).collect()), key=str)
    want = [(1, 58, 1), (1, 1, 1), (2, 59, 1), (2, 58, 1), (None, 58, 1), (None, 0, None), (None, 1, None), (3, 0, 3)]
    assert got == sorted(want, key=str)
    assert grouped(docs.filter("doc_id < 0")).count() == 0


def test_forest_and_boundary():
    sets = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(5, 30, dtype=np.uint64)]
    assert forest(np.array([7, 8, 9]), sets, 90) == [(7, 8)]
    assert [spare(n) for n in (1, 9, 10, 19, 20)] == [0, 0, 1, 1, 2]
    assert boundary({n: 1 for n in range(1, 60)}, 1.0) < boundary({n: 1 for n in range(1, 60)}, 1.3) <= boundary({n: 1 for n in range(1, 60)}, 50)


def test_components(spark):
    draw = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(120)] + [(5, 5), (500, 500)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == sorted((x, root(x)) for x in parent)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = components_of_documents(spark, DATA)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(ORACLE).fetchall())
