"""The tree search against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from inkveil.llm import kmtree
from inkveil.llm.kmtree import cells_of, fit_tree, neighbours_of_embeddings, search
from inkveil.llm.vectors import usable
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<double>, leaf string, cell int"


def brute(rows, queries, k):
    out = []
    for q, x in queries:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in rows if i != q)
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return out


def recall(got, want):
    return len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) / max(1, len(want))


def test_tree_routes_and_visits_every_leaf():
    x = np.random.default_rng(2).normal(size=(900, 8))
    tree = fit_tree(x)
    leaf = tree.route(x)
    assert set(leaf.tolist()) <= set(range(tree.leaves)) and len(set(leaf.tolist())) > 40
    for order in tree.visits(x[:20], tree.leaves):
        assert sorted(order) == list(range(tree.leaves))


def test_cells():
    first, number = cells_of(np.array([3, 4, 25, 0, 9, 2]), 10)
    spans = [range(f, f + n) for f, n in zip(first, number, strict=True)]
    assert [len(s) for s in spans] == [1, 1, 3, 1, 1, 1] and spans[0] == spans[1]


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = [tuple(r) for r in neighbours_of_embeddings(spark, str(DATA)).collect()]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    exact = {(q, i): d for q, _, i, d in brute(rows, [r for r in rows if r[0] % 100 == 0], len(rows))}
    for q in {r[0] for r in got}:
        mine = sorted(r[1:] for r in got if r[0] == q)
        assert [r[0] for r in mine] == list(range(1, 11))
        assert sorted((d, i) for _, i, d in mine) == [(d, i) for _, i, d in mine]
    assert all(abs(d - exact[q, i]) < 1e-12 for q, _, i, d in got)


def test_hot_vector_and_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(300)] + [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(300, 500)]
    odd = [(600, None), (700, [0.0] * 4), (800, [float("nan")] * 4), (None, [1.0] * 4), (900, [None, 1.0, 1.0, 1.0]), (1000, [])]
    df = usable(spark.createDataFrame([(*r, "x", 1) for r in rows + odd], SCHEMA), "vec_id", "embedding", nonzero=True)
    queries = df.filter("id % 20 = 0")
    got = [tuple(r) for r in search(df, queries, k=5, cell_rows=32).collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 5)
    assert len(got) == len(want) and recall(got, want) >= 0.9


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, [1.0]), (1, [1.0]), (2, [1.0, 2.0])]])
def test_few_rows(spark, rows):
    df = usable(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), "vec_id", "embedding", nonzero=True)
    got = sorted((q, r, i) for q, r, i, _ in search(df, df.filter("id = 0"), k=5).collect())
    assert got == [(0, r + 1, i) for r, (i, _) in enumerate(rows[1:])]


def test_outlying_queries_get_all_rows(spark):
    """Tight groups of equal vectors and a few far away, whose leaves hold nobody else."""
    draw = np.random.default_rng(5)
    rows = [(14 * g + i, draw_centre.tolist()) for g, draw_centre in enumerate(draw.normal(size=(400, 6))) for i in range(14)]
    far = [(10_000 + i, (draw.normal(size=6) * 50).tolist()) for i in range(6)]
    df = usable(spark.createDataFrame([(*r, "x", 1) for r in rows + far], SCHEMA), "vec_id", "embedding", nonzero=True)
    asked = [r for r in rows if r[0] % 140 == 0] + far
    queries = df.filter("id % 140 = 0 and id < 10000 or id >= 10000")
    got = [tuple(r) for r in search(df, queries).collect()]
    want = brute(rows + far, asked, 10)
    assert len(got) == len(want) == 10 * len(asked)
    outliers = [r for r in want if r[0] >= 10_000]
    scores = {}
    for q, _, _, d in got:
        scores.setdefault(q, []).append(d)
    for q, _ in asked:  # by distance, as equal vectors are as good as one another
        mine, best = sorted(scores[q]), [r[3] for r in want if r[0] == q]
        assert sum(abs(a - b) < 1e-9 for a, b in zip(mine, best, strict=True)) >= (9 if q < 10_000 else 0)
    assert recall(got, outliers) >= 0.3


def test_own_rows_do_not_count(spark):
    """Many rows of the query's id in its leaf: others have to be opened."""
    rows = [(7, [1.0, 0.0])] * 300 + [(i, [float(i), 5.0]) for i in range(100, 200)]
    df = usable(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), "vec_id", "embedding", nonzero=True)
    got = search(df, df.filter("id = 150"), k=5).count()
    assert got == 5
    assert search(df, df.filter("id = 7").limit(1), k=5).count() == 5


def test_large_leaves_are_ranges_of_cells(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5000)] + [(5000 + i, [float(i), -3.0]) for i in range(50)]
    df = usable(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), "vec_id", "embedding", nonzero=True)
    got = sorted((r.rank, r.vec_id) for r in search(df, df.filter("id = 4000"), k=5, cell_rows=16).collect())
    assert got == [(i + 1, i) for i in range(5)]


def test_queries_of_many_parts(spark, monkeypatch):
    """Queries are dealt over parts, and meet the cells by a merge: what a query's cells hold of it is no small table."""
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, x array<double>").localCheckpoint()
    queries = df.filter("id % 5 = 0")
    queries = queries.unionByName(queries.filter("id < 100"))
    whole = sorted(map(tuple, search(df, queries, k=4, cell_rows=64).collect()))
    monkeypatch.setattr(kmtree, "QUERY_ROWS", 30)
    dealt = search(df, queries, k=4, cell_rows=64)
    assert sorted(map(tuple, dealt.collect())) == whole and len(whole) == 4 * 200
    joins = [x for x in dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Join" in x and "cell" in x]
    assert joins and not any("Broadcast" in x for x in joins)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e-160, 1e155, 1e200])
def test_nearest_holds_whatever_is_among_the_least(scale):
    """Against all distances: ties, near ties, far offsets, and numbers that overflow or lose precision."""
    draw = np.random.default_rng(11)
    for offset, width in ((0.0, 5), (1e6, 64), (3.0, 1)):
        x = draw.normal(size=(400, width))
        x[200:300] = x[:100]
        x[300:350] = np.nextafter(x[:50], 9)
        x, q = (x + offset) * scale, (np.concatenate((x[:20], draw.normal(size=(30, width)))) + offset) * scale
        allowed = draw.random((50, 400)) < 0.6
        allowed[7] = False
        allowed[8, 5:] = False
        d = kmtree.distances(q, x)
        who, what = kmtree.nearest(q, x, allowed, 10)
        assert (kmtree.paired_distances(q, x, who, what) == d[who, what]).all()
        pairs = set(zip(who.tolist(), what.tolist(), strict=True))
        for i in range(50):
            mine = np.where(allowed[i], d[i], np.inf)
            need = np.flatnonzero(allowed[i] & (mine <= np.sort(mine)[9]))
            assert {(i, j) for j in need.tolist()} <= pairs and all(allowed[p] for p in pairs)
        if scale == 1.0 and not offset:
            assert len(who) < 50 * 40


def test_vectors_of_several_widths_are_paired():
    draw = np.random.default_rng(12)
    q, x = draw.normal(size=(4, 3)), draw.normal(size=(30, 7))
    who, what = kmtree.nearest(q, x, np.ones((4, 30), bool), 2)
    assert len(who) == 8 and (kmtree.paired_distances(q, x, who, what) == kmtree.distances(q, x)[who, what]).all()
