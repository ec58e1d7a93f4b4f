"""The bit-sliced index against plain sorting."""

from __future__ import annotations

import numpy as np
import pytest

from inkveil.llm.bitsliced import Block, quantised, search, sliced
from inkveil.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<double>, score string, rank int"


def plain(rows, every, k, scale=64):
    values = {i: quantised(np.array(x), scale) for i, x in rows}
    out = []
    for q in (i for i, _ in rows if i % every == 0):
        def inner(i, q=q):
            return sum(a * b for a, b in zip(values[q].tolist(), values[i].tolist(), strict=False))
        order = sorted((-inner(i), i) for i, _ in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows,width,spread", [(1, 3, 5), (70, 4, 1), (200, 16, 60), (130, 5, 0)])
def test_block(rows, width, spread):
    draw = np.random.default_rng(rows)
    values = draw.integers(-spread, spread + 1, (rows, width))
    ids = np.arange(rows) * 3
    least, bits, slices = sliced(values)
    block = Block(ids, width, bits, least, slices.ravel())
    for q in range(min(rows, 20)):
        at, scores = block.search(values[q], int(ids[q]), 7)
        order = sorted((-int(values[q] @ values[i]), i) for i in range(rows) if i != q)[:7]
        assert sorted(zip((-scores).tolist(), at.tolist(), strict=True)) == order


def test_search_with_ties_and_many_blocks(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.integers(-2, 3, 6) / 64).tolist()) for i in range(150)] + [(1000 + i, [0.5] * 6) for i in range(60)]
    df = usable(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), "vec_id", "embedding")
    got = search(df, df.filter("id % 10 = 0"), k=8, block_rows=40, query_rows=7)
    assert sorted(map(tuple, got.collect())) == plain(rows, 10, 8)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -1.0]), (1, [2.0, 0.5, 3.0]), (2, []), (4, [-0.001, 7.5])]
    odd = [(5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0])]
    df = usable(spark.createDataFrame([(*r, "x", 1) for r in rows + odd], SCHEMA), "vec_id", "embedding")
    assert sorted(map(tuple, search(df, df.filter("id % 2 = 0"), k=2).collect())) == plain(rows, 2, 2)
    none = df.filter("id < 0")
    assert search(none, none).count() == 0
    assert search(df, none).count() == 0
    assert search(df.filter("id = 0"), df.filter("id = 0")).count() == 0


def test_repeated_rows(spark):
    df = usable(spark.createDataFrame([(0, [1.0], "", 0), (0, [1.0], "", 0), (1, [2.0], "", 0), (1, [2.0], "", 0)], SCHEMA), "vec_id", "embedding")
    got = sorted(map(tuple, search(df, df.filter("id = 0"), k=3).collect()))
    assert got == [(0, 1, 1, 8192)] * 2 + [(0, 2, 1, 8192)] * 2


def test_large_components(spark):
    rows = [(1, [1.0, 1.0]), (2, [300_000.0, 0.5]), (3, [500_000.0, -1.0]), (4, [400_000.0, 0.0]), (20, [1000.0, 7.0]), (40, [-2.0**30, 3.0])]
    df = usable(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), "vec_id", "embedding")
    assert sorted(map(tuple, search(df, df.filter("id % 20 = 0"), k=4).collect())) == plain(rows, 20, 4)


def test_what_no_long_can_hold_is_an_error(spark):
    def found(*vectors):
        df = usable(spark.createDataFrame([(i, list(x), "x", 1) for i, x in enumerate(vectors)], SCHEMA), "vec_id", "embedding")
        return search(df, df.filter("id = 0"), k=1).collect()

    big = 2.0**31  # quantised 2**37
    assert found([2.0**18], [2.0**31])[0].score == 2**61
    for vectors in ([[big], [big]], [[1e300], [1.0]]):
        with pytest.raises(Exception, match="fit a long"):
            found(*vectors)
    # One that is not among the best does no harm.
    assert found([big], [-big], [1.0])[0].score == 2**43
