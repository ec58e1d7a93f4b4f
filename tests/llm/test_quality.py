"""The trees against walking them one by one; held-out accuracy; odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from inkveil.llm.gbt import Settings, fit
from inkveil.llm.quality import NAMES, fit_quality, label_sample, quality_of_documents, score_quality, statistics

DATA = "/root/testdata/sf0.01"


def walked(forest, row):
    total = forest.start
    for feature, cut, value in zip(forest.feature, forest.cut, forest.value, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(row[feature[at]] > cut[at])
        total += value[at - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_traversal_equals_walking():
    draw = np.random.default_rng(1)
    x = np.round(draw.normal(size=(600, 5)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float)
    forest = fit(x, y, Settings(trees=20, depth=3))
    got = forest.probability(x)
    assert np.allclose(got, [walked(forest, r) for r in x])
    assert ((got > 0.5) == y).mean() > 0.95


def plain_fit(x, y, s):
    """Margins of the rows after boosting with trees that are grown by trying every feature and cut on the rows themselves."""
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, s.bins + 1)[1:-1]))) for f in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)

        def worth(rows):
            return grad[rows].sum() ** 2 / (hess[rows].sum() + s.ridge)

        def grown(rows, depth):
            if depth == s.depth:
                margin[rows] += s.rate * grad[rows].sum() / (hess[rows].sum() + s.ridge)
                return
            best = (1e-9, None, None)
            for f, edges in enumerate(cuts):
                for cut in edges:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(left), len(right)) >= s.least_rows:
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, left, right)
            if best[1] is None:
                grown(rows, s.depth)
                return
            grown(best[1], depth + 1)
            grown(best[2], depth + 1)

        grown(np.arange(len(y)), 0)
    return margin


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fit_equals_trying_every_cut(seed):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(150, 3)), 1)
    y = (x[:, 0] * x[:, 1] + draw.normal(size=150) * 0.3 > 0.1).astype(float)
    s = Settings(trees=4, depth=3, bins=12, least_rows=6)
    assert np.allclose(fit(x, y, s).margin(x), plain_fit(x, y, s), atol=1e-9)


@pytest.mark.parametrize("y", [[], [1.0] * 30, [0.0, 1.0]])
def test_little_to_learn_from(y):
    x = np.zeros((len(y), len(NAMES)))
    p = fit(x, np.array(y)).probability(np.zeros((2, len(NAMES))))
    assert ((p > 0) & (p < 1)).all() and p[0] == p[1]


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = quality_of_documents(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_statistics():
    assert statistics(None) == statistics("") == [0.0] * len(NAMES)
    assert all(np.isfinite(statistics(t)).all() for t in [" ", "\n", "a", "!!!", "é" * 300_000, "a " * 100_000, "\x00"])


def test_sample_and_odd_rows(spark):
    rows = [(i, i % 2, "x") for i in range(3000)] + [(5, None, "x"), (None, 1, "x"), (7, 1, "x"), (7, 1, "x")]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, text string")
    sample = label_sample(labels, 500)
    keys = [r[0] for r in sample.collect()]
    assert 300 < len(keys) <= 500 and len(set(keys)) == len(keys)
    texts = ["plain words stand here in a line. " * 5, "SHOUT!! " * 30]
    docs = spark.createDataFrame([(i, texts[i % 2], "y", 0.5) for i in range(200)] + [(0, texts[0], "y", 0.1), (900, None, "y", 0.1), (901, "", "y", 0.1)],
                                 "doc_id long, text string, quality string, score double")
    forest = fit_quality(docs, labels)
    got = {}
    for r in score_quality(docs, forest, ["doc_id"]).collect():
        assert got.setdefault(r.doc_id, r.score) == r.score
    assert got[0] < 0.3 < got[1] and got[900] == got[901]
    empty = labels.filter("doc_id < 0")
    none = fit_quality(docs, empty)
    assert {r.score for r in score_quality(docs, none, ["doc_id"]).collect()} == {0.5}
    assert score_quality(docs.filter("doc_id < 0"), none, ["doc_id"]).count() == 0
