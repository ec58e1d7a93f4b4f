"""The pipeline stage by stage against plain versions of what each stage decides."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from inkveil.llm import queries as registered
from inkveil.llm.bpe import load
from inkveil.llm.secret_scan import _Patterns, base_spans
from tests.llm.test_jaccard import plain
from tests.llm.test_mixing import plain_targets

DATA = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert "ids" in stages[-1].columns


def test_quality_goes_by_the_labels(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert sum(i in kept for i in bad) <= 0.05 * len(bad)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {doc_id for doc_id, _, component in plain(rows, 5, 80) if doc_id == component}
    assert Counter(r.doc_id for r in stages[2].collect()) == Counter(want)


def test_secrets_are_hidden_and_clean_texts_stay(stages):
    patterns = _Patterns()
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    hidden = 0
    for i, r in before.items():
        if base_spans(r.text or "", patterns):
            assert "[secret]" in after[i].text and after[i].n_chars == len(after[i].text)
            hidden += 1
    assert hidden and sum(r != after[i] for i, r in before.items()) <= hidden + 2


def test_near_copies_between_both_thresholds_are_one(spark):
    """Two changed words in a hundred: 0.81 of the five-word shingles, 0.88 of the three-word ones."""
    words = [f"word{i}" for i in range(100)]
    other = list(words)
    other[30], other[60] = "new", "newer"
    rows = [(1, " ".join(words), "en", "a", 1), (2, " ".join(other), "en", "a", 1), (3, "quite another text", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == [1, 3]


def test_mix_is_made_of_taken_words(stages):
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    rows = stages[4].collect()
    sizes, taken = Counter(), Counter()
    for r in stages[3].collect():
        sizes[r.source] += len(words_of(r.text))
    for r in rows:
        mine, all_ = words_of(r.text), iter(words_of(texts[r.doc_id]))
        assert all(w in all_ for w in mine)  # in their order
        taken[r.source] += len(mine)
    assert max(Counter(r.doc_id for r in rows).values()) <= 3
    names = sorted(sizes)
    for name, t in zip(names, plain_targets([sizes[n] for n in names]), strict=True):
        assert taken[name] == pytest.approx(t, rel=0.05)


def test_ids_decode_to_the_texts(stages):
    vocabulary = load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = Counter((r.doc_id, r.text) for r in stages[4].collect())
    got = Counter((r.doc_id, b"".join(vocabulary.tokens[i] for i in r.ids).decode()) for r in stages[5].collect())
    assert got == texts and all(r.round_trip and r.n_tokens == len(r.ids) for r in stages[5].collect())


def test_extra_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns(
        {c: F.lit(1) for c in ("score", "uid", "n", "size", "quality", "spans", "taken", "b", "a.b", "__text", "__uid", "__score", "__hidden", "__row", "x y")}
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
        docs.sparkSession.catalog.clearCache()
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() > 0


def test_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " more", None, None, None), (None, None, None, None, None), (3, "", "en", "a", 0), (None, text, "en", "b", 3)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) >= 2 and all(r.round_trip for r in out)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_registered():
    assert set(registered.QUERIES) | {"pipeline"} <= set(queries())
    assert {n.split("_")[0] for n in registered.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(registered.ORACLES) <= set(oracle_sql())
