"""The lattice against listing all segmentations; held-out accuracy; odd rows."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from inkveil.llm import langid
from inkveil.llm.langid import Lattice, identified, languages_of_documents, learn, load_pieces, make_pieces
from tests.conftest import DATA


NUMBERS = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4, "c": 5}
BYTES = {b: 6 + b for b in range(256)}


@pytest.fixture(scope="module")
def small():
    return make_pieces({i: n for n, i in NUMBERS.items()}, BYTES, 262)


def segmentations(word):
    if not word:
        yield []
    for end in range(1, min(len(word), 3) + 1):
        if word[:end] in NUMBERS:
            first = [NUMBERS[word[:end]]]
        elif end == 1:
            first = [BYTES[b] for b in word[0].encode()]
        else:
            continue
        yield from (first + rest for rest in segmentations(word[end:]))


@pytest.mark.parametrize("plain", [24, 3])
def test_lattice_equals_listing(small, plain, monkeypatch):
    monkeypatch.setattr(langid, "_PLAIN", plain)
    p = np.random.default_rng(1).dirichlet(np.ones(262), 2).T
    words = ["a", "ab", "aba", "abab", "cabba", "xab", "aéb", "bbab"]
    lattice = Lattice(small, p, "")
    got = lattice.log_probability(words)
    counts = np.array([[1.0, 2.0]] * len(words))
    want_counts = np.zeros((262, 2))
    for w, row in zip(words, got, strict=True):
        ways = list(segmentations(w))
        each = np.array([p[way].prod(0) for way in ways])
        assert np.allclose(row, np.log(each.sum(0)))
        for way, share in zip(ways, each / each.sum(0), strict=True):
            for piece in way:
                want_counts[piece] += share * [1.0, 2.0]
    assert np.allclose(Lattice(small, p, "").expected(words, counts), want_counts)


def test_pieces_are_found():
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    lattice = Lattice(pieces, np.full((pieces.size, 1), 0.1))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for word in ["hello", "größe", "x"]:
        text = "▁" + word
        for length, numbers in enumerate(lattice.edges([word]), 1):
            for at, number in enumerate(numbers[0].tolist()):
                want = model.piece_to_id(text[at : at + length])
                assert number == (want if want != model.unk_id() else -1) or length == 1


def test_long_words_do_not_underflow(small):
    p = np.full((262, 1), 1e-6)
    (value,) = Lattice(small, p, "").log_probability(["c" * 5000])
    assert np.isclose(value[0], 5000 * np.log(1e-6))


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = languages_of_documents(spark, str(DATA)).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    schema = "id long, text string, lang string, score string"
    rows = [(1, "the cat and the dog", "en", ""), (2, "der Hund und die Katze", "de", ""), (3, None, "en", ""), (4, "12 + 3", "de", ""),
            (5, "the dog", None, ""), (5, "the dog", None, ""), (6, "und " * 30_000, None, ""), (7, "x" * 20_000, None, ""), (8, "", None, "")]
    docs = spark.createDataFrame(rows, schema)
    for rounds in (1, 2):
        model = learn(docs, pieces, rounds=rounds)
        got = {r.id: r.lang_pred for r in identified(docs, model, pieces, ["id"]).collect()}
        assert [got[i] for i in (1, 2, 3, 4, 5, 6, 8)] == ["en", "de", "und", "und", "en", "de", "und"]
    nothing = learn(docs.filter("id = 5"), pieces)
    assert {(r.lang_pred, r.score) for r in identified(docs, nothing, pieces, ["id"]).collect()} == {("und", 0.0)}
    assert identified(docs.filter("id < 0"), model, pieces, ["id"]).count() == 0


def test_characters_that_are_no_piece_do_not_underflow(small):
    p = np.full((262, 2), 1e-11)
    for n in (5, 18, 23, 60):
        word = "\U0001d41a" * n
        value = Lattice(small, p, "").log_probability([word, "c" * n])
        assert np.allclose(value[0], 4 * n * np.log(1e-11)) and np.allclose(value[1], n * np.log(1e-11))
        counts = Lattice(small, p, "").expected([word, "c" * n], np.array([[1.0, 2.0], [1.0, 0.0]]))
        assert np.allclose(counts.sum(0), [5 * n, 8 * n]) and np.allclose(counts[NUMBERS["c"]], [n, 0])


def test_odd_letters_in_one_training_text(spark):
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    odd = "\U0001d41a" * 20
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "the dog " + odd, "en"),
            (4, "the dog", None), (5, "die Katze", None), (6, "\U00010480" * 40, None)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    for rounds in (1, 2):
        model = learn(docs.coalesce(1), pieces, rounds=rounds)
        assert np.isfinite(model.probability).all() and np.allclose(model.probability.sum(0), 1)
        got = {r.id: r for r in identified(docs, model, pieces, ["id"]).collect()}
        assert got[4].lang_pred == "en" and got[5].lang_pred == "de"
        assert all(np.isfinite(r.score) and 0 < r.score <= 1 for r in got.values())
