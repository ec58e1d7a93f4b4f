"""The encoder against the tiktoken library, and round trips."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from inkveil.llm.bpe import Encoder, build, decode, digests, encoded, encoding_of_documents, load, merge_all
from tests.conftest import DATA


@pytest.fixture(scope="module")
def vocabulary():
    return load(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_fuzz(vocabulary, library):
    draw = random.Random(3)
    alphabets = ["ab", "the quick ", "aA1 \n\t!", "éàüßñ漢字😀‍́ x", "<|endoftext|> "]
    texts = ["".join(draw.choices(draw.choice(alphabets), k=draw.randrange(60))) for _ in range(1500)]
    encoder = Encoder(vocabulary)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert list(ids) == library.encode_ordinary(text)
        assert decode(ids, vocabulary) == text.encode()


def test_any_bytes(vocabulary, library):
    draw = random.Random(4)
    pieces = [bytes(draw.choices(range(256), k=draw.randrange(1, 40))) for _ in range(500)]
    for piece, ids in zip(pieces, merge_all(pieces, vocabulary), strict=True):
        assert ids == library._encode_single_piece(piece) or piece in vocabulary.tokens


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, " " * 50_000, "thermometer" * 4000, "漢" * 9000])
def test_long_pieces(vocabulary, library, text):
    (ids,) = Encoder(vocabulary).encode([text])
    assert list(ids) == library.encode_ordinary(text)


def test_long_text_in_parts(vocabulary, library, monkeypatch):
    import inkveil.llm.bpe as bpe

    monkeypatch.setattr(bpe, "CHARS_AT_ONCE", 50)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 7)
    monkeypatch.setattr(bpe, "KEPT", 20)
    text = "".join(f" word{i} thing's,\n" for i in range(200))
    encoder = Encoder(vocabulary)
    for ids in encoder.encode([text, "short", text]):
        assert decode(ids, vocabulary) in (text.encode(), b"short")
    assert list(next(encoder.encode([text]))) == library.encode_ordinary(text)


def test_ranks_out_of_order():
    """A vocabulary in which a new pair can rank before the merge that made it."""
    ranks = {bytes([b]): 100 + b for b in range(256)}
    ranks |= {b"ab": 50, b"aba": 3, b"abab": 2, b"ba": 60, b"bab": 1}
    v = build(ranks, r".+")
    own = tiktoken.Encoding("x", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(5)
    pieces = [bytes(draw.choices(b"ab", k=draw.randrange(1, 30))) for _ in range(400)]
    for piece, ids in zip(pieces, merge_all(pieces, v), strict=True):
        assert piece in ranks or ids == own._encode_single_piece(piece)


def test_query(spark, library):
    got = {r.doc_id: r for r in encoding_of_documents(spark, str(DATA)).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_edge_rows(spark, vocabulary):
    schema = "doc_id long, text string, ids string, n_tokens int"
    docs = spark.createDataFrame([(1, None, "x", 1), (1, "", "x", 1), (None, "a b", "x", 1), (2, "a b", None, None)], schema)
    rows = encoded(docs, vocabulary, ["doc_id"]).collect()
    assert [list(r.ids) for r in rows[:2]] == [[], []] and rows[2].ids == rows[3].ids and len(rows) == 4
    assert digests(docs.filter(F.lit(False)), vocabulary, ["doc_id"]).count() == 0
