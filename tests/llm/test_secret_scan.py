"""Base spans against the patterns as written; the battery on random and structured tokens."""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np

import pytest

from inkveil.llm.secret_scan import (
    ACCESS,
    ASSIGN,
    ENCODINGS,
    HEX,
    LEVELS,
    MOST,
    Cuts,
    _Patterns,
    base_spans,
    candidates,
    encoding_of,
    hide,
    judged,
    learn_cuts,
    scanned,
    secrets_of_documents,
    without_secrets,
)

DATA = "/root/testdata/sf0.01"


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_fuzz():
    draw = random.Random(1)
    parts = ["password", "PassWD", "api_key", "APIKEY", "secret", "token", '"', "'", " ", ":", "=", "  ", "AKIA", "A1B2C3D4E5F6", "abcdef0123456789",
             "0" * 32, "é", "ſecret", "x", "\n", "hunter2hunter2", "a.b=c-d", "toKen"]
    patterns = _Patterns()
    for _ in range(4000):
        text = "".join(draw.choices(parts, k=draw.randrange(14)))
        assert base_spans(text, patterns) == plain(text)


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = secrets_of_documents(spark, str(DATA)).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        base = plain(texts[r.doc_id])
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def tokens(draw, alphabet, length, n):
    return ["".join(draw.choices(alphabet, k=length)) for _ in range(n)]


def test_p_values_of_random_tokens_are_about_uniform():
    draw = random.Random(2)
    for alphabet in ("0123456789abcdef", string.ascii_letters + string.digits):
        ps = [judged(t)[2] for t in tokens(draw, alphabet, 40, 1500) if judged(t)]
        assert abs(np.mean(ps) - 0.5) < 0.08 and 0.02 < np.mean(np.array(ps) < 0.1) < 0.2


def test_structured_tokens_have_small_p():
    for t in ["aaaaaaaaaaaaaaaa1111111111111111", "the_quick_brown_fox_jumps_over_2", "0123456789abcdef0123456789abcdef", "CamelCaseNamesOfClassesInCode2024Edition", "path/to/file-name_2021/index"]:
        assert judged(t)[2] < 0.05


def test_cuts_follow_the_share_of_false_discoveries():
    even = np.full(40, 10.0)
    words, many = even.copy(), even.copy()
    words[:2] += 500
    many[:10] += 500
    got = Cuts({("a", 0): even, ("b", 0): words, ("c", 0): many})
    assert got.of("a", 0) == 0 and got.of("b", 0) == 0.05 and got.of("c", 0) == MOST


def test_thin_classes_are_pooled():
    even = np.full(40, 10.0)
    words = even.copy()
    words[:2] += 500
    one = np.zeros(40)
    one[10] = 1
    got = Cuts({("a", 0): words, ("a", 3): one, ("b", 0): one, ("b", 3): one, ("c", 5): even})
    assert got.of("a", 3) == got.of("a", 0) == got.of("b", 0) == 0.05
    assert got.of("b", 3) == 0.05  # with all
    assert Cuts({("b", 3): one}).of("b", 3) == LEVELS[-1] and Cuts().of("b", 0) == LEVELS[0]


@pytest.mark.parametrize("name", sorted(ENCODINGS))
@pytest.mark.parametrize("length", [22, 30, 36, 48, 80])
def test_a_secret_alone_in_its_class_is_found(name, length):
    """Nearly always: a random token's p-value is even."""
    draw, patterns, limits = random.Random(f"{name}{length}"), _Patterns(), Cuts()
    some = [t for t in tokens(draw, ENCODINGS[name], length, 400) if encoding_of(t) == name and candidates(t, patterns) == [(0, len(t))]]
    found = [t for t in some if judged(t)[2] >= limits.of(*judged(t)[:2])]
    assert len(some) > 20 and len(found) >= 0.85 * len(some)


def test_one_secret_among_names(spark):
    """Two hundred structured tokens, and one random token in each of some classes."""
    draw, patterns = random.Random(9), _Patterns()
    secret = {}
    for name in ("base62", "base64url", "base64any", "base36", "letters"):
        for length in (24, 40, 64):
            some = tokens(draw, ENCODINGS[name], length, 200)
            secret[name, length] = next(t for t in some if encoding_of(t) == name and candidates(t, patterns) == [(0, length)] and judged(t)[2] > 0.15)
    names = [f"path/to/some-module_{i}/version-{i % 7}/index" for i in range(200)] + [f"CustomerAccountManager{i}Factory" for i in range(200)]
    rows = [(i, f"see {n} here") for i, n in enumerate(names)] + [(1000 + i, f"key {t} end") for i, t in enumerate(secret.values())]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: [(s.start, s.end) for s in r.spans] for r in scanned(docs, learn_cuts(docs), ["id"]).collect()}
    assert all(got[1000 + i] == [(4, 4 + len(t))] for i, t in enumerate(secret.values()))
    assert not any(got[i] for i in range(len(names)))


def test_unseen_secrets_are_found_and_names_left(spark):
    draw = random.Random(4)
    secret = [t for t in tokens(draw, string.ascii_letters + string.digits, 40, 60) if re.search("[0-9]", t)]
    names = [f"some_module_name_with_version_{i}" for i in range(60)]
    rows = [(i, f"é see {s} and {n} here", "x") for i, (s, n) in enumerate(zip(secret, names, strict=False))]
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (901, "", "x")], "id long, text string, spans string")
    got = {r.id: r for r in scanned(docs, learn_cuts(docs), ["id"]).collect()}
    found = sum(any(s.kind == "random" and s.start == 6 and s.end == 46 for s in got[i].spans) for i, *_ in rows)
    assert found >= 0.8 * len(rows)
    assert all(s.start == 6 for i, *_ in rows for s in got[i].spans)
    assert got[900].spans == got[901].spans == []
    empty = docs.filter("id < 0")
    assert learn_cuts(empty).own == {} and scanned(empty, Cuts(), ["id"]).count() == 0


def test_long_texts():
    patterns = _Patterns()
    for text in ["a" * 200_000, "token " * 30_000, "token" + " " * 200_000, "AKIA" * 50_000, "0" * 300_000]:
        assert base_spans(text, patterns) == plain(text)


def test_hidden(spark):
    assert hide("ab cd ef", [(0, 0, 2), (1, 2, 4), (6, 1, 8)]) == "[secret]d [secret]"
    docs = spark.createDataFrame([(1, "password=abcdefgh1 x", 20, "en"), (2, "clean", 5, "en"), (3, None, None, None)], "doc_id long, text string, n_chars int, lang string")
    got = sorted(map(tuple, without_secrets(docs).collect()))
    assert got == [(1, "[secret] x", 10, "en"), (2, "clean", 5, "en"), (3, None, None, None)]
