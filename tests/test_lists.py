"""Rules, keywords, whitelists and spans as tables, and long texts in pieces."""

from __future__ import annotations

import random

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkveil.operators.containment import contained
from inkveil.operators.entities import redact_entities
from inkveil.operators.listed import redact_with_whitelist
from inkveil.operators.pieces import cut_text, redact_in_pieces
from inkveil.operators.redact import redact
from inkveil.operators.rule_table import MOST_WITHOUT_LITERAL, first_rules, keyword_table_hits, redact_keyword_table, required_literal, rule_hits
from inkveil.operators.span_table import chosen_spans, chosen_tags, entity_audit, put_in, redact_entity_table
from inkveil.plans import lists
from inkveil.plans.redaction import spans_of, tagged
from inkveil.rules import DEFAULT_RULES, RuleSet
from inkveil.rules.patterns import PatternRule
from tests.test_redact import FRAGMENTS, fuzz

LETTERS = "abcdE é😀ßİ"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------- containment


def strings(rng, n, longest, letters=LETTERS):
    return ["".join(rng.choices(letters, k=rng.randrange(longest))) for _ in range(n)]


def test_contained_equals_trying_all(spark):
    rng = random.Random(1)
    texts, needles = [*strings(rng, 300, 9), None, "", "abc" * 400], [*strings(rng, 150, 5), None, "", "never there"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, w string")
    listed = spark.createDataFrame([(n,) for n in needles], "k string")
    want = {(i, n) for i, w in enumerate(texts) for n in needles if w is not None and n and n in w}
    got = [(r.id, r.k) for r in contained(df, ["id"], "w", listed, "k").collect()]
    assert len(got) == len(want) and set(got) == want
    by_text = contained(df.select("w").distinct(), ["w"], "w", listed, "k")
    assert {tuple(r) for r in by_text.collect()} == {(texts[i], n) for i, n in want}
    assert contained(df, ["id"], "w", listed.limit(0), "k").collect() == []
    assert contained(df.limit(0), ["id"], "w", listed, "k").collect() == []


def test_contained_with_grams_that_all_texts_hold(spark):
    """Every needle's grams are in every text, so all entries of the index are hot."""
    texts = [f"aaab{i}" for i in range(2000)]
    needles = ["aaa", "aab", "aaab", *(f"aab{i}" for i in range(30))]
    df = spark.createDataFrame([(t,) for t in texts], "w string")
    got = contained(df, ["w"], "w", spark.createDataFrame([(n,) for n in needles], "k string"), "k")
    assert Counter(r.k for r in got.collect()) == {n: sum(n in t for t in texts) for n in needles}


def test_no_pairs_are_tried(spark):
    words = spark.range(1000).selectExpr("string(id) AS w")
    found = plan(contained(words, ["w"], "w", words.withColumnRenamed("w", "k"), "k"))
    assert "NestedLoop" not in found and "Cartesian" not in found


def test_keyword_table(spark):
    tokens = spark.createDataFrame([("Zebra",), ("xHDFCx",), ("STRASSE",), ("", ), ("b",)], "token string")
    words = spark.createDataFrame([("bank", "hdfc"), ("bank", "HDFC"), ("animal", "ebr"), ("letter", "B"), ("none", "")], "category string, keyword string")
    got = {tuple(r) for r in keyword_table_hits(tokens, words).collect()}
    assert got == {("xHDFCx", "bank", "hdfc"), ("xHDFCx", "bank", "HDFC"), ("Zebra", "animal", "ebr"), ("Zebra", "letter", "B"), ("b", "letter", "B")}


def test_keyword_table_equals_the_keyword_phase(spark):
    """Keywords that are words, phrases, parts of tags, and signs beside words."""
    words = {"banks": ("SBI", "Axis Bank", "bank", "C++", ".net", "é", "kſ"), "locations": ("location", "sa", "corp-db01", "x"), "projects": ("Project Titan", "a<b")}
    rules = RuleSet(keywords=words, redacted_categories=tuple(words))
    rng = random.Random(51)
    pool = ["SBI", "sbi", "Axis  Bank", "axis bank", "asp.net", ".NET", "C++", "c+", "bank", "banks", "É", "é", "KS", "kſ", "location", "sa", "sap", "x", "corp-db01", "project titan", "a<b", "-", ".", " ", " ", "\n"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 10))) + " end" for _ in range(400)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    keywords = spark.createDataFrame([(n, w, f"<{c[:-1]}>") for n, (c, w, _) in enumerate(rules.keyword_rows())], "ord int, keyword string, tag string")
    got = {r.i: r.t for r in redact_keyword_table(df, "i", "t", keywords).collect()}
    want = {r.i: r.t for r in redact(df, "t", rules, phases=("keyword",)).collect()}
    assert [(texts[i], got[i], t) for i, t in want.items() if got[i] != t] == []
    assert sum(texts[i] != t for i, t in want.items()) > 100


# ------------------------------------------------------------------- rules

LITERALS = {
    "abc+d": "abc", "ab?cde": "cde", "(?i)xyK[a-z]+foo": "xyk", "(?iu)xyK[a-z]+foo": "foo", "a|b": None,
    r"\bfoo\.bar\b": "foo.bar", "(foo|bar)baz{2}q": "baz", "(?:x(y[)])z)tail": "tail", r"\p{Lu}{2,}-id": "-id",
    "[]a]bc": "bc", "[^]a]bcd": "bcd", r"\x{41}bc": "bc", r"\Qa\E": None, "x{0,3}yy": "yy", ".*": None, "": None,
    "(?x)a b": None, "[a[bc]d]ef": "ef", "a*+bc?+d": "b", "(?<!x)yz(?=w)": "yz", "é+abc": "abc", "a{2}b": "a",
}


@pytest.mark.parametrize("pattern", LITERALS)
def test_required_literals(pattern):
    assert required_literal(pattern) == LITERALS[pattern]


def test_literals_of_the_built_in_rules_are_required(spark):
    from inkveil.functions.regex import rule_pattern

    rules = [(r.ord, r.tag, rule_pattern(r)) for r in DEFAULT_RULES.patterns]
    texts = fuzz(1500, seed=21, longest=6)
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    table = spark.createDataFrame(rules, "ord int, tag string, pattern string")
    want = df.distinct().crossJoin(table).where("t RLIKE pattern").select("t", "ord", "tag")
    assert sorted(map(tuple, rule_hits(df, "t", table).collect())) == sorted(map(tuple, want.collect()))


def test_rules_equal_trying_all(spark):
    rng = random.Random(5)
    atoms = ["a", "b", "cd", "E", "é", r"\d", "[a-c]", ".", "(ab|c)", r"\.", "(?:d)", "x", "[^a]"]
    patterns = list({"".join(rng.choice(atoms) + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"]) for _ in range(rng.randrange(1, 6))) for _ in range(250)})
    patterns = [p if n % 5 else "(?i)" + p for n, p in enumerate(patterns)] + ["a|b", "^$", "zz"]
    texts = strings(rng, 400, 9, "abcdeABCDEé12.x")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rules = spark.createDataFrame([(i, f"<{i}>", p) for i, p in enumerate(patterns)], "ord long, tag string, pattern string")
    want = df.distinct().crossJoin(rules).where("t RLIKE pattern").groupBy("t").agg(F.min("ord"))
    got = first_rules(df, "t", rules)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert sorted((r.text, r.ord) for r in got.collect()) == sorted(map(tuple, want.collect()))


def test_too_many_rules_without_literals(spark):
    rules = spark.range(MOST_WITHOUT_LITERAL + 1).selectExpr("id AS ord", "'x' AS tag", "'.' AS pattern")
    with pytest.raises(ValueError, match="no characters"):
        rule_hits(spark.createDataFrame([("a",)], "t string"), "t", rules)


# --------------------------------------------------------------- whitelist

WORDS = ["10.0.0.1", "Ex.com", "x-corp", " joe@okaxis ", "", "4111", "9876543210", "corp-", "pass 12", "http://ex.com", "91", "corp-x"]


def test_whitelist_table_equals_literals(spark):
    texts = fuzz(1500, seed=3, longest=6)
    df = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "i long, t string, other int").repartition(8, "i")
    listed = spark.createDataFrame([(w,) for w in WORDS * 3], "word string")
    got = redact_with_whitelist(df, "i", "t", listed, log=True)
    want = redact(df, "t", DEFAULT_RULES.with_whitelist(WORDS), log=True)
    assert got.columns == want.columns
    got, want = ({r.i: r for r in x.collect()} for x in (got, want))
    assert got == want
    plain = {r.i: r.t for r in redact(df, "t").collect()}
    assert sum(plain[i] != r.t for i, r in want.items()) > 50


def test_a_spared_match_uncovers_others(spark):
    """Each round spares one more: a host inside an address inside a link."""
    df = spark.createDataFrame([(1, "see https://a.bc/d1-x now"), (2, "nothing"), (3, None)], "i long, t string")
    for words in (["https://a.bc/d1-x", "d1-x"], ["https://a.bc/d1-x", "d1-x", "a.bc"]):
        listed = spark.createDataFrame([(w,) for w in words], "word string")
        got = {r.i: r.t for r in redact_with_whitelist(df, "i", "t", listed).collect()}
        want = {r.i: r.t for r in redact(df, "t", DEFAULT_RULES.with_whitelist(words)).collect()}
        assert got == want


# ------------------------------------------------------------------ pieces

PROSE = "the quick brown fox jumps over the lazy dog and runs along quiet rivers towards distant hills где растут травы".split()
# What rules read over blanks, and what stands next to places that look safe.
ACROSS = ["pass", "shipping", "token", "api", "key", "my password", "date of birth", "dob", "of", "ssh-rsa", "axis", "bank", "bank of baroda", "project titan",
          "-----BEGIN PRIVATE KEY----- some words of a key here to be read", "-----END PRIVATE KEY-----", "hdfc", "sbi", "john doe", "Salary", "Source: a b c\nd", "pin", "secret"]


def prose(n, seed, longest=60):
    rng = random.Random(seed)
    pool = PROSE * 6 + ACROSS * 2 + FRAGMENTS
    return [" ".join(rng.choices(pool, k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("rules", [DEFAULT_RULES, DEFAULT_RULES.private_keys_first(), DEFAULT_RULES.with_whitelist(WORDS)])
def test_pieces_equal_whole_texts(spark, rules):
    texts = [*prose(700, seed=31), None, "", "ab"]
    df = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "i long, t string, other string").repartition(8, "i")
    pieces = df.selectExpr(f"size({cut_text('t', rules, 40)}) AS n").agg(F.sum("n")).first()[0]
    assert pieces > 2 * len(texts)
    got = {r.i: r for r in redact_in_pieces(df, "t", rules, log=True, piece=40).collect()}
    want = {r.i: r for r in redact(df, "t", rules, log=True).collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i].t == row.t and got[i].other == row.other, texts[i]
        assert got[i].t_log == row.t_log, texts[i]


def test_cuts_lose_nothing(spark):
    texts = prose(500, seed=32) + ["a" * 500, " " * 500, "x y " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(f"array_join({cut_text('t', piece=20)}, '') <> t").count() == 0


def test_one_long_text(spark):
    """Many pieces of about equal size in many tasks, and the same result."""
    text = "\n".join(prose(5000, seed=33, longest=30)).replace("-----BEGIN", "--BEGIN").replace("Salary", "Salary 5")
    df = spark.createDataFrame([(1, text), (2, "mail me@site.org")], "i long, t string")
    sizes = [r[0] for r in df.selectExpr(f"explode(transform({cut_text('t', piece=20_000)}, p -> char_length(p)))").collect()]
    assert len(sizes) > 15 and max(sizes) < 24_000
    got = {r.i: r.t for r in redact_in_pieces(df, "t", piece=20_000).collect()}
    assert got == {r.i: r.t for r in redact(df, "t").collect()}


def test_pieces_of_other_rules_are_refused(spark):
    rules = RuleSet(patterns=(PatternRule(1, "<x>", "fox jumps"),))
    with pytest.raises(ValueError, match="reach over"):
        redact_in_pieces(spark.createDataFrame([(1, "a")], "i int, t string"), "t", rules)


# ------------------------------------------------------------------- spans

LABELS = ["PERSON", "ORG", "GPE", "DATE", "CARDINAL", "MONEY", "OTHER"]


def spans_for(rng, texts, most):
    out = []
    for i, text in texts:
        for _ in range(rng.randrange(most) if text else 0):
            start = rng.randrange(-1, len(text) + 1)
            end = start + rng.randrange(-1, 2 + rng.choice([3, 10, len(text)]))
            out.append((i, start, end, rng.choice(LABELS), text[max(start, 0) : max(end, 0)]))
    return out


@pytest.mark.parametrize("stretch", [7, 64, 1 << 16])
def test_span_table_equals_arrays(spark, stretch):
    rng = random.Random(41)
    alphabet = "ab <é😀\n"
    texts = [(i, "".join(rng.choices(alphabet, k=rng.randrange(400)))) for i in range(150)] + [(900, None), (901, "")]
    spans = spans_for(rng, texts, 60)
    df = spark.createDataFrame([(i, t, i) for i, t in texts], "doc_id long, t string, other long")
    table = spark.createDataFrame(spans, "doc_id long, start_char int, end_char int, label string, text string").repartition(5)
    chosen = chosen_spans(df, "doc_id", "t", table, stretch=stretch).cache()
    got = {r.doc_id: r for r in put_in(df, "doc_id", "t", chosen, chunk=16).collect()}
    whole = redact_entities(df, "doc_id", "t", table, log=True).collect()
    assert {i: r.t for i, r in got.items()} == {r.doc_id: r.t for r in whole}
    assert all(r.other == i for i, r in got.items())
    audit = Counter((r.key, r.entry.tag, r.entry.original, r.entry.reason) for r in entity_audit(chosen).collect())
    assert audit == Counter((r.doc_id, e.tag, e.original, e.reason) for r in whole for e in r.entity_log)
    assert len(chosen.collect()) > 100


@pytest.mark.parametrize("stretch", [7, 1 << 16])
def test_chosen_tags_equal_chosen_spans(spark, stretch):
    """Without label and text the same spans stand, whatever the key is and wherever batches end."""
    rng = random.Random(43)
    texts = [(f"k{i}", "ab <é😀" * rng.randrange(1, 60)) for i in range(60)]
    spans = spans_for(rng, texts, 90)
    spans += [(i, s, e, label, t) for i, s, e, _, t in spans[::3] for label in ("ORG", "GPE", "PERSON")] + [(None, 0, 4, "ORG", "some")]
    for kind, of in (("string", str), ("struct<a:string,b:string>", lambda k: (k, "x"))):
        df = spark.createDataFrame([(of(i), t) for i, t in texts], f"k {kind}, t string")
        table = spark.createDataFrame([(i and of(i), *r) for i, *r in spans], f"k {kind}, start_char int, end_char int, label string, text string")
        held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            whole = chosen_spans(df, "k", "t", table, stretch=stretch).collect()
            narrow = chosen_tags(df, "k", "t", table, stretch=stretch).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
        assert len(whole) > 300 and Counter(map(tuple, narrow)) == Counter((r.key, r.start_char, r.end_char, r.tag) for r in whole)


def test_spans_are_put_in_beside_short_texts_and_by_chunk(spark):
    """Texts up to some length take their spans in one row, longer ones and those of one key by chunk."""
    rng = random.Random(53)
    texts = [(i, "".join(rng.choices("ab <é😀\n", k=rng.randrange(3000 if i % 9 == 0 else 300)))) for i in range(80)] + [(900, None), (901, ""), (902, "abc"), (None, "abc")]
    df = spark.createDataFrame([(i, t, i) for i, t in texts], "key long, t string, other long")
    table = spark.createDataFrame(spans_for(rng, texts[:80], 90), "key long, start_char int, end_char int, label string, text string")
    want = {r.key: (r.t, r.other) for r in redact_entities(df, "key", "t", table).collect()}
    chosen = chosen_tags(df, "key", "t", table).localCheckpoint()
    for row_chars in (0, 200, 1 << 16):
        got = put_in(df, "key", "t", chosen, chunk=16, row_chars=row_chars)
        assert got.columns == df.columns and {r.key: (r.t, r.other) for r in got.collect()} == want
    short = plan(put_in(df, "key", "t", chosen))
    assert "posexplode" not in short and short.split("Initial Plan")[0].count("SortMergeJoin") == 1
    twice = put_in(df.unionByName(df.where("key = 3")), "key", "t", chosen).collect()
    assert len(twice) == len(texts) + 1 and {r.key: (r.t, r.other) for r in twice if r.key != 3} == {k: v for k, v in want.items() if k != 3}


def test_made_up_spans_as_rows_equal_arrays(spark):
    rng = random.Random(47)
    texts = [(i, "".join(rng.choices("ab é😀\n", k=rng.choice([0, 1, 30, 90, 1023, 1024, 1025, 1100, 5000])))) for i in range(90)]
    df = spark.createDataFrame([*texts, (None, "x" * 99), (900, None)], "doc_id long, text string")
    got, want = spans_of(df), tagged(df).selectExpr("doc_id", "inline(spans)")
    assert got.schema == want.schema
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    both = spans_of(df).unionByName(spans_of(df).selectExpr(*lists._WIDE.split(", ")))
    assert Counter(map(tuple, lists.overlapping_spans(df).collect())) == Counter(map(tuple, both.collect()))


def test_texts_under_a_span_table_are_redacted_once(spark):
    done = lists.entity_table_redaction(spark, "/root/testdata/sf0.001")
    assert "redacted" in done.columns and "regexp_replace" not in plan(done) and "RLIKE" not in plan(done)


def test_very_many_spans_of_one_text(spark):
    """Overlapping chains over all stretches, which many tasks share."""
    n = 400_000
    df = spark.createDataFrame([(1, "abcdefghij " * (n // 4))], "doc_id long, t string")
    spans = spark.range(n).selectExpr(
        "1L AS doc_id", "int(id * 2) AS start_char", "int(id * 2 + 3 + id % 5) AS end_char", "'ORG' AS label", "'x' AS text"
    )
    chosen = chosen_spans(df, "doc_id", "t", spans).cache()
    starts = [r[0] for r in chosen.select("start_char").orderBy("start_char").collect()]
    at, want = 0, []
    for i in range(n):
        if i * 2 >= at:
            want.append(i * 2)
            at = i * 2 + 3 + i % 5
    assert starts == want
    assert chosen.groupBy(F.spark_partition_id()).count().count() >= 4
    done = put_in(df, "doc_id", "t", chosen).first().t
    assert done.count("<organization>") == len(want)


def test_spans_of_nobody(spark):
    df = spark.createDataFrame([("a", "some text")], "doc_id string, t string")
    none = spark.createDataFrame([], "doc_id string, start_char int, end_char int, label string, text string")
    assert redact_entity_table(df, "doc_id", "t", none).collect() == df.collect()
    other = spark.createDataFrame([("b", 0, 4, "ORG", "some")], none.schema)
    assert redact_entity_table(df, "doc_id", "t", other).collect() == df.collect()




# ------------------------------------------------- needles told to the tasks


def test_few_needles_meet_texts_without_a_shuffle(spark, monkeypatch):
    from inkveil.operators import containment

    rng = random.Random(8)
    texts = [*strings(rng, 300, 12, "abé😀 ßΣ"), None, "", "ab"]
    needles = [*strings(rng, 60, 4, "abé😀 ßΣ"), None, "", "a", "ab", "zz"]
    df = spark.createDataFrame([(i % 250, t) for i, t in enumerate(texts)], "`a.b` long, t string").repartition(5)
    listed = spark.createDataFrame([(n,) for n in needles], "n string")
    want = sorted({(i % 250, t, n) for i, t in enumerate(texts) for n in needles if t and n and n in t})

    got = containment.contained(df.distinct().localCheckpoint(), ["a.b", "t"], "t", listed, "n")
    assert "Exchange" not in plan(got) and "Join" not in plan(got)
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(containment, "MOST_LISTED", 3)
    monkeypatch.setattr(containment, "MOST_COUNTED", 2)
    longer = containment.contained(df.distinct(), ["a.b", "t"], "t", listed, "n")
    assert "Join" in plan(longer)
    assert sorted(map(tuple, longer.collect())) == want


def test_words_are_told_once(spark):
    """The different texts are worked out once, however many rules meet them."""
    df = spark.createDataFrame([("ab",), ("ab",), ("x1",)], "t string")
    rules = spark.createDataFrame([(1, "<1>", "ab"), (2, "<2>", "[0-9]")], "ord long, tag string, pattern string")
    hits = rule_hits(df, "t", rules)
    assert "FileScan" in plan(hits) or "Scan parquet" in plan(hits)
    assert sorted(map(tuple, hits.collect())) == [("ab", 1, "<1>"), ("x1", 2, "<2>")]


def test_folded_letters(spark):
    from inkveil.operators.rule_table import _folded

    letters = "".join(map(chr, (0x130, 0x131, 0x17F, 0xB5, 0x3BC, 0x3A3, 0x3C2, 0x3C3, 0x212A))) + "aZ ß"
    texts = ["plain Text", "ΟΔΟΣ", "", *strings(random.Random(4), 300, 6, letters)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    always = "translate(lower(translate(t, '\u0130', 'i')), '\u017f\u0131\u03c2\u00b5', 'si\u03c3\u03bc')"
    assert df.where(f"NOT {_folded('t')} <=> {always}").count() == 0
