from __future__ import annotations

import random
from collections import Counter

import pytest

from inkveil.operators.redact import merge_tags, redact
from inkveil.operators.verdict import verdict
from inkveil.functions.masking import mask
from inkveil.operators.audit import masked
from inkveil.rules import DEFAULT_RULES
from tests import twin
from tests.conftest import DATA

# Input and output of the pattern phase.
PATTERN_GOLDENS = {
    "card 4111 1111 1111 1111": "card <aadhaar> 1111",
    "card 4111111111111111": "card <account_no>",
    "amex 3782 822463 10005": "amex <card_number>",
    "+91 9876543210": "+91 <account_no>",
    "+919876543210": "+<aadhaar>",
    "x9876543210": "x<mobile>",
    "040 2345678": "<landline>",
    "ssn 123-45-6789": "ssn <phone>",
    "otp 123456": "otp <phone>",
    "123456http://x": "<code><url>",
    "EMP12345": "<id>",
    "EMP-12345": "<hostname>",
    "EMP123456": "EMP<phone>",
    "joe@okaxis": "<upi_id>",
    "a.b@corp-x.co.in": "<email>",
    "root@corp-dc01": "root@<hostname>",
    "https://ex.com/a?x=1": "<url>",
    "10.0.0.1": "<ipv4>",
    "999.1.1.1": "999.1.1.1",
    "2001:0db8:85a3:0000:0000:8a2e:0370:7334": "<ipv6>",
    "AA-BB-CC-DD-EE-FF": "<mac_address>",
    "well-known fact": "<hostname> fact",
    "2024-01-15": "<hostname>",
    "Rs. 4500": "<amount>",
    "INR 123456789": "INR <account_no>",
    "spin class": "s<password>",
    "compass north": "com<password>",
    "pass <tag>": "pass <tag>",
    "token abc.def": "<api_key>",
    "DOB: 01/02/1990": "<dob>",
    "DOB 1-2-90": "DOB <hostname>",
    "P1234567": "<passport>",
    "ABCDE1234F": "<pan>",
    "SBIN0123456": "<ifsc_code>",
    "MH1220110012345": "<driving_license>",
    "CVV 123": "<cvv>",
    "ssh-rsa AAAAB3Nza": "<ssh_key>",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----": "<private_key>",
    "-----BEGIN RSA PRIVATE KEY-----\na<c\n-----END RSA PRIVATE KEY-----":
        "-----BEGIN RSA PRIVATE KEY-----\na<c\n-----END RSA PRIVATE KEY-----",
}
CONTEXT_GOLDENS = {
    "Resource: alpha beta  \nnext": "Resource: <source>  \nnext",
    "Source:\n  foo bar\nx": "Source:\n  <source>\nx",
    "Page: 12 of 3": "Page: <age> of 3",
    "Age: unknown, 45": "Age: unknown<age> 45",
    "Age: 1,234.567": "Age: <age>7",
    "Source: a <b> c\nSource: d": "Source: a <b> c\nSource: <source>",
}
MASK_GOLDENS = {
    "a": "*", "ab": "**", "abc": "a*c", "abcde": "a***e", "abcdef": "ab...ef",
    "joe@x.com": "j...e@x...com", "ab@x.com": "a...@x...com", "joe@ex.co.in": "j...e@e...in",
    "x@y@z.com": "x@...om",
}


def run(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(8, "i")
    return [r["t"] for r in redact(df, "t", **how).orderBy("i").collect()]


def test_pattern_goldens(spark):
    assert run(spark, PATTERN_GOLDENS, phases=("pattern",)) == list(PATTERN_GOLDENS.values())


def test_context_goldens(spark):
    assert run(spark, CONTEXT_GOLDENS, phases=("context",)) == list(CONTEXT_GOLDENS.values())


def test_merge_golden(spark):
    text = "<a> <a> <a> <b><b><b> <a>\n<a>"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.selectExpr(merge_tags("t")).first()[0] == "<a> <a> <b> <a>"


def test_mask_goldens(spark):
    df = spark.createDataFrame([(k,) for k in MASK_GOLDENS], "t string")
    got = {r[0]: r[1] for r in df.selectExpr("t", mask("t")).collect()}
    assert got == MASK_GOLDENS
    broken = [("ab\n", "**"), ("a\r\nb\n\nc", "a**c"), ("x y", "x*y"), ("", "")]
    broken = [(text, twin.masked(text)) for text, _ in broken]
    df = spark.createDataFrame([(k,) for k, _ in broken], "t string")
    assert [r[0] for r in df.selectExpr(masked("t")).collect()] == [v for _, v in broken]


def test_short_and_missing_texts_stay(spark):
    texts = [None, "", " ", "ab", "  ab ", " a b"]
    assert run(spark, texts) == texts


def test_private_key_order(spark):
    key = "-----BEGIN PRIVATE KEY-----\n123456789 x\n-----END PRIVATE KEY-----"
    assert "PRIVATE" in run(spark, [key], phases=("pattern",))[0]
    first = DEFAULT_RULES.private_keys_first()
    assert run(spark, [key], rules=first, phases=("pattern",)) == ["<private_key>"]


FRAGMENTS = [
    "4111", "1234", "123456", "9876543210", "12", "3", "0", "91", "+91", "-", "--", " ", "  ",
    "\n", ".", ",", ":", "=", "@", "/", "(", ")", "<", ">", "<tag>", "<tag>", "a", "b", "KEY",
    "corp", "db01", "x", "é", "١٢", "²", "é", "का", "_", "password",
    "pass", "pin:", "PIN:", "token", "bearer", "api_key=", "secret", "ssh-rsa", "AAAA=", "CVV",
    "DOB: ", "1/2/90", "EMP", "ID ", "REF", "Rs.", "INR", "₹", "http://", "https://", "ex.com",
    "joe", "okaxis", "10.0.0.1", "AA:BB:CC:DD:EE:FF", "2001:db8:", "Source:", "Age:", "Salary:",
    "Order ID", "OTP:", "Destination:", "Microsoft", "Project", "Titan", "Bank of Baroda",
    "Union Bank", "Axis", "SBI", "John Doe", "sa", "admin", "ſ", "K", "İ", "ı", "\u001c",
    " ", "ABCDE1234F", "SBIN0123456", "P1234567", "-----BEGIN PRIVATE KEY-----",
    "-----END PRIVATE KEY-----", "MH12", "20110012345", "123-45-6789", "paſſ", "toKen",
]


def fuzz(n, seed, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(FRAGMENTS, k=rng.randint(1, longest))) for _ in range(n)]


def differing(spark, texts, **how):
    got = run(spark, texts, **how)
    want = [twin.redact(t, **how) for t in texts]
    return [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]


def test_pattern_phase_equals_twin(spark):
    assert differing(spark, fuzz(6000, seed=1), phases=("pattern",)) == []


def test_full_cascade_equals_twin(spark):
    assert differing(spark, fuzz(6000, seed=2)) == []


def test_custom_whitelist_equals_twin(spark):
    rules = DEFAULT_RULES.with_whitelist(["10.0.0.1", "Ex.com", "x-corp", " joe@okaxis ", ""])
    assert differing(spark, fuzz(3000, seed=3, longest=6), rules=rules) == []


def test_log_equals_twin(spark):
    texts = fuzz(3000, seed=4)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(8, "i")
    for row in redact(df, "t", log=True).collect():
        log = []
        assert row["t"] == twin.redact(texts[row["i"]], log=log)
        assert Counter(tuple(e) for e in row["t_log"]) == Counter(log), texts[row["i"]]


def test_verdict_equals_twin(spark):
    texts = fuzz(3000, seed=5, longest=4) + ["Zx9-kQ2pLm8w", "the", " Data ", "42", "²³", "1234"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    for text, found in df.selectExpr("t", verdict("t")).collect():
        reason = twin.why_sensitive(text)
        assert found["sensitive"] == bool(reason), text
        if reason:
            assert found["reason"] == reason, text


@pytest.mark.parametrize("table,column", [("documents", "text"), ("pages", "html"),
                                          ("conversations", "text")])
def test_whole_texts_equal_twin(spark, table, column):
    df = spark.read.parquet(str(DATA / f"{table}.parquet")).selectExpr(f"{column} AS t", f"{column} AS b")
    for row in redact(df.repartition(8), "t").collect():
        assert row["t"] == twin.redact(row["b"])


def test_masked_originals_never_show_more_than_five(spark):
    df = spark.createDataFrame([(t,) for t in fuzz(500, seed=6, longest=5)], "t string")
    for original, shown in df.selectExpr("t", masked("t")).collect():
        flat = " ".join(original.splitlines())
        assert shown == twin.masked(original)
        assert len(flat) <= 5 or shown != flat or set(flat) == {"."}


def test_filter_on_result_does_not_repeat_the_cascade(spark):
    df = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text", "lang")
    done = redact(df, "text").where("text LIKE '%<%' AND lang = 'en'")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    once = redact(df, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == once.count("regexp_replace")
    scan = done._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in scan


# ------------------------------------------------- any text, in time and stack


def test_names_of_hosts_fuzz(spark):
    draw = random.Random(12)
    parts = ["a", "b1", "com", "org", ".", "..", "-", "--", "_", "@", "1", "x" * 62, "y" * 64, "com-x", "é", " ", ".com", "a.b", "@a.co", "a-b", "%", "+", "1.2"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(1, 18))) for _ in range(4000)]
    got = run(spark, texts, phases=("pattern",))
    for text, out in zip(texts, got, strict=True):
        assert out == twin.pattern_phase(text), text


@pytest.mark.parametrize("labels", [1000, 100_000])
def test_long_names_of_hosts(spark, labels):
    chain = "ab." * labels + "com"
    texts = [chain, "x@" + chain, "see " + chain + " and " + chain, "1." * labels + "x", "ab." * labels + " @", "x@" + "1-a." * labels + "9"]
    got = run(spark, texts, phases=("pattern",))
    assert got[:3] == ["<hostname>", "<email>", "see <hostname> and <hostname>"]
    if labels == 1000:
        assert got == [twin.pattern_phase(t) for t in texts]


def test_blanks_and_triggers_without_end(spark):
    n = 10_000
    begun = "-----BEGIN PRIVATE KEY-----\n"
    texts = [
        "a" + " " * 1_000_000 + "b", " " * 1_000_000, "Age: x " * n, "Age: x " * n + "7", "Salary: none, " + "Order ID x " * n,
        begun * n, begun + "k\n-----END PRIVATE KEY-----\n" + begun * n, "Source: x " * n, "PIN: 1.5 " + "OTP: q " * n,
    ]
    got = run(spark, texts)
    assert got[0] == texts[0] and got[1] == texts[1]
    assert got[2] == texts[2] and got[3].endswith("<age>") and got[3].count("<age>") == 1
    assert got[4].startswith("Salary: none<salary> ") and got[5] == texts[5]
    assert got[6] == "<private_key>\n" + begun * n and got[7] == "Source: <source> "
    assert got[8] == "PIN: <pin>.5 " + "OTP: q " * n


def test_log_of_rules_that_look_at_the_head_only(spark):
    texts = ["Age: 12 and Age: none", "Age: x", "-----BEGIN PRIVATE KEY-----\nk\n-----END PRIVATE KEY----- then -----BEGIN PRIVATE KEY-----"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = redact(df, "t", log=True).orderBy("i").collect()
    assert [[e.original for e in r.t_log] for r in rows] == [["12"], [], ["-----BEGIN PRIVATE KEY-----\nk\n-----END PRIVATE KEY-----"]]
