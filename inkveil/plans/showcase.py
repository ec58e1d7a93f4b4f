"""Records in which every rule, trigger and redacting keyword fires, with their audit.

Rule 25 cannot: whatever has its shape is taken by an earlier rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import audit
from inkveil.operators.redact import redact
from inkveil.plans import oracle
from inkveil.plans.tables import spread, table
from inkveil.rules import DEFAULT_RULES, REST_OF_LINE

# Six and four digits that differ from row to row; the text is valid in both engines.
_SIX = "lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')"
_FOUR = "lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')"
_SHAPES = [
    f"concat('uid 2345 6789 ', {_FOUR})", f"concat('pan ABCDE', {_FOUR}, 'F')",
    f"concat('travel A1', {_SIX})", f"concat('drives MH12 20110', {_SIX})",
    f"concat('acct 123', {_SIX})", f"concat('bank code SBIN0', {_SIX})",
    f"concat('amex 3782 ', {_SIX}, ' 10005')", "'back CVV 123 of it'",
    f"concat('api_key = k', {_SIX})", f"concat('password: p', {_SIX})",
    f"concat('ssh-rsa AAAA', {_SIX})",
    "concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), 'abc', chr(10), '-----END RSA PRIVATE KEY-----')",
    f"concat('mail u', {_SIX}, '@corp.example.com')", f"concat('x9876', {_SIX})",
    f"concat('040 2', {_SIX})", f"concat('no 123-45-', {_FOUR})", "'at 10.0.0.1 now'",
    "'at 2001:0db8:85a3:0000:0000:8a2e:0370:7334 now'", "'at AA-BB-CC-DD-EE-FF now'",
    f"concat('on corp-dc', {_SIX})", f"concat('https://ex.com/a?x=', {_SIX})",
    "'see ftp.example.org there'", "'pay joe@okaxis there'", "'costs Rs. 4500 each'",
    "'DOB: 01/02/1990'", "'badge EMP12345 seen'", "'123456http://x'",
]
_VALUES = {True: "rack alpha", False: "4,500.25"}
_TRIGGERS = [f"'{r.trigger} {_VALUES[r.target == REST_OF_LINE]}'" for r in DEFAULT_RULES.contexts]
_WORDS = [f"'met {word} today'" for _, word, redacts in DEFAULT_RULES.keyword_rows() if redacts]


def _one_of(choices: list[str]) -> str:
    cases = " ".join(f"WHEN {n} THEN {c}" for n, c in enumerate(choices))
    return f"CASE o_orderkey % {len(choices)} {cases} END"


RECORD = f"concat({_one_of(_TRIGGERS)}, chr(10), {_one_of(_SHAPES)}, chr(10), {_one_of(_WORDS)})"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "orders")).selectExpr("o_orderkey", f"{RECORD} AS text")


def all_rules(spark: SparkSession, sf: str) -> DataFrame:
    return redact(_records(spark, sf), "text").withColumnRenamed("text", "redacted")


def all_rules_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows of trigger phrases, patterns and keywords."""
    done = redact(_records(spark, sf), "text", log=True)
    return audit.audit_log(done, "text_log", "concat('order_', o_orderkey)").drop("timestamp")


def all_rules_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What counts as a redaction of a record: everything but trigger phrases."""
    done = redact(_records(spark, sf), "text", log=True)
    counted = done.selectExpr("o_orderkey", f"bigint({audit.counted('text_log')}) AS n")
    return counted.groupBy("n").agg(F.count("*").alias("records"))


QUERIES = {
    "all_rules": all_rules,
    "all_rules_audit": all_rules_audit,
    "all_rules_summary": all_rules_summary,
}

_SOURCE = f"(SELECT o_orderkey, {RECORD} AS text FROM orders)"
_LOG = oracle.full_log(_SOURCE, "o_orderkey", "text")

ORACLES = {
    "all_rules": f"SELECT o_orderkey, {oracle.cascade('text', True, True)} AS redacted FROM {_SOURCE}",
    "all_rules_audit": f"{_LOG} SELECT 'order_' || o_orderkey AS file_name,"
    f" {oracle.mask(oracle.flat('original'))} AS masked_original, tag AS redacted_to, reason FROM log",
    "all_rules_summary": f"{_LOG} SELECT n, count(*) AS records FROM (SELECT o_orderkey,"
    " count(*) FILTER (WHERE reason NOT LIKE 'Contextual%') AS n FROM log GROUP BY o_orderkey)"
    " GROUP BY n",
}
