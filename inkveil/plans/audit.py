"""Queries over the audit trail of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.masking import mask
from inkveil.functions.regex import rule_pattern
from inkveil.functions.text import around_matches
from inkveil.operators import audit
from inkveil.operators.redact import redact
from inkveil.operators.tokens import distinct_words
from inkveil.plans import oracle
from inkveil.plans.tables import documents, table
from inkveil.rules import DEFAULT_RULES

_EMAIL = next(r for r in DEFAULT_RULES.patterns if r.tag == "<email>")


def _logged(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    docs = documents(spark, sf, "text", *columns)
    return redact(docs, "text", phases=("pattern",), log=True)


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.audit_log(_logged(spark, sf), "text_log", "concat('doc_', doc_id)")
    return rows.drop("timestamp")


def redactions_per_document(spark: SparkSession, sf: str) -> DataFrame:
    counted = _logged(spark, sf).selectExpr("doc_id", f"bigint({audit.counted('text_log')}) AS n")
    return counted.where("n > 0")


def first_five_redactions(spark: SparkSession, sf: str) -> DataFrame:
    first = _logged(spark, sf).selectExpr(
        "doc_id", f"posexplode({audit.first_entries('text_log')}) AS (rank, e)"
    )
    return first.selectExpr("doc_id", "bigint(rank + 1) AS rank", "left(e.original, 20) AS preview",
                            "e.tag AS tag")


def pii_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return audit.inventory(_logged(spark, sf, "lang", "source"), "text_log", ["lang", "source"])


def pii_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Only labelled documents are redacted; their tags are counted within the row."""
    labels = table(spark, sf, "labels")
    docs = documents(spark, sf, "text").join(labels, "doc_id")
    logged = redact(docs, "text", phases=("pattern",), log=True)
    tags = F.transform("text_log", lambda e: e["tag"])
    each = F.transform(
        F.array_distinct(tags),
        lambda tag: F.struct(tag.alias("tag"), F.size(F.filter(tags, lambda t: t == tag)).cast("long").alias("n")),
    )
    joined = logged.select("quality", "toxic", F.inline(each))
    return joined.groupBy("tag", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.count("*").alias("documents")
    )


def masked_values(spark: SparkSession, sf: str) -> DataFrame:
    tokens = distinct_words(documents(spark, sf, "text"), "text")
    return tokens.selectExpr("token", f"{mask('token')} AS masked")


def context_window(spark: SparkSession, sf: str) -> DataFrame:
    """Every e-mail address with 50 characters on either side."""
    found = documents(spark, sf, "text").where("contains(text, '@')")
    contexts = around_matches("text", rule_pattern(_EMAIL), least=6)
    return found.selectExpr("doc_id", f"inline({contexts})").withColumnRenamed("match", "email")


QUERIES = {
    "audit_log": audit_log,
    "redactions_per_document": redactions_per_document,
    "first_five_redactions": first_five_redactions,
    "pii_inventory": pii_inventory,
    "pii_by_label": pii_by_label,
    "masked_values": masked_values,
    "context_window": context_window,
}

_LOG = oracle.log("documents", "doc_id", "text")
_LENGTHS = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
_SPOT = f"({_LENGTHS.format('gaps[1:i]')} + {_LENGTHS.format('hits[1:i - 1]')} + 1)"

ORACLES = {
    "audit_log": f"{_LOG} SELECT 'doc_' || doc_id AS file_name,"
    f" {oracle.mask(oracle.flat('original'))} AS masked_original, tag AS redacted_to,"
    " 'Regex' AS reason FROM log",
    "redactions_per_document": f"{_LOG} SELECT doc_id, count(*) AS n FROM log GROUP BY doc_id",
    "first_five_redactions": f"{_LOG} SELECT doc_id, rank, left(original, 20) AS preview, tag"
    " FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, place DESC) AS rank"
    " FROM log) WHERE rank <= 5",
    "pii_inventory": oracle.log("documents", "doc_id", "text", "lang", "source")
    + " SELECT tag, lang, source, CAST(count(*) AS BIGINT) AS n FROM log"
    " GROUP BY CUBE (tag, lang, source) HAVING count(*) > 0",
    "pii_by_label": f"{_LOG} SELECT tag, quality, toxic, CAST(sum(n) AS BIGINT) AS n,"
    " count(*) AS documents FROM (SELECT doc_id, tag, count(*) AS n FROM log GROUP BY doc_id, tag)"
    " JOIN labels USING (doc_id) GROUP BY tag, quality, toxic",
    "masked_values": f"{oracle.tokens()} SELECT token, {oracle.mask('token')} AS masked FROM tokens",
    "context_window": "SELECT doc_id, email, substr(text, CAST(greatest(spot - 50, 1) AS BIGINT),"
    " CAST(spot + length(email) + 50 - greatest(spot - 50, 1) AS BIGINT)) AS context"
    f" FROM (SELECT doc_id, text, hits[i] AS email, {_SPOT} AS spot FROM"
    " (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, text,"
    f" regexp_extract_all(text, {oracle.text(_EMAIL.pattern)}) AS hits,"
    f" regexp_split_to_array(text, {oracle.text(_EMAIL.pattern)}) AS gaps"
    " FROM documents WHERE contains(text, '@'))))",
}
