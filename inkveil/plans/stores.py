"""Queries whose results go through files: saved, saved again, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import audit
from inkveil.operators import reports as R
from inkveil.operators.cells import aligned_lines
from inkveil.operators.redact import redact
from inkveil.operators.span_table import chosen_spans, entity_audit
from inkveil.plans import audit as audit_plans
from inkveil.plans import oracle
from inkveil.plans.lists import ENTITY_TABLE_SQL, overlapping_spans
from inkveil.plans.reporting import _LATEST_SQL, _PARSED_SQL, _reports
from inkveil.plans.tables import documents, table
from inkveil.sources.files import read_table, read_whitelist, write_table
from inkveil.sources.reports import save_reports, stored_reports
from inkveil.sources.shared import shared_folder, written

_AGAIN = "length(source_file_name) % 2 = 0"


def reports_saved_twice(spark: SparkSession, sf: str) -> DataFrame:
    """All reports, then some again with another summary: those stand, the others stay."""
    path = f"{shared_folder(spark)}/reports"
    reports = _reports(spark, sf)
    again = reports.where(_AGAIN).withColumn("document_summary", F.expr("'Again: ' || document_summary"))
    save_reports(reports, path)
    for _ in range(2):
        save_reports(again, path)
    done = R.consolidated(stored_reports(spark, path))
    return done.withColumn("Key Security Findings", F.array_join("Key Security Findings", "\n"))


def audit_appended_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Some batches, then all of them, then all again: every entry is there once."""
    path = f"{shared_folder(spark)}/audit"
    docs = documents(spark, sf, "text").withColumn("before", F.col("text"))
    done = redact(docs, "text", phases=("pattern",), log=True)
    rows = written(audit.audit_entries(done, "text_log", "concat('doc_', doc_id)", "before"), "batch")
    audit.append_audit_once(rows.where("file_name LIKE '%3'"), path)
    for _ in range(2):
        audit.append_audit_once(rows, path)
    return audit.audit_table(spark, path).drop("timestamp")


def aligned(name: str, order: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return aligned_lines(table(spark, sf, name), [order])

    return query


def csv_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as CSV, line breaks, quotes and all."""
    path = f"{shared_folder(spark)}/csv"
    write_table(table(spark, sf, "conversations"), path)
    return read_table(spark, path, multi_line=True)


def whitelist_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's words as lines of a whitelist file, with blanks and capitals."""
    path = f"{shared_folder(spark)}/whitelist"
    words = table(spark, sf, "benchmark").selectExpr("explode(split(text, '[ \\n]+')) AS word")
    words.selectExpr("concat('  ', word, if(word = '', '', ' \t')) AS value").write.text(path)
    return read_whitelist(spark, path)


def entity_table_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows of the spans of ``entity_table_redaction``, by tag and reason."""
    texts = redact(documents(spark, sf, "text"), "text", phases=("pattern",))
    entries = entity_audit(chosen_spans(texts, "doc_id", "text", overlapping_spans(texts)))
    masked = audit.masked("entry.original")
    rows = entries.selectExpr("entry.tag AS redacted_to", "entry.reason AS reason", f"{masked} AS masked_original")
    return rows.groupBy("redacted_to", "reason").agg(F.count("*").alias("n"), F.min("masked_original").alias("first_masked"))


_ALIGNED = {
    "aligned_orders": ("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "aligned_supplier": ("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
}

QUERIES = {
    "reports_saved_twice": reports_saved_twice,
    "audit_appended_twice": audit_appended_twice,
    **{q: aligned(name, order) for q, (name, order, _) in _ALIGNED.items()},
    "csv_read_back": csv_read_back,
    "whitelist_read_back": whitelist_read_back,
    "entity_table_audit": entity_table_audit,
}


def _aligned_sql(name: str, order: str, columns: list[str]) -> str:
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NaN') AS {c}" for c in columns)
    widths = ", ".join(f"greatest(max(length({c})) + 1, {len(c)}) AS w_{c}" for c in columns)
    header = " || ".join(f"' ' || lpad('{c}', w_{c}::INTEGER, ' ')" for c in columns)
    body = " || ".join(f"' ' || lpad({c}, w_{c}::INTEGER, ' ')" for c in columns)
    return (
        f"WITH c AS (SELECT row_number() OVER (ORDER BY {order}) AS number, {cells} FROM (SELECT * FROM {name}) t),"
        f" w AS (SELECT length((count(*) - 1)::VARCHAR)::INTEGER AS w, {widths} FROM c)"
        f" SELECT 0::BIGINT AS number, repeat(' ', w) || {header} AS line FROM w"
        f" UNION ALL SELECT number::BIGINT, rpad((number - 1)::VARCHAR, w, ' ') || {body} FROM c, w"
    )


_LATEST = _LATEST_SQL[len(_PARSED_SQL) :]
_SECOND = _LATEST.replace("latest AS", "second AS").replace(
    "FROM parsed WHERE",
    f"FROM (SELECT * REPLACE ('Again: ' || document_summary AS document_summary) FROM parsed WHERE {_AGAIN}) WHERE",
)

ORACLES = {
    "reports_saved_twice": f"{_LATEST_SQL}{_SECOND}, whole AS (SELECT * FROM second UNION ALL"
    " SELECT * FROM latest WHERE report_file NOT IN (SELECT report_file FROM second))"
    " SELECT source_file_name AS \"File Name\", source_file_type AS \"File Type\","
    " document_summary AS \"File Description\", replace(findings, '|', chr(10)) AS \"Key Security Findings\" FROM whole",
    "audit_appended_twice": audit_plans.ORACLES["audit_log"],
    **{q: _aligned_sql(*how) for q, how in _ALIGNED.items()},
    "csv_read_back": "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations",
    "whitelist_read_back": f"SELECT DISTINCT lower({oracle.strip('word')}) AS word FROM"
    f" (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS word FROM benchmark) WHERE {oracle.strip('word')} <> ''",
    "entity_table_audit": f"{ENTITY_TABLE_SQL} SELECT k.tag AS redacted_to, 'NER: ' || k.label AS reason, count(*) AS n,"
    f" min({oracle.mask(oracle.flat('k.text'))}) AS first_masked FROM (SELECT unnest(kept) AS k FROM c) GROUP BY ALL",
}
