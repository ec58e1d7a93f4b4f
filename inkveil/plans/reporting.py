"""Queries over files, prompts, responses and reports.

The files are made from the tables: every document is taken as the text of a
file, named after its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import reports as R
from inkveil.operators.cells import lines_to_text, rows_to_lines, workbook_lines
from inkveil.operators.redact import redact
from inkveil.plans import oracle
from inkveil.plans.tables import documents, table
from inkveil.rules import reports as texts
from inkveil.rules.files import CLEANSERS, FILE_LABELS, IMAGE_SUFFIXES, UNKNOWN_LABEL
from inkveil.rules.reports import PromptTemplates
from inkveil.sources.files import route, stem

_SUFFIXES = [*FILE_LABELS, ".PDF", ".Docx", ".exe", ""]
_ARRAY = ", ".join(f"'{s}'" for s in _SUFFIXES)
# The same text is valid in both engines but for the first index.
_NAME = "concat(source, '_', doc_id % 300, element_at(array({array}), int(doc_id % {n}) + 1))".format(
    array=_ARRAY, n=len(_SUFFIXES)
)
_NAME_SQL = f"concat(source, '_', doc_id % 300, [{_ARRAY}][doc_id % {len(_SUFFIXES)} + 1])"
_TIME = (
    "concat('2025-09-28 ', lpad({s}(doc_id % 24), 2, '0'), ':',"
    " lpad({s}(doc_id % 60), 2, '0'), ':00')"
)
_TIME_SPARK = _TIME.format(s="string")
_TIME_SQL = _TIME.replace("{s}(doc_id % 24)", "CAST(doc_id % 24 AS VARCHAR)").replace(
    "{s}(doc_id % 60)", "CAST(doc_id % 60 AS VARCHAR)"
)
# Some files are blank, or hold the marker of a blank one.
_TEXT = (
    f"CASE doc_id % 10 WHEN 3 THEN '  ' WHEN 6 THEN '{texts.NO_TEXT}' WHEN 8 THEN null"
    " ELSE text END"
)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "text", "lang", "source", "n_chars")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return route(docs.selectExpr("doc_id", f"{_NAME} AS file_name", f"{_TEXT} AS text"))


def file_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each kind and whether they are cleansed; the others are skipped."""
    return _files(spark, sf).groupBy("suffix", "file_type", "cleanser", "is_image").agg(
        F.count("*").alias("n")
    )


def units_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a file of lines."""
    turns = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "concat(role, ': ', text) AS line"
    )
    return lines_to_text(turns, "conv_id", "turn", "line")


def redacted_units(spark: SparkSession, sf: str) -> DataFrame:
    """The same with every line redacted by itself before they are joined."""
    turns = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "concat(role, ': ', text) AS line"
    )
    return lines_to_text(redact(turns, "line"), "conv_id", "turn", "line")


def sheets_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """Forty conversations each as the sheets of one workbook, rows numbered with gaps."""
    rows = table(spark, sf, "conversations").selectExpr(
        "conv_id DIV 40 AS file", "conv_id % 40 AS sheet_number",
        "concat('conv ', conv_id) AS sheet", "turn * 3 + 1 AS turn",
        "concat(role, chr(9), text) AS line",
    )
    lines = workbook_lines(rows, "file", "sheet_number", "sheet", "turn", "line")
    return lines_to_text(lines, "file", "number", "line")


def table_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a line of tab-separated cells."""
    return rows_to_lines(table(spark, sf, "orders"), ["o_orderkey"])


def empty_gate(spark: SparkSession, sf: str) -> DataFrame:
    blank = _files(spark, sf).where(R.is_blank("text", "is_image"))
    made = blank.selectExpr("doc_id", f"{R.blank_report('file_name', 'file_type')} AS report")
    return made.selectExpr(
        "doc_id", "report.document_summary", "report.key_security_findings[0] AS finding",
        "report.source_file_name", "report.source_file_type",
    )


def build_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return R.build_prompts(_files(spark, sf)).drop("is_image")


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up model responses: complete, partial, drifting, prose and broken ones."""
    start = "text"
    whole = (
        f"to_json(named_struct('document_summary', {start}, 'key_security_findings',"
        " array(lang, source), 'people_count', n_chars, 'redacted_content_noted', n_chars > 999,"
        " 'compliance_frameworks_referenced', array()))"
    )
    partial = "to_json(named_struct('environment_type', lang, 'people_count', concat(n_chars, ' of')))"
    drifting = (
        f"to_json(named_struct('key_security_findings', source, 'document_summary', {start},"
        " 'extra', array(1, 2)))"
    )
    # A key twice, of which the last counts, and a number JSON does not have.
    repeated = (
        "concat('{\"document_summary\": \"first\", \"people_count\": NaN, ',"
        f" substring({drifting}, 2))"
    )
    response = (
        f"CASE doc_id % 7 WHEN 0 THEN concat('Here it is:\\n```json\\n', {whole}, '\\n```')"
        f" WHEN 1 THEN {partial} WHEN 2 THEN if(doc_id % 2 = 1, {repeated}, {drifting})"
        " WHEN 3 THEN concat('  Only prose. ', translate(text, '{}', ''))"
        " WHEN 4 THEN concat('{\"document_summary\": ', lang, '}', doc_id)"
        " WHEN 5 THEN '' ELSE null END"
    )
    error = (
        "CASE WHEN doc_id % 7 <> 6 THEN null WHEN doc_id % 3 = 0 THEN 'HTTP 429 from server'"
        " WHEN doc_id % 3 = 1 THEN 'Bad API KEY given' ELSE concat('timeout after ', n_chars) END"
    )
    docs = _documents(spark, sf).selectExpr(
        "doc_id", f"{_NAME} AS file_name", "'model' AS model_used",
        f"{_TIME_SPARK} AS analysis_timestamp", f"{response} AS response", f"{error} AS error",
    )
    return route(docs).drop("suffix", "cleanser", "is_image")


_REPORT_COLUMNS = [
    "branch", "source_file_name", "source_file_type", "document_summary",
    "concat_ws('|', key_security_findings) AS findings", "environment_type", "people_count",
    "redacted_content_noted", "size(compliance_frameworks_referenced) AS frameworks",
    "model_used", "analysis_timestamp", "bigint(char_length(raw_analysis)) AS raw_analysis_length",
    "raw_response", "error", "other_fields",
]


def parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    return R.parse_responses(_responses(spark, sf)).selectExpr(*_REPORT_COLUMNS)


def classify_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that failed, by what to do about them."""
    messages = table(spark, sf, "events").selectExpr(
        "event_type",
        "CASE user_id % 6 WHEN 0 THEN concat('status ', 400 + event_id % 40)"
        " WHEN 1 THEN 'Quota exceeded' WHEN 2 THEN 'over the Rate Limit'"
        " WHEN 3 THEN 'missing API key' WHEN 4 THEN 'Unauthorized: quota' ELSE event_type END"
        " AS message",
    )
    return (
        messages.selectExpr(
            "event_type", f"{R.error_class('message')} AS error_class",
            f"{R.final_error('message', 'event_type')} AS final_error",
        )
        .groupBy("event_type", "error_class", "final_error")
        .agg(F.count("*").alias("n"))
    )


def report_load(spark: SparkSession, sf: str) -> DataFrame:
    """Reports read back from JSON text in their shapes, broken ones included."""
    made = _documents(spark, sf).selectExpr(
        "doc_id",
        "CASE doc_id % 5 WHEN 0 THEN to_json(named_struct('document_summary', text,"
        " 'people_count', 7, 'source_file_name', source, 'potential_vulnerabilities',"
        " array(lang)))"
        " WHEN 1 THEN to_json(named_struct('document_summary', source, 'people_count',"
        " string(n_chars), 'priority_recommendations', array(lang, source)))"
        " WHEN 2 THEN to_json(named_struct('document_summary', lang, 'people_count',"
        " concat(doc_id % 90, ' (seen)')))"
        " WHEN 3 THEN to_json(named_struct('people_count', 'several', 'source_file_name', null),"
        " map('ignoreNullFields', 'false'))"
        " ELSE '{\"document_summary\": \"cut' END AS json",
    )
    return R.parse_reports(made, "json").selectExpr(
        "doc_id", "readable", "document_summary", "people_count", "people_count_num",
        "source_file_name", "potential_vulnerabilities[0] AS vulnerability",
        "size(priority_recommendations) AS recommendations",
    )


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    return R.parse_responses(_responses(spark, sf)).drop("branch")


def report_latest(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_reports(_reports(spark, sf)).selectExpr(
        "report_file", "source_file_name", "analysis_timestamp", "document_summary"
    )


def consolidated_report(spark: SparkSession, sf: str) -> DataFrame:
    done = R.consolidated(R.latest_reports(_reports(spark, sf)))
    return done.withColumn(
        "Key Security Findings", F.array_join("Key Security Findings", "\n")
    )


def report_headline(spark: SparkSession, sf: str) -> DataFrame:
    return R.headline(R.latest_reports(_reports(spark, sf)))


def report_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the report files that inputs would share."""
    names = _files(spark, sf).selectExpr(f"{stem('file_name')} AS stem")
    return names.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")


QUERIES = {
    "file_routing": file_routing,
    "units_to_text": units_to_text,
    "redacted_units": redacted_units,
    "sheets_to_text": sheets_to_text,
    "table_lines": table_lines,
    "empty_gate": empty_gate,
    "build_prompts": build_prompts,
    "parse_responses": parse_responses,
    "classify_errors": classify_errors,
    "report_load": report_load,
    "report_latest": report_latest,
    "report_names": report_names,
    "consolidated_report": consolidated_report,
    "report_headline": report_headline,
}

# ------------------------------------------------------------------- oracles


def _case(pairs: dict[str, str], default: str) -> str:
    hits = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE suffix {hits} ELSE {default} END"


_SUFFIX_SQL = f"lower([{_ARRAY}][doc_id % {len(_SUFFIXES)} + 1])"
_FILES_SQL = (
    f"WITH f AS (SELECT doc_id, source, lang, n_chars, text AS whole, {_TEXT} AS text,"
    f" {_NAME_SQL} AS file_name, {_SUFFIX_SQL} AS suffix, {_TIME_SQL} AS stamp FROM documents),"
    f" files AS (SELECT *, {_case(FILE_LABELS, repr(UNKNOWN_LABEL))} AS file_type,"
    f" {_case(CLEANSERS, 'NULL')} AS cleanser,"
    f" suffix IN ({', '.join(repr(s) for s in IMAGE_SUFFIXES)}) AS is_image FROM f)"
)
_BLANK_SQL = (
    f"(NOT is_image AND coalesce({oracle.strip('text')}, '') IN ('', '{texts.NO_TEXT}'))"
)


def _template(template: str) -> str:
    out = oracle.text(template)
    out = f"replace({out}, '{{file_name}}', file_name)"
    out = f"replace({out}, '{{file_type}}', file_type)"
    return f"replace({out}, '{{text}}', left(coalesce(text, ''), {texts.PROMPT_CHARACTERS}))"


_P = PromptTemplates()
_ANSWER = "('Only prose. ' || " + oracle.strip("replace(replace(whole, '{', ''), '}', '')") + ")"
_PARSED_SQL = (
    _FILES_SQL + ", parsed AS (SELECT"
    " CASE doc_id % 7 WHEN 3 THEN 'unstructured' WHEN 4 THEN 'broken' WHEN 5 THEN 'failed'"
    " WHEN 6 THEN 'failed' ELSE 'structured' END AS branch,"
    " file_name AS source_file_name, file_type AS source_file_type,"
    " CASE doc_id % 7 WHEN 0 THEN whole"
    f" WHEN 1 THEN '{texts.MISSING_SUMMARY}' WHEN 2 THEN whole"
    f" WHEN 3 THEN '{texts.UNSTRUCTURED_SUMMARY}' || file_type || ': ' || left({_ANSWER}, 300)"
    f" WHEN 4 THEN '{texts.BROKEN_SUMMARY}' END AS document_summary,"
    " CASE doc_id % 7 WHEN 0 THEN lang || '|' || source"
    f" WHEN 1 THEN '{texts.MISSING_FINDING}' WHEN 2 THEN source"
    f" WHEN 3 THEN '{texts.UNSTRUCTURED_FINDING}|Raw response length: ' ||"
    f" length({_ANSWER}) || ' characters'"
    f" WHEN 4 THEN '{texts.BROKEN_FINDING + texts.BROKEN_CAUSE}' ELSE '' END AS findings,"
    " CASE doc_id % 7 WHEN 1 THEN lang END AS environment_type,"
    " CASE doc_id % 7 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN n_chars || ' of'"
    " WHEN 2 THEN CASE WHEN doc_id % 2 = 1 THEN 'NaN' END END"
    " AS people_count,"
    " CASE doc_id % 7 WHEN 0 THEN n_chars > 999 END AS redacted_content_noted,"
    " CASE doc_id % 7 WHEN 0 THEN 0 END AS frameworks,"
    " CASE WHEN doc_id % 7 < 5 THEN 'model' END AS model_used,"
    " CASE WHEN doc_id % 7 < 3 THEN stamp END AS analysis_timestamp,"
    f" CASE doc_id % 7 WHEN 3 THEN length(left({_ANSWER}, 2000)) END AS raw_analysis_length,"
    " CASE doc_id % 7 WHEN 4 THEN '{\"document_summary\": ' || lang || '}' || doc_id END"
    " AS raw_response,"
    f" CASE WHEN doc_id % 7 = 5 THEN 'Analysis failed: {texts.EMPTY_RESPONSE}'"
    " WHEN doc_id % 7 < 5 THEN NULL"
    " WHEN doc_id % 3 = 1 THEN"
    f" '{texts.KEY_ERROR}'"
    " WHEN doc_id % 3 = 0 OR contains('timeout after ' || n_chars, '429')"
    " THEN 'Analysis for ' || file_name || ' failed after all retries'"
    " ELSE 'Analysis failed: timeout after ' || n_chars END AS error,"
    " CASE doc_id % 7 WHEN 2 THEN '{\"extra\":[1,2]}' END AS other_fields FROM files)"
)
_STEM_SQL = "regexp_replace({c}, '\\.[^.]+$', '')"
_LATEST_SQL = (
    _PARSED_SQL + ", latest AS (SELECT *,"
    f" {_STEM_SQL.format(c='source_file_name')} || '_analysis.json' AS report_file FROM parsed"
    " WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY report_file"
    " ORDER BY coalesce(analysis_timestamp, '') DESC, source_file_name DESC,"
    " document_summary DESC NULLS LAST, findings DESC NULLS LAST, environment_type DESC NULLS LAST,"
    " people_count DESC NULLS LAST, redacted_content_noted DESC NULLS LAST,"
    " frameworks DESC NULLS LAST, source_file_type DESC, model_used DESC NULLS LAST,"
    " raw_analysis_length DESC NULLS LAST, raw_response DESC NULLS LAST) = 1)"
)
_MESSAGE_SQL = (
    "CASE user_id % 6 WHEN 0 THEN 'status ' || (400 + event_id % 40)"
    " WHEN 1 THEN 'Quota exceeded' WHEN 2 THEN 'over the Rate Limit'"
    " WHEN 3 THEN 'missing API key' WHEN 4 THEN 'Unauthorized: quota' ELSE event_type END"
)

ORACLES = {
    "file_routing": f"{_FILES_SQL} SELECT suffix, file_type, cleanser, is_image, count(*) AS n"
    " FROM files GROUP BY ALL",
    "units_to_text": "SELECT conv_id, string_agg(role || ': ' || text || chr(10), ''"
    " ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "redacted_units": "SELECT conv_id, string_agg(line || chr(10), '' ORDER BY turn) AS text FROM"
    f" (SELECT conv_id, turn, {oracle.cascade('line', True, True)} AS line FROM"
    " (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations)) GROUP BY conv_id",
    "sheets_to_text": "SELECT file, string_agg(sheet, '' ORDER BY conv_id) AS text"
    " FROM (SELECT conv_id // 40 AS file, conv_id,"
    " '--- Sheet: conv ' || conv_id || ' ---' || chr(10) || string_agg(role || chr(9) || text ||"
    " chr(10), '' ORDER BY turn) || chr(10) AS sheet FROM conversations GROUP BY conv_id)"
    " GROUP BY file",
    "table_lines": "SELECT o_orderkey, concat_ws(chr(9), CAST(o_custkey AS VARCHAR),"
    " o_orderstatus, CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR),"
    " o_orderpriority) AS line FROM orders",
    "empty_gate": f"{_FILES_SQL} SELECT doc_id, '{texts.BLANK_SUMMARY}' AS document_summary,"
    f" '{texts.BLANK_FINDING}' AS finding, file_name AS source_file_name,"
    f" file_type AS source_file_type FROM files WHERE {_BLANK_SQL}",
    "build_prompts": f"{_FILES_SQL} SELECT file_name, file_type, CASE WHEN is_image"
    f" THEN {_template(_P.image)} ELSE {_template(_P.text)} END AS prompt FROM files"
    f" WHERE NOT {_BLANK_SQL}",
    "parse_responses": f"{_PARSED_SQL} SELECT * FROM parsed",
    "classify_errors": "SELECT event_type, error_class, CASE error_class"
    " WHEN 'rate_limit' THEN 'Analysis for ' || event_type || ' failed after all retries'"
    f" WHEN 'fatal' THEN '{texts.KEY_ERROR}' ELSE 'Analysis failed: ' || message END"
    " AS final_error, count(*) AS n FROM (SELECT event_type, message,"
    " CASE WHEN contains(message, '429') OR contains(lower(message), 'quota')"
    " OR contains(lower(message), 'rate limit') THEN 'rate_limit'"
    " WHEN contains(lower(message), 'api key') OR contains(lower(message), 'unauthorized')"
    " THEN 'fatal' ELSE 'retry' END AS error_class"
    f" FROM (SELECT event_type, {_MESSAGE_SQL} AS message FROM events)) GROUP BY ALL",
    "report_load": "SELECT doc_id, doc_id % 5 < 4 AS readable,"
    " CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN source WHEN 2 THEN lang END"
    " AS document_summary,"
    " CASE doc_id % 5 WHEN 0 THEN '7' WHEN 1 THEN CAST(n_chars AS VARCHAR)"
    " WHEN 2 THEN (doc_id % 90) || ' (seen)' WHEN 3 THEN 'several' END AS people_count,"
    " CASE doc_id % 5 WHEN 0 THEN 7 WHEN 1 THEN n_chars WHEN 2 THEN doc_id % 90 END"
    " AS people_count_num, CASE doc_id % 5 WHEN 0 THEN source END AS source_file_name,"
    " CASE doc_id % 5 WHEN 0 THEN lang END AS vulnerability,"
    " CASE doc_id % 5 WHEN 1 THEN 2 END AS recommendations FROM documents",
    "report_latest": f"{_LATEST_SQL} SELECT report_file, source_file_name, analysis_timestamp,"
    " document_summary FROM latest",
    "report_names": f"{_FILES_SQL} SELECT {_STEM_SQL.format(c='file_name')} AS stem,"
    " count(*) AS n FROM files GROUP BY 1 HAVING count(*) > 1",
    "consolidated_report": f"{_LATEST_SQL} SELECT source_file_name AS \"File Name\","
    " source_file_type AS \"File Type\", document_summary AS \"File Description\","
    " replace(findings, '|', chr(10)) AS \"Key Security Findings\" FROM latest",
    "report_headline": f"{_LATEST_SQL} SELECT 'This report summarizes the automated analysis of '"
    " || count(*) || ' processed files.' AS headline FROM latest",
}
