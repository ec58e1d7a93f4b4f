"""Queries over single words, recognised words and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import tokens as T
from inkveil.operators.entities import telling_labels
from inkveil.operators.redact import PATTERN_PHASES
from inkveil.operators.regions import span_boxes, word_boxes
from inkveil.plans import oracle
from inkveil.plans.redaction import spans_of, spans_sql
from inkveil.plans.tables import documents, table
from inkveil.rules import DEFAULT_RULES
from inkveil.rules.words import TELLING_YEARS


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return T.distinct_words(documents(spark, sf, "text"), "text")


def token_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return T.word_entropy(_tokens(spark, sf)).withColumn("entropy", F.round("entropy", 6))


def documents_with_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "text", "source")
    found = docs.selectExpr("doc_id", "source", f"{T.secret_words('text')} AS secrets")
    return found.where("size(secrets) > 0").selectExpr(
        "doc_id", "source", "size(secrets) AS n", "array_min(secrets) AS first_secret"
    )


def whitelist_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Words that neither the built-in whitelist nor the part names list."""
    left = T.is_whitelisted(_tokens(spark, sf)).where("NOT is_whitelisted").select("token")
    names = table(spark, sf, "part").selectExpr("explode(split(p_name, ' ')) AS word")
    benchmark = table(spark, sf, "benchmark").selectExpr("explode(split(text, ' ')) AS word")
    listed = names.unionByName(benchmark).select(F.lower("word").alias("word")).distinct()
    return T.drop_whitelisted(left, listed)


def keyword_scan(spark: SparkSession, sf: str) -> DataFrame:
    hits = T.keyword_hits(_tokens(spark, sf))
    return hits.groupBy("category", "keyword").agg(
        F.count("*").alias("n"), F.min("token").alias("first_token")
    )


def sensitivity_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return T.judged(_tokens(spark, sf))


def verdict_in_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of each turn, judged in the context of the turn."""
    turns = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "concat(text, if(conv_id % 2 = 0, ' Login', '')) AS context",
        "posexplode(split(text, ' ')) AS (i, token)",
    )
    return T.judged(turns, context="context").drop("context")


def entity_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return telling_labels(spans_of(documents(spark, sf, "text")), ["doc_id"])


# Recognised words, with made-up confidence and boxes.
def ocr_regions(spark: SparkSession, sf: str) -> DataFrame:
    words = T.words_in_order(documents(spark, sf, "text"), "text", ["doc_id"])
    seen = words.selectExpr(
        "doc_id", "i", "text", "int((doc_id * 37 + i * 11) % 101) AS conf",
        "i % 12 * 80 AS left_px", "i DIV 12 * 20 AS top_px", "char_length(text) * 7 AS width",
    )
    return word_boxes(seen)


def span_regions(spark: SparkSession, sf: str) -> DataFrame:
    lines = documents(spark, sf, "text").selectExpr(
        "doc_id", r"posexplode(split(text, '\n')) AS (line_no, text)"
    )
    spans = lines.selectExpr(
        "doc_id", "line_no", "0 AS x0", "line_no * 14 AS y0", "char_length(text) * 6 AS x1",
        "line_no * 14 + 12 AS y1", "text",
    )
    return span_boxes(spans, phases=PATTERN_PHASES)


QUERIES = {
    "token_entropy": token_entropy,
    "documents_with_secrets": documents_with_secrets,
    "whitelist_filter": whitelist_filter,
    "keyword_scan": keyword_scan,
    "sensitivity_verdict": sensitivity_verdict,
    "verdict_in_context": verdict_in_context,
    "entity_verdict": entity_verdict,
    "ocr_regions": ocr_regions,
    "span_regions": span_regions,
}

_TOKENS = oracle.tokens()
_KEYWORDS = ", ".join(
    f"({n}, {oracle.text(c)}, {oracle.text(k)})"
    for n, (c, k, _) in enumerate(DEFAULT_RULES.keyword_rows())
)
_YEARS = " OR ".join(f"contains(text, '{y}')" for y in TELLING_YEARS)
_LABELS = ", ".join(oracle.text(label) for label in DEFAULT_RULES.entity_tags)
_GATED = " OR ".join(f"contains(lower(context), '{w}')" for w in DEFAULT_RULES.gate_words)


def _verdict_sql(reason: str) -> str:
    return (
        f"CASE WHEN token = '' THEN '' WHEN {oracle.whitelisted('token')} THEN 'whitelisted'"
        f" ELSE coalesce({reason}, '') END"
    )


def _verdict_rows(source: str, columns: str, reason: str) -> str:
    return (
        f"SELECT {columns}, reason NOT IN ('', 'whitelisted') AS sensitive, reason FROM"
        f" (SELECT *, {_verdict_sql(reason)} AS reason FROM {source})"
    )


def _in_context(reason: str) -> str:
    for category in DEFAULT_RULES.gated_categories:
        for word in DEFAULT_RULES.keywords[category]:
            found = f"WHEN contains(lower(token), {oracle.text(word)})"
            reason = reason.replace(f"{found} THEN 'keyword_{category}_{word}'",
                                    f"{found} AND ({_GATED}) THEN 'keyword_{category}_{word}'")
    return reason


ORACLES = {
    "token_entropy": f"{_TOKENS} SELECT token, round({oracle.bits('token')} + 0.0, 6) AS entropy,"
    f" {oracle.looks_random('token')} AS is_random FROM tokens",
    "documents_with_secrets": "SELECT doc_id, source, CAST(len(secrets) AS INTEGER) AS n,"
    " list_min(secrets) AS first_secret FROM (SELECT doc_id, source,"
    f" list_filter({oracle.words('text')}, lambda w: {oracle.looks_random('w')}) AS secrets"
    " FROM documents) WHERE len(secrets) > 0",
    "whitelist_filter": f"{_TOKENS} SELECT token FROM tokens"
    f" WHERE NOT {oracle.whitelisted('token')} AND lower(token) NOT IN"
    " (SELECT lower(unnest(string_split(p_name, ' '))) FROM part"
    " UNION SELECT lower(unnest(string_split(text, ' '))) FROM benchmark)",
    "keyword_scan": f"{_TOKENS}, k(n, category, keyword) AS (VALUES {_KEYWORDS})"
    " SELECT category, keyword, count(*) AS n, min(token) AS first_token FROM tokens JOIN k"
    " ON contains(lower(token), lower(keyword)) GROUP BY category, keyword",
    "sensitivity_verdict": f"{_TOKENS} "
    + _verdict_rows("tokens", "token", oracle.reason("token")),
    "verdict_in_context": _verdict_rows(
        "(SELECT conv_id, turn, text || CASE WHEN conv_id % 2 = 0 THEN ' Login' ELSE '' END AS context,"
        " unnest(string_split(text, ' ')) AS token,"
        " CAST(unnest(range(0, len(string_split(text, ' ')))) AS INTEGER) AS i FROM conversations)",
        "conv_id, turn, i, token",
        _in_context(oracle.reason("token")),
    ),
    "entity_verdict": f"WITH s AS ({spans_sql('documents')}) SELECT doc_id,"
    f" arg_min(label, start_char) AS entity_label FROM s WHERE label IN ({_LABELS})"
    " AND NOT (label = 'CARDINAL' AND regexp_matches(text, '^\\p{Nd}{1,2}$'))"
    f" AND NOT (label = 'DATE' AND NOT ({_YEARS})) GROUP BY doc_id",
    "ocr_regions": "WITH w AS (SELECT doc_id, unnest(ws) AS text,"
    " unnest(range(0, len(ws))) AS i FROM"
    f" (SELECT doc_id, {oracle.words('text')} AS ws FROM documents)),"
    " c AS (SELECT doc_id, CAST(i AS INTEGER) AS i, text AS token,"
    " CAST(i % 12 * 80 AS INTEGER) AS left_px, i // 12 * 20 AS top_px,"
    " CAST(length(text) * 7 AS INTEGER) AS width FROM w WHERE (doc_id * 37 + i * 11) % 101 > 40"
    f" AND length(text) >= 3), v AS (SELECT *, {_verdict_sql(oracle.reason('token'))} AS why FROM c)"
    f" SELECT doc_id, i, left_px, top_px, width, {oracle.mask('token')} AS masked_original,"
    " '<visual_' || why || '>' AS redacted_to, 'Image OCR' AS reason FROM v"
    " WHERE why NOT IN ('', 'whitelisted')",
    "span_regions": "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, 0 AS x0,"
    " CAST(line_no * 14 AS INTEGER) AS y0, CAST(length(text) * 6 AS INTEGER) AS x1,"
    " CAST(line_no * 14 + 12 AS INTEGER) AS y1 FROM (SELECT doc_id,"
    " unnest(string_split(text, chr(10))) AS text,"
    " unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents)"
    f" WHERE text <> {oracle.cascade('text')}",
}
