"""Queries that redact texts, cells and rendered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.sql import let, strings
from inkveil.functions.text import chunks, cut
from inkveil.operators.cells import redact_cells
from inkveil.operators.entities import redact_entity_arrays, redact_with_entity_arrays
from inkveil.operators.redact import PATTERN_PHASES, merge_tags, redact
from inkveil.plans import oracle
from inkveil.plans.tables import documents, spread, table
from inkveil.rules import DEFAULT_RULES, RuleSet

# Keywords that do occur in the documents.
COMMON_WORDS = RuleSet(
    keywords={
        "company_names": ("attion", "The", "es la"),
        "locations": ("and",),
        "banks": ("le", "der", "ouan"),
    }
)

ORDER_RECORD = (
    "concat('Source: ', o_orderpriority, '  \\n', 'Order ID: ', o_orderkey,"
    " ' Customer ID: ', o_custkey, ' of ', o_orderstatus, '\\nDestination:\\n  ', o_orderpriority,"
    " ' dock\\nSalary: unknown, ', o_totalprice, ' Invoice No ', o_custkey, '\\nPage: ',"
    " o_orderkey, ' Policy No none')"
)
_ORDER_RECORD_SQL = (
    "concat('Source: ', o_orderpriority, '  ', chr(10), 'Order ID: ', o_orderkey,"
    " ' Customer ID: ', o_custkey, ' of ', o_orderstatus, chr(10), 'Destination:', chr(10), '  ',"
    " o_orderpriority, ' dock', chr(10), 'Salary: unknown, ', o_totalprice, ' Invoice No ',"
    " o_custkey, chr(10), 'Page: ', o_orderkey, ' Policy No none')"
)

_COMPANY = "CASE c_nationkey % 4 WHEN 0 THEN 'Infosys' WHEN 1 THEN 'project titan'" \
    " WHEN 2 THEN 'Metadata' ELSE 'John Doe' END"
_BANK = "CASE c_custkey % 5 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'Axis Bank' WHEN 2 THEN" \
    " 'SBI SBI' WHEN 3 THEN 'Project Alpha' ELSE 'Mumbai' END"
CUSTOMER_RECORD = (
    f"concat('Client ', c_name, ' at ', {_COMPANY}, ' with ', {_BANK}, '. Account Balance: ',"
    " c_acctbal, '. Mail c', c_custkey, '@', lower(c_mktsegment), '.example.com, host db-',"
    " c_nationkey, '-', c_custkey, ' pin: ', c_custkey, ' ', c_mktsegment)"
)


def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "text")
    return redact(docs, "text", phases=PATTERN_PHASES).withColumnRenamed("text", "redacted")


def redact_page_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return redact(pages, "url", phases=PATTERN_PHASES).withColumnRenamed("url", "redacted")


def redact_pages_html(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "html")
    return redact(pages, "html", phases=("pattern",)).withColumnRenamed("html", "redacted")


def redact_pages_html_merged(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "html")
    return redact(pages, "html", phases=PATTERN_PHASES).withColumnRenamed("html", "redacted")


def redact_conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return redact(turns, "text", phases=PATTERN_PHASES).withColumnRenamed("text", "redacted")


def redact_full_cascade(spark: SparkSession, sf: str) -> DataFrame:
    records = spread(table(spark, sf, "customer")).selectExpr("c_custkey", f"{CUSTOMER_RECORD} AS text")
    return redact(records, "text").withColumnRenamed("text", "redacted")


def contextual_rules(spark: SparkSession, sf: str) -> DataFrame:
    records = spread(table(spark, sf, "orders")).selectExpr("o_orderkey", f"{ORDER_RECORD} AS text")
    done = redact(records, "text", phases=("context",))
    return done.withColumnRenamed("text", "redacted")


def keyword_redaction(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "text")
    done = redact(docs, "text", COMMON_WORDS, phases=("keyword",))
    return done.withColumnRenamed("text", "redacted")


_TAGGED = (
    "concat('<', l_returnflag, '> <', l_returnflag, '> <', l_linestatus, '><', l_linestatus,"
    " '> <', CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_linestatus END, '>  <',"
    " CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_linestatus END, '> <',"
    " CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_linestatus END, '>')"
)


def merge_tags_query(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").selectExpr(f"{_TAGGED} AS tagged")
    merged = lines.selectExpr(f"{merge_tags('tagged')} AS merged")
    return merged.groupBy("merged").agg(F.count("*").alias("n"))


# Spans a tagger might give: one every 40 characters, with labels in turn.
_LABELS = ("PERSON", "ORG", "GPE", "LOC", "DATE", "MONEY", "CARDINAL", "FAC", "PRODUCT", "NORP")


_START, _WIDTH = "k * 40 + doc_id % 20", "2 + k % 7"
_LABEL = f"array({strings(_LABELS)})[int((k + doc_id) % {len(_LABELS)})]"


def tagged(texts: DataFrame) -> DataFrame:
    """Made-up entity spans beside (doc_id, text), as many as the text has room for."""
    span = (
        f"named_struct('start_char', {_START}, 'end_char', {_START} + {_WIDTH}, 'label', {_LABEL},"
        f" 'text', {cut('pieces', _START, f'{_START} + {_WIDTH}')})"
    )
    places = f"filter(sequence(0L, size DIV 40), k -> {_START} + {_WIDTH} <= size)"
    spans = let("pieces", chunks("text"), f"transform({places}, k -> {span})")
    return texts.withColumn("spans", F.expr(let("size", "char_length(text)", spans)))


#: Characters of a piece of text whose spans are cut out of it, and of the longest span.
_PIECE, _WIDEST = 1024, 8


def spans_of(texts: DataFrame) -> DataFrame:
    """The same as rows; each is cut out of the piece of text that it starts in, in compiled code."""
    pieces = f"transform(sequence(0L, size DIV {_PIECE}), n -> substring(text, int(n * {_PIECE}) + 1, {_PIECE + _WIDEST}))"
    sized = texts.selectExpr("doc_id", "text", "char_length(text) AS size")
    cut_up = sized.selectExpr("doc_id", "size", f"posexplode({pieces}) AS (n, piece)")
    first = f"if(n = 0, 0L, (bigint(n) * {_PIECE} - doc_id % 20 + 39) DIV 40)"
    last = f"((bigint(n) + 1) * {_PIECE} - 1 - doc_id % 20) DIV 40"
    each = cut_up.selectExpr("doc_id", "size", "n", "piece", f"explode(sequence({first}, {last})) AS k")
    span = f"substring(piece, int({_START} - bigint(n) * {_PIECE}) + 1, int({_WIDTH}))"
    return each.where(f"{_START} + {_WIDTH} <= size").selectExpr(
        "doc_id", f"{_START} AS start_char", f"{_START} + {_WIDTH} AS end_char", f"{_LABEL} AS label", f"{span} AS text"
    )


def spans_sql(source: str) -> str:
    """The same spans as a common table expression body."""
    labels = ", ".join(f"'{label}'" for label in _LABELS)
    return (
        "SELECT doc_id, k * 40 + doc_id % 20 AS start_char,"
        " k * 40 + doc_id % 20 + 2 + k % 7 AS end_char,"
        f" [{labels}][(k + doc_id) % {len(_LABELS)} + 1] AS label, text AS whole,"
        " substr(text, k * 40 + doc_id % 20 + 1, 2 + k % 7) AS text"
        " FROM (SELECT doc_id, text, unnest(range(0, length(text) // 40 + 1)) AS k"
        f" FROM {source})"
        " WHERE k * 40 + doc_id % 20 + 2 + k % 7 <= length(text)"
    )


def entity_redaction(spark: SparkSession, sf: str) -> DataFrame:
    texts = redact(documents(spark, sf, "text"), "text", phases=("pattern",))
    done = redact_entity_arrays(tagged(texts), "text", "spans")
    return done.selectExpr("doc_id", "text AS redacted")


_ENTITY_TAG = (
    "CASE label WHEN 'PERSON' THEN '<person>' WHEN 'ORG' THEN '<organization>'"
    " WHEN 'GPE' THEN '<location>' WHEN 'LOC' THEN '<location>' WHEN 'DATE' THEN '<date>'"
    " WHEN 'MONEY' THEN '<amount>' WHEN 'FAC' THEN '<facility>'"
    " WHEN 'PRODUCT' THEN '<product>' END"
)


def _entity_sql(text: str, finish: str) -> str:
    """``text``: what the spans refer to; ``finish``: what becomes of the spliced text ``x``."""
    return (
        f"WITH t AS MATERIALIZED (SELECT doc_id, {text} AS text FROM documents),"
        f" s AS ({spans_sql('t')}), p AS (SELECT *, {_ENTITY_TAG} AS tag FROM s),"
        " r AS (SELECT *, tag IS NOT NULL AND NOT contains(text, '<')"
        f" AND NOT {oracle.whitelisted(oracle.strip('text'))}"
        " AND NOT (label = 'PERSON' AND (length(text) < 3 OR lower(text) IN ('the', 'and', 'for')))"
        " AS hit, lead(start_char) OVER (PARTITION BY doc_id ORDER BY start_char) AS following FROM p),"
        " j AS (SELECT doc_id, string_agg(CASE WHEN hit THEN tag ELSE text END ||"
        " CASE WHEN following IS NULL THEN substr(whole, end_char + 1)"
        " ELSE substr(whole, end_char + 1, following - end_char) END, '' ORDER BY start_char) AS rest,"
        " min(start_char) AS first FROM r GROUP BY doc_id),"
        " spliced AS MATERIALIZED (SELECT t.doc_id, CASE WHEN j.doc_id IS NULL THEN t.text"
        " ELSE substr(t.text, 1, j.first) || j.rest END AS x FROM t LEFT JOIN j ON t.doc_id = j.doc_id)"
        f" SELECT doc_id, {finish} AS redacted FROM spliced"
    )


def redact_with_tagger(spark: SparkSession, sf: str) -> DataFrame:
    """All phases, spans included; the log is compared with a twin in the tests."""
    done = redact_with_entity_arrays(documents(spark, sf, "text"), "text", tagged)
    return done.selectExpr("doc_id", "text AS redacted")


def cells(name: str, key: str):
    """All cells through all phases; the key is copied beside them first."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = spread(table(spark, sf, name)).withColumn("row_key", F.col(key))
        return redact_cells(rows, keep=["row_key"])

    return query


_CELL_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
}


# HTML elements that can stand without attributes.
_BARE_TAGS = [
    f"<{name}>" for name in (
        "a article aside b blockquote body br button code dd div dl dt em footer form h1 h2 h3 h4 h5 h6 head header"
        " hr html i img input label li link main nav ol p pre script section small span strong style table tbody td"
        " th thead title tr u ul"
    ).split()
]


def _cells_sql(name: str) -> str:
    columns = _CELL_COLUMNS[name]
    cast = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
    done = ", ".join(f"{oracle.cascade(c, True, True)} AS {c}" for c in columns)
    return f"SELECT row_key, {done} FROM (SELECT {columns[0]} AS row_key, {cast} FROM {name})"


QUERIES = {
    "redact_documents": redact_documents,
    "redact_page_urls": redact_page_urls,
    "redact_pages_html": redact_pages_html,
    "redact_pages_html_merged": redact_pages_html_merged,
    "redact_conversations": redact_conversations,
    "redact_full_cascade": redact_full_cascade,
    "contextual_rules": contextual_rules,
    "keyword_redaction": keyword_redaction,
    "merge_tags": merge_tags_query,
    "entity_redaction": entity_redaction,
    "redact_with_tagger": redact_with_tagger,
    **{f"redact_cells_{n}": cells(n, c[0]) for n, c in _CELL_COLUMNS.items()},
}

ORACLES = {
    "redact_documents": f"SELECT doc_id, {oracle.cascade('text')} AS redacted FROM documents",
    "redact_page_urls": f"SELECT page_id, {oracle.cascade('url')} AS redacted FROM pages",
    "redact_pages_html": "SELECT page_id,"
    f" {oracle.guarded('html', oracle.pattern_phase('html'))} AS redacted FROM pages",
    # Tags of different names cannot overlap, so they are merged name by name.
    "redact_pages_html_merged": "SELECT page_id, "
    + oracle.guarded("html", oracle.merge_phase(oracle.pattern_phase("html"), [*oracle.PATTERN_TAGS, *_BARE_TAGS]))
    + " AS redacted FROM pages",
    "redact_conversations":
        f"SELECT conv_id, turn, {oracle.cascade('text')} AS redacted FROM conversations",
    "redact_full_cascade": f"SELECT c_custkey, {oracle.cascade('text', True, True)} AS redacted"
    f" FROM (SELECT c_custkey, {CUSTOMER_RECORD} AS text FROM customer)",
    "contextual_rules": f"SELECT o_orderkey, {oracle.context_phase('text')} AS redacted"
    f" FROM (SELECT o_orderkey, {_ORDER_RECORD_SQL} AS text FROM orders)",
    "keyword_redaction": "SELECT doc_id,"
    f" {oracle.guarded('text', oracle.keyword_phase('text', COMMON_WORDS))} AS redacted"
    " FROM documents",
    "merge_tags": f"SELECT merged, count(*) AS n FROM (SELECT"
    f" {oracle.merge_phase('tagged', ['<A>', '<F>', '<N>', '<O>', '<R>'])} AS merged"
    f" FROM (SELECT {_TAGGED} AS tagged FROM lineitem)) GROUP BY merged",
    "entity_redaction": _entity_sql(oracle.guarded("text", oracle.pattern_phase("text")), "x"),
    "redact_with_tagger": _entity_sql(
        oracle.guarded("text", oracle.pattern_phase(oracle.context_phase("text"))),
        oracle.guarded("x", oracle.merge_phase(oracle.keyword_phase("x"), DEFAULT_RULES.tags())),
    ),
    **{f"redact_cells_{n}": _cells_sql(n) for n in _CELL_COLUMNS},
}
