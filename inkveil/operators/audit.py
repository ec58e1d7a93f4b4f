"""The audit trail: one masked row per replacement, and counts over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.masking import mask
from inkveil.functions.sql import Sql, name
from inkveil.functions.text import flatten_lines
from inkveil.operators.numbering import numbered, placed
from inkveil.sources.shared import written

AUDIT_COLUMNS = ("timestamp", "file_name", "masked_original", "redacted_to", "reason")


def masked(original: Sql) -> Sql:
    """The original on one line, masked."""
    flat = flatten_lines(original)
    return f"transform(array({flat}), flat -> {mask('flat')})[0]"


def entries(df: DataFrame, log: str, keys: Sequence[str]) -> DataFrame:
    """One row per log entry: the keys, the entry and its place in the log."""
    return df.selectExpr(
        *[name(k) for k in keys], f"posexplode({name(log)}) AS (position, entry)"
    ).selectExpr(*[name(k) for k in keys], "position", "entry.*")


def audit_log(df: DataFrame, log: str, file_name: Sql) -> DataFrame:
    """Rows for the audit file; nothing longer than five characters in full."""
    exploded = df.selectExpr(f"{file_name} AS file_name", f"explode({name(log)}) AS entry")
    return exploded.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "file_name",
        F.expr(masked("entry.original")).alias("masked_original"),
        F.col("entry.tag").alias("redacted_to"),
        F.col("entry.reason").alias("reason"),
    )


def masked_log(log: Sql) -> Sql:
    """The log with masked originals, fit to be stored beside the text."""
    return (
        f"transform({log}, e -> named_struct('masked_original', {masked('e.original')},"
        " 'redacted_to', e.tag, 'reason', e.reason))"
    )


def append_audit(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append to the audit table; as CSV with a header if asked for."""
    writer = rows.select(*AUDIT_COLUMNS).write.mode("append")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def audit_entries(df: DataFrame, log: str, file_name: Sql, text: Sql) -> DataFrame:
    """``audit_log`` with ``entry_key``, which names an entry for good.

    It is a digest of the file's name, of its text before redaction and of the
    entry's place in the log, so the same file redacted again gives the same
    keys, and a changed one gives new ones.
    """
    content = f"sha2(coalesce({text}, ''), 256)"
    exploded = df.selectExpr(
        f"{file_name} AS file_name", f"{content} AS __content", f"posexplode({name(log)}) AS (__place, entry)"
    )
    key = "sha2(concat_ws('/', __content, __place, coalesce(file_name, '')), 256)"
    return exploded.select(
        F.expr(key).alias("entry_key"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "file_name",
        F.expr(masked("entry.original")).alias("masked_original"),
        F.col("entry.tag").alias("redacted_to"),
        F.col("entry.reason").alias("reason"),
    )


def append_audit_once(rows: DataFrame, path: str) -> None:
    """Append those of ``audit_entries`` that are not in the table yet.

    A repeated batch, or one that was cut short and is run again, adds only
    what is missing.  Writers at the same time lose nothing, as each adds files
    of its own; what two of them add at once is one entry in ``audit_table``.
    """
    rows = rows.dropDuplicates(["entry_key"])
    known = _table(rows.sparkSession, path)
    if known is not None:
        rows = rows.join(known.select("entry_key"), "entry_key", "left_anti")
    rows.select("entry_key", *AUDIT_COLUMNS).write.mode("append").parquet(path)


def audit_table(spark: SparkSession, path: str) -> DataFrame:
    """Every entry once, the earliest of those that came twice."""
    known = _table(spark, path)
    if known is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in AUDIT_COLUMNS))
    first = F.min(F.struct(*AUDIT_COLUMNS)).alias("first")
    return known.groupBy("entry_key").agg(first).select("first.*")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    schema = ", ".join(f"{c} string" for c in ("entry_key", *AUDIT_COLUMNS))
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def audit_csv(table: DataFrame) -> DataFrame:
    """(number, line): the table as lines of one CSV file, the header as line 0, then by time, file and key."""
    def cell(column: str) -> Sql:
        value = f"coalesce({name(column)}, '')"
        quoted = f"concat('\"', replace({value}, '\"', '\"\"'), '\"')"
        return f"if({value} RLIKE '[\",\\r\\n]', {quoted}, {value})"

    line = f"concat_ws(',', {', '.join(map(cell, AUDIT_COLUMNS))})"
    rows = written(placed(table, [F.col(c) for c in AUDIT_COLUMNS]), "rows")
    body = numbered(rows, [], "number").selectExpr("number", f"{line} AS line")
    header = table.sparkSession.range(1).selectExpr("0L AS number", f"'{','.join(AUDIT_COLUMNS)}' AS line")
    return header.unionByName(body)


def counted(log: Sql) -> Sql:
    """Number of replacements of a text that its summary reports.

    Trigger phrases have audit rows but are not part of the summary.
    """
    return f"size(filter({log}, e -> e.phase > 1))"


def first_entries(log: Sql, n: int = 5) -> Sql:
    """The first ``n`` replacements of the summary, in the order they happened.

    Within a rule the last match of the text comes first.  The log of a text is
    an array beside it, so nothing is shuffled and no group is built.
    """
    summary = (
        f"filter(transform({log}, (e, i) -> named_struct('phase', e.phase, 'ord', e.ord,"
        " 'back', -i, 'tag', e.tag, 'original', e.original, 'reason', e.reason)),"
        " e -> e.phase > 1)"
    )
    return f"slice(array_sort({summary}), 1, {n})"


def tag_counts(df: DataFrame, log: str, keys: Sequence[str]) -> DataFrame:
    """Replacements per key and tag.  Partial counts are made before the shuffle."""
    tags = df.selectExpr(*[name(k) for k in keys], f"explode({name(log)}.tag) AS tag")
    return tags.groupBy(*keys, "tag").agg(F.count("*").alias("n"))


def inventory(df: DataFrame, log: str, dimensions: Sequence[str]) -> DataFrame:
    """Replacements by tag and dimensions with all subtotals.

    Counting the finest groups first keeps the cube from multiplying the
    entries themselves.
    """
    finest = tag_counts(df, log, dimensions)
    return finest.cube("tag", *dimensions).agg(F.sum("n").alias("n"))
