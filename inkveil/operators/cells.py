"""Tables cell by cell, and units of text put together again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType

from inkveil.functions.sql import name
from inkveil.operators.numbering import numbered, placed
from inkveil.operators.redact import ALL_PHASES, PATTERN_PHASES, redact
from inkveil.rules import DEFAULT_RULES, RuleSet
from inkveil.rules.reports import SHEET_HEADING
from inkveil.sources.shared import written

# Spelled with digits, points and signs alone.
_LETTERLESS = (IntegralType, DecimalType, DateType)


def redact_cells(
    df: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    phases: Sequence[str] = ALL_PHASES,
    keep: Sequence[str] = (),
    log: bool = False,
) -> DataFrame:
    """Redact every non-null cell as text, numbers and dates too; headers stay.

    Columns in ``keep`` (row keys, say) are left as they are.  All columns go
    through one scan.  A number or a date holds no letter, so only the rules
    that can match without one are tried on it.
    """
    targets = [c for c in df.columns if c not in keep]
    plain = [f.name for f in df.schema if f.name in targets and isinstance(f.dataType, _LETTERLESS)]
    as_text = df.select(
        *[F.col(name(c)).cast("string").alias(c) if c in targets else F.col(name(c))
          for c in df.columns]
    )
    worded = [c for c in targets if c not in plain]
    if plain:
        shapes = rules.without_letters()
        own = [p for p in phases if p in PATTERN_PHASES]
        packed = len(plain) > 1 and not log and rules.patterns == DEFAULT_RULES.patterns
        if packed:
            as_text = _packed(as_text, plain, shapes, own)
        else:
            as_text = redact(as_text, plain, shapes, own, log)
    return redact(as_text, worded, rules, phases, log) if worded else as_text


def _packed(
    df: DataFrame, columns: Sequence[str], rules: RuleSet, phases: Sequence[str]
) -> DataFrame:
    """Redact cells without letters as one text.

    They are kept apart by a character that no built-in rule takes and that ends
    a word as the end of a text does; and no rule matches less than six of their
    characters, so the length of a cell plays no part.
    """
    apart, null, cells = "\x02", "\x03", "__cells"
    text = F.concat_ws(apart, *(F.coalesce(F.col(name(c)), F.lit(null)) for c in columns))
    done = redact(df.withColumn(cells, text), cells, rules, phases)
    parts = F.split(cells, apart, -1)
    value = {c: F.nullif(parts[i], F.lit(null)).alias(c) for i, c in enumerate(columns)}
    return done.select(*(value.get(c, F.col(name(c))) for c in df.columns))


def rows_to_lines(df: DataFrame, keys: Sequence[str], separator: str = "\t") -> DataFrame:
    """Each row of a table as one line of text, nulls as empty cells."""
    cells = [
        F.coalesce(F.col(name(c)).cast("string"), F.lit("")) for c in df.columns if c not in keys
    ]
    return df.select(*keys, F.concat_ws(separator, *cells).alias("line"))


def aligned_lines(df: DataFrame, order: Sequence[str], missing: str = "NaN") -> DataFrame:
    """A table as an aligned block: (number, line), the header first.

    Rows are numbered from 0 in the given order.  Cells keep their spelling and
    stand at the right with two blanks before the longest, names with one; row
    numbers stand at the left.  The widths are one row of maxima, taken in part
    by every task.
    """
    cells = {c: F.coalesce(F.col(name(c)).cast("string"), F.lit(missing)) for c in df.columns}
    at = [f"__order_{n}" for n in range(len(order))]
    texts = df.select(*[F.col(name(c)).alias(o) for c, o in zip(order, at, strict=True)], *[v.alias(c) for c, v in cells.items()])
    ordered = written(placed(texts, [F.col(o) for o in at]), "rows")
    longest = [F.max(F.char_length(name(c))).alias(f"w{n}") for n, c in enumerate(df.columns)]
    widths = ordered.agg(F.count("*").alias("rows"), *longest).first()
    numbers = len(str(max(widths["rows"] - 1, 0)))

    def spread(values: Sequence[Column]) -> list[Column]:
        sizes = [max(len(c), (widths[f"w{n}"] or 0) + 1) for n, c in enumerate(df.columns)]
        return [part for v, size in zip(values, sizes, strict=True) for part in (F.lit(" "), F.lpad(v, size, " "))]

    header = df.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("number"),
        F.concat(F.lit(" " * numbers), *spread([F.lit(c) for c in df.columns])).alias("line"),
    )
    body = numbered(ordered, [], "number")
    row = F.concat(F.rpad((F.col("number") - 1).cast("string"), numbers, " "), *spread([F.col(name(c)) for c in df.columns]))
    return header.unionByName(body.select("number", row.alias("line")))


def workbook_lines(
    rows: DataFrame, file: str, sheet_number: str, sheet: str, row_number: str, line: str
) -> DataFrame:
    """The rows of all sheets of a file as one run of numbered lines.

    Each sheet starts with its heading and ends with an empty line.  Sheets and
    rows come in the order of their numbers, whatever these are.  Rows are put
    in order over all tasks, so that a sheet of any size is many tasks' work;
    only row counts are added up.
    """
    in_order = placed(rows, [F.col(name(c)) for c in (file, sheet_number, row_number)])
    in_order = written(in_order, "rows")
    counts = in_order.groupBy(file, sheet_number).agg(F.count("*").alias("__rows"))
    earlier = Window.partitionBy(file).orderBy(sheet_number).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # A heading and an empty line come on top of the rows.
    offsets = counts.withColumn(
        "__offset", F.coalesce(F.sum(F.col("__rows") + 2).over(earlier), F.lit(0))
    )
    placed_rows = numbered(in_order, [file, sheet_number], "__place").join(offsets, [file, sheet_number])
    at = F.col("__offset") + F.col("__place")
    own = F.struct(at.alias("number"), F.col(line).alias("line"))
    heading = F.struct(
        F.col("__offset").alias("number"),
        F.format_string(SHEET_HEADING, F.col(sheet).cast("string")).alias("line"),
    )
    closing = F.struct((at + 1).alias("number"), F.lit("").alias("line"))
    lines = F.array_compact(
        F.array(
            F.when(F.col("__place") == 1, heading),
            own,
            F.when(F.col("__place") == F.col("__rows"), closing),
        )
    )
    return placed_rows.select(file, F.inline(lines))


def lines_to_text(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """Each file's lines in order as one text, every line ended by a break."""
    part = F.struct(F.col(number).alias("number"), F.col(line).alias("line"))
    parts = F.array_sort(F.collect_list(part))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["line"], F.lit("\n"))), "")
    return lines.groupBy(file).agg(text.alias("text"))
