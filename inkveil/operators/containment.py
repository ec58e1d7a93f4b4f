"""Which texts hold which of many needles, without trying each on each.

Every needle is listed under one of its grams (short runs of characters), the
one that the fewest texts hold.  Texts meet needles on their grams by an equal
join, and what meets is verified.  The grams of the texts come from a small
helper in Python.  Where needles are few (at most MOST_LISTED) it knows them, and
a text meets its candidates within the task.

Longer lists meet the texts in a shuffle.  Grams that very many texts hold are
dealt over as many parts as their share of all entries asks for; at most PARTS
of them can hold that large a share, so the list of those is small whatever the
tables are.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions.sql import Sql, let, name
from inkveil.sources.shared import written

#: Characters of a gram; shorter needles are their own gram.
GRAM = 3
#: Parts of the join that the entries of all grams would fill evenly.
PARTS = 1000
#: Grams, and needles, that are told to every task.
MOST_LISTED = 20_000
#: Texts that are Python strings at one time; grams that a task counts before it hands the counts on.
ROWS_AT_ONCE, MOST_COUNTED = 64, 500_000


def grams(text: Sql, size: int) -> Sql:
    """The different runs of ``size`` characters, in time that follows the text's length."""
    if size == 1:
        return f"array_distinct(split({text}, ''))"
    run = ", ".join(f"c[i + {k}]" for k in range(size))
    runs = f"transform(sequence(0, size(c) - {size}), i -> concat({run}))"
    none = "CAST(array() AS array<string>)"
    return let("c", f"split({text}, '')", f"if(size(c) < {size}, {none}, array_distinct({runs}))")


def contained(
    texts: DataFrame, key: Sequence[str], text: str, needles: DataFrame, needle: str, gram: int = GRAM
) -> DataFrame:
    """The rows of ``texts`` beside the needles that they contain, as (key columns, text, needle).

    The key names a row of ``texts`` (it may be the text itself).  Empty
    needles are contained in nothing; null ones and null texts play no part.
    """
    rows = texts.select(*[F.col(name(k)) for k in dict.fromkeys([*key, text])])
    listed = needles.select(F.col(name(needle)).alias("__needle")).where("__needle <> ''").distinct()
    listed = listed.withColumn("__size", F.least(F.char_length("__needle"), F.lit(gram)))
    # At most ``gram`` lines.
    sizes = sorted(r[0] for r in listed.select("__size").distinct().collect())
    if not sizes:
        return rows.limit(0).withColumn(needle, F.lit("")).select(*rows.columns, needle)

    own = " ".join(f"WHEN {size} THEN {grams('__needle', size)}" for size in sizes)
    of_needles = listed.select("__needle", F.explode(F.expr(f"CASE __size {own} END")).alias("__gram"))
    # A gram that no text holds drops out here; one that all needles share is counted per task first.
    told = _few(of_needles, "__gram")
    held = _gram_counts(rows.select(name(text)), sizes, told).groupBy("__gram").agg(F.sum("__n").alias("__n"))
    wanted = written(held.join(of_needles.select("__gram").distinct(), "__gram"), "grams")
    rarest = (
        of_needles.join(wanted, "__gram")
        .groupBy("__needle")
        .agg(F.min(F.struct("__n", "__gram")).alias("__least"))
        .select("__needle", "__least.*")
    )
    rarest = written(rarest, "rarest")
    chosen = _few(rarest, "__gram")
    if chosen is not None and _few(rarest, "__needle") is not None:
        found = _each(rows, text, _needle_finder(sizes, rarest), "__needle")
    else:
        met = _dealt(rows, key, text, sizes, chosen, wanted, rarest)
        found = met.where(F.expr(f"contains({name(text)}, __needle)"))
    return found.select(*[F.col(name(c)) for c in rows.columns], F.col("__needle").alias(needle))


def _few(df: DataFrame, column: str) -> frozenset[str] | None:
    """The different values, if there are MOST_LISTED at most."""
    values = df.select(column).distinct().limit(MOST_LISTED + 1).collect()
    return frozenset(r[0] for r in values) if len(values) <= MOST_LISTED else None


def _gram_counts(texts: DataFrame, sizes: list[int], told: frozenset[str] | None) -> DataFrame:
    """(__gram, __n): how many texts hold each gram, one line per task and part of its texts."""
    grams_in, most, rows_at_once = _finder(sizes, told), MOST_COUNTED, ROWS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        def counted(n: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["__gram", "__n"])

        n: Counter = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                for text in batch.column(0).slice(start, rows_at_once).to_pylist():
                    for gram in grams_in(text):
                        n[gram] += 1
                if len(n) > most:
                    yield counted(n)
                    n.clear()
        yield counted(n)

    return texts.toDF("text").mapInArrow(run, "__gram string, __n long")


def _each(rows: DataFrame, text: str, finder: Callable[[str | None], Collection[str]], found: str) -> DataFrame:
    """``rows`` once per string that ``finder`` gives for their text, as the column ``found``."""
    at, rows_at_once = rows.columns.index(text), ROWS_AT_ONCE
    # Columns go by place, as mapInArrow does not take all names.
    own = [f"c{i}" for i in range(len(rows.columns))]
    numbered = rows.toDF(*own)
    schema = T.StructType([*numbered.schema.fields, T.StructField("found", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(start, rows_at_once)
                lists = [list(finder(text)) for text in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.string()))], names=schema.names)

    listed = numbered.mapInArrow(run, schema)
    return listed.select(*[F.col(o).alias(c) for o, c in zip(own, rows.columns, strict=True)], F.explode("found").alias(found))


def _finder(sizes: list[int], told: frozenset[str] | None) -> Callable[[str | None], set[str]]:
    """A function from a text to its different grams of these sizes, those told of if any are."""

    def grams_in(text: str | None) -> set[str]:
        out: set[str] = set()
        for size in sizes if text else ():
            out.update([text[i : i + size] for i in range(len(text) - size + 1)])
        return out if told is None else out & told

    return grams_in


def _needle_finder(sizes: list[int], rarest: DataFrame) -> Callable[[str | None], list[str]]:
    """A function from a text to the needles that it contains, each once; ``rarest`` is a short list."""
    by_gram: dict[str, list[str]] = {}
    for gram, needle in rarest.select("__gram", "__needle").collect():
        by_gram.setdefault(gram, []).append(needle)
    grams_in = _finder(sizes, frozenset(by_gram))

    def needles_in(text: str | None) -> list[str]:
        return [needle for gram in grams_in(text) for needle in by_gram[gram] if needle in text]

    return needles_in


def _dealt(
    rows: DataFrame, key: Sequence[str], text: str, sizes: list[int], chosen: frozenset[str] | None, wanted: DataFrame, rarest: DataFrame
) -> DataFrame:
    """Rows beside their candidates by a join of all grams; hot ones in parts."""
    keys = [F.col(name(k)) for k in key]
    entries = _each(rows, text, _finder(sizes, chosen), "__gram").select(*keys, "__gram")
    total = wanted.agg(F.sum("__n")).first()[0] or 1
    parts = F.ceil(F.col("__n") * PARTS / total).cast("int")
    hot = wanted.withColumn("__parts", parts).where("__parts > 1").select("__gram", "__parts")
    salt = F.coalesce(F.pmod(F.xxhash64(*keys), F.col("__parts")).cast("int"), F.lit(0))
    dealt = entries.join(F.broadcast(hot), "__gram", "left").withColumn("__salt", salt).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), parts - 1))
    index = rarest.withColumn("__salt", copies).select("__gram", "__salt", "__needle")
    met = dealt.join(index, ["__gram", "__salt"]).drop("__gram", "__salt")
    return met if list(key) == [text] else met.join(rows, list(key))
