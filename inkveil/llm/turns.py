"""Rows of conversations as ordered streams.

All rows of a key go to one task in order and are read one after another, batch
by batch; nothing here holds a conversation, so a very long one costs time but
no memory.  Sorting is Spark's, which spills.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from inkveil.llm.common import BYTES_AT_ONCE, small_batches, text_rows

#: Rows and characters of results handed on at one time.
ROWS_AT_ONCE = 4096


def in_order(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """``df`` with the rows of each key in one partition, in this order."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def handed_on(rows: Iterable[tuple], schema: T.StructType, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size (one row at least)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def batch(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=schema.names)

    part, size = [], 0
    for row in rows:
        part.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(part) >= ROWS_AT_ONCE or size >= most:
            yield batch(part)
            part, size = [], 0
    if part:
        yield batch(part)


def streamed(df: DataFrame, text: str, schema: T.StructType, work: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``work`` on the rows of each partition, as an iterator of tuples.

    ``text`` is the column whose size bounds what is in Python at one time.
    """
    at = df.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in text_rows(batches, at):
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from handed_on(work(rows(batches)), schema)

    return small_batches(df).mapInArrow(run, schema)
