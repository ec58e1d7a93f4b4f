"""Tables, row-wise work on texts, and written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that go to Python at one time.
BATCH = "4m"
#: Bytes of text that are Python strings at one time (one row at least).
BYTES_AT_ONCE = 1_000_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column has it (case aside)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def fold(column: Column, parts: int) -> Column:
    """crc32 of a key's text modulo ``parts``; a null key is in fold 0."""
    return F.coalesce(F.crc32(column.cast("string")) % parts, F.lit(0))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python in batches of a few megabytes.

    Spark's own bound, 64 MB a batch, costs an executor several times that in
    buffers; it is an option of the session, and is set there.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df


def by_size(batch: pa.RecordBatch, column: int, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes of text, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def text_rows(batches: Iterator[pa.RecordBatch], column: int, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from by_size(batch, column, most)


def map_texts(
    df: DataFrame,
    keys: list[str],
    text: str,
    fields: list[T.StructField],
    work: Callable[[], Callable[[list[str | None]], list[list]]],
) -> DataFrame:
    """Add columns worked out from a text; nothing but keys and text reaches Python.

    ``work`` is called once per task and returns a function from a list of
    texts to one list per new field.
    """
    # Columns go by place, as mapInArrow does not take all names.
    own = [f"key_{i}" for i in range(len(keys))]
    chosen = df.select(*(named(k).alias(o) for k, o in zip(keys, own, strict=True)), named(text).alias("text"))
    schema = T.StructType([*chosen.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        each = work()
        for batch in text_rows(batches, len(own)):
            columns = each(batch.column(len(own)).to_pylist())
            arrays = [batch.column(i) for i in range(len(own))]
            arrays += [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return chosen.transform(small_batches).mapInArrow(run, schema).toDF(*keys, *(f.name for f in fields))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies in ``spark.checkpoint.dir``; where that is unset (tests on one
    machine) in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/inkveil-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows as a Parquet table in the shared folder: their lineage ends there.

    Readers of the result do not repeat the work, and a lost executor loses
    nothing.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
