"""The given tables, and text tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A session may ask for so many pieces of every table that is read.  Unset, the
# pieces are those of the files; the size of a table plays no part.
INPUT_PIECES = "spark.inkveil.inputPieces"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    pieces = spark.conf.get(INPUT_PIECES, None)
    return df.repartition(int(pieces)) if pieces else df


def documents(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", *columns)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the session's shuffle partitions.

    A file of few row groups is read by few tasks, however many rows it has;
    this is for narrow tables whose rows are a lot of work each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts)
