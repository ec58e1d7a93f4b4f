"""Report files and report tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators.reports import latest_reports, parse_reports
from inkveil.sources.shared import written

#: Folders of a report store: each holds the reports of some names.
BUCKETS = 64


def read_report_files(spark: SparkSession, directory: str) -> DataFrame:
    """One JSON object per ``*_analysis.json`` file; broken files have ``readable`` false."""
    files = (
        spark.read.option("pathGlobFilter", "*_analysis.json")
        .text(directory, wholetext=True)
        .select(F.col("_metadata.file_name").alias("report_file"), F.col("value").alias("json"))
    )
    return parse_reports(files, "json")


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines, many to a file; replaces what was there."""
    reports.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_reports`` wrote, in the same typed columns."""
    lines = spark.read.text(path).withColumnRenamed("value", "json")
    return parse_reports(
        lines.withColumn("report_file", F.get_json_object("json", "$.report_file")), "json"
    )


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    """(value, bucket) of a store; None where there is none yet."""
    try:
        return spark.read.schema("value string, bucket int").text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """All reports of a store, in typed columns."""
    lines = _lines(spark, path)
    lines = spark.createDataFrame([], "value string, bucket int") if lines is None else lines
    named = lines.select(F.get_json_object("value", "$.report_file").alias("report_file"), F.col("value").alias("json"))
    return parse_reports(named, "json")


def save_reports(reports: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Save one report per report file; those saved before under other names stay, those under the same names go.

    Reports with an error are not saved.  Of several for one file the latest
    is.  A folder of the store holds the files of one hash bucket; a run reads
    and replaces only the buckets that its reports belong to, each in one
    move.  Saving the same reports again changes nothing.  Two runs at the same
    time are safe as long as they share no bucket.
    """
    spark = reports.sparkSession
    bucket = F.pmod(F.xxhash64("report_file"), F.lit(buckets)).cast("int")
    new = latest_reports(reports).drop("error").withColumn("bucket", bucket)
    new = written(new.select(F.to_json(F.struct(*[c for c in new.columns if c != "bucket"])).alias("value"), "report_file", "bucket"), "new")
    old = _lines(spark, path)
    out = new.select("value", "bucket")
    if old is not None:
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        before = old.where(F.col("bucket").isin(touched)).withColumn("report_file", F.get_json_object("value", "$.report_file"))
        out = out.unionByName(before.join(new, "report_file", "left_anti").select("value", "bucket"))
    # Written elsewhere first, as the store cannot be read while it is replaced.
    out = written(out, "merged").repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").text(path)
