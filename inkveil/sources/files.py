"""The corpus as a directory: listing, routing by kind, tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.sql import Sql, string
from inkveil.rules.files import CLEANSERS, FILE_LABELS, IMAGE_SUFFIXES, UNKNOWN_LABEL


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """All regular files of a directory, not of its subdirectories; contents are not read.

    Listed through the file system, as Spark's readers pass over empty files and
    names that begin with "_" or "."; ``hidden`` tells which those are.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    rows = [
        (f.getPath().getName(), f.getPath().toString(), f.getLen(), f.getModificationTime())
        for f in found
        if f.isFile()
    ]
    files = spark.createDataFrame(rows, "file_name string, path string, length long, millis long")
    hidden = F.col("file_name").rlike("^[_.]") | (F.col("length") == 0)
    return files.select(
        "file_name", "path", "length", F.timestamp_millis("millis").alias("modified"),
        hidden.alias("hidden"),
    )


def _scanned(files: DataFrame) -> DataFrame:
    name_ = F.element_at(F.split("path", "/"), -1)
    return files.select(name_.alias("file_name"), "path", "length", F.col("modificationTime").alias("modified"))


def scan_files(spark: SparkSession, directory: str, names: str = "*", nested: bool = False) -> DataFrame:
    """The files of a directory as a scan, for directories of any size; contents are not read.

    Spark lists large trees by tasks and hands the rows to tasks.  As for all
    its readers, names that begin with "_" or "." are not there;
    ``list_files`` shows those.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", names)
    return _scanned(reader.option("recursiveFileLookup", nested).load(directory))


def stream_files(spark: SparkSession, directory: str, names: str = "*", at_once: int = 1000) -> DataFrame:
    """``scan_files`` as a stream: every file once, ``at_once`` of them in a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", names)
    return _scanned(reader.option("maxFilesPerTrigger", at_once).load(directory))


def suffix(file_name: Sql) -> Sql:
    """Lower-case suffix with its dot; empty without one.

    A dot at the start or the end of the name begins no suffix.
    """
    return f"lower(regexp_extract({file_name}, {string(r'[^/](\.[^./]+)\z')}, 1))"


def stem(file_name: Sql) -> Sql:
    """The last part of a path without its suffix."""
    base = f"substring_index({file_name}, '/', -1)"
    return f"regexp_replace({base}, {string(r'(?<=[^/])\.[^./]+\z')}, '')"


def _lookup(pairs: dict[str, str], key: Sql, default: Sql) -> Sql:
    hits = " ".join(f"WHEN {string(k)} THEN {string(v)}" for k, v in pairs.items())
    return f"CASE {key} {hits} ELSE {default} END"


def file_type(file_name: Sql) -> Sql:
    return _lookup(FILE_LABELS, suffix(file_name), string(UNKNOWN_LABEL))


def cleanser(file_name: Sql) -> Sql:
    """How the file is cut into text units; null for a file that is skipped."""
    return _lookup(CLEANSERS, suffix(file_name), "null")


def is_image(file_name: Sql) -> Sql:
    return f"{suffix(file_name)} IN ({', '.join(string(s) for s in IMAGE_SUFFIXES)})"


def route(files: DataFrame, column: str = "file_name") -> DataFrame:
    """Add suffix, label, cleanser and image flag to each file.

    The kinds are a dozen constants, so they are part of the projection instead
    of a joined table.
    """
    return files.withColumns(
        {
            "suffix": F.expr(suffix(column)),
            "file_type": F.expr(file_type(column)),
            "cleanser": F.expr(cleanser(column)),
            "is_image": F.expr(is_image(column)),
        }
    )


def accepted(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("cleanser").isNotNull())


def skipped(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("cleanser").isNull())


def read_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file with a header, every cell a string in its own spelling.

    Cells with line breaks need ``multi_line``; each file is then one task's work.
    """
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header; replaces what was there."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """One word per line: trimmed, lower case, without blanks, each once."""
    from inkveil.functions.text import strip

    return (
        spark.read.text(path)
        .select(F.expr(f"lower({strip('value')})").alias("word"))
        .where("word <> ''")
        .distinct()
    )
