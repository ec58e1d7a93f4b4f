"""Stores that are written again and again, aligned tables, and numbers over many tasks."""

from __future__ import annotations

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkveil.operators import audit
from inkveil.operators.cells import aligned_lines, workbook_lines
from inkveil.operators.numbering import numbered, placed, running_total
from inkveil.operators.redact import redact
from inkveil.sources.reports import save_reports, stored_reports
from inkveil.sources.shared import written

REPORT = "source_file_name string, source_file_type string, analysis_timestamp string, document_summary string, key_security_findings array<string>, people_count string, error string"


def reports(spark, *rows):
    return spark.createDataFrame([(name, "T", time, summary, ["f", summary], "3", error) for name, time, summary, error in rows], REPORT)


def saved(spark, path):
    return {r.report_file: (r.document_summary, r.key_security_findings, r.people_count_num) for r in stored_reports(spark, path).collect()}


def test_reports_are_replaced_by_name(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert saved(spark, path) == {}
    save_reports(reports(spark, *((f"f{i}.pdf", "2025-01-01", f"first {i}", None) for i in range(40))), path, buckets=4)
    save_reports(reports(spark, ("f3.docx", "2025-01-02", "new", None), ("f5.pdf", None, "older time, saved later", None), ("g.pdf", None, "more", None), ("f7.pdf", None, "broken", "no model")), path, buckets=4)
    want = {f"f{i}_analysis.json": (f"first {i}", ["f", f"first {i}"], 3) for i in range(40)}
    want |= {f"{n}_analysis.json": (s, ["f", s], 3) for n, s in (("f3", "new"), ("f5", "older time, saved later"), ("g", "more"))}
    assert saved(spark, path) == want
    for _ in range(2):
        save_reports(reports(spark, ("g.pdf", None, "more", None)), path, buckets=4)
    save_reports(reports(spark).limit(0), path, buckets=4)
    assert saved(spark, path) == want and stored_reports(spark, path).count() == len(want)


def entries(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("b", F.col("t"))
    return audit.audit_entries(redact(df, "t", log=True), "t_log", "concat('f', i)", "b")


def test_audit_entries_are_kept_once(spark, tmp_path):
    path = f"{tmp_path}/audit"
    assert audit.audit_table(spark, path).count() == 0
    first = entries(spark, ["a@b.org and a@b.org", "10.0.0.1", "nothing"])
    audit.append_audit_once(first, path)
    assert spark.read.parquet(path).count() == 3
    audit.append_audit_once(first, path)
    assert spark.read.parquet(path).count() == 3
    # A changed file has entries of its own; an unchanged one adds none.
    audit.append_audit_once(entries(spark, ["a@b.org and a@b.org", "10.0.0.2 or 10.0.0.3"]), path)
    assert spark.read.parquet(path).count() == 5
    # Another writer that looked before the first one was done.
    first.select("entry_key", *audit.AUDIT_COLUMNS).write.mode("append").parquet(path)
    rows = audit.audit_table(spark, path).collect()
    assert len(rows) == 5 and sorted(r.file_name for r in rows) == ["f0", "f0", "f1", "f1", "f1"]


def test_audit_as_one_csv(spark, tmp_path):
    rows = [("2025-01-01 00:00:00", 'a "b", c', "x...y", "<email>", "Regex"), ("2025-01-01 00:00:00", "f", "**", "<a>", None), ("2024-01-01 00:00:00", "two\nlines", "", "<a>", "Keyword: x")]
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in audit.AUDIT_COLUMNS)).repartition(3)
    lines = [r.line for r in audit.audit_csv(table).orderBy("number").collect()]
    read = list(csv.reader(io.StringIO("\n".join(lines) + "\n")))
    assert read[0] == list(audit.AUDIT_COLUMNS) and lines.count(lines[0]) == 1
    assert [tuple(r) for r in read[1:]] == sorted(tuple(v or "" for v in r) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 10, 11, 250])
def test_aligned_lines_equal_the_usual_rendering(spark, n):
    rng = random.Random(n)
    rows = [(i, "".join(rng.choices("abé ", k=rng.randrange(12))).strip() or "-", rng.choice(["x", "longer"])) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, `a name` string, c string")
    texts = df.select(F.col("k").cast("string").alias("k"), "a name", "c")
    lines = aligned_lines(df.repartition(5), ["k"]).orderBy("number").collect()
    assert [r.number for r in lines] == list(range(n + 1))
    if n:
        frame = pd.DataFrame([tuple(r) for r in texts.orderBy(F.col("k").cast("long")).collect()], columns=texts.columns)
        assert "\n".join(r.line for r in lines) == frame.to_string()


def test_missing_cells(spark):
    df = spark.createDataFrame([(1, None, 2.5), (2, "b", None)], "k int, t string, x double")
    assert [r.line for r in aligned_lines(df, ["k"]).orderBy("number").collect()] == ["   k    t    x", "0  1  NaN  2.5", "1  2    b  NaN"]


@pytest.fixture
def many_parts(spark):
    """Small parts are not put together, as those of large tables would not be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_of_groups_over_many_parts(spark, many_parts):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, null, id % 2) AS k", "id * 7919 % 20011 AS v", "id").repartition(6)
    ordered = written(placed(df, [F.col("k"), F.col("v"), F.col("id")]))
    assert ordered.select("__part").distinct().count() > 1
    rows = numbered(ordered, ["k"], "n").collect()
    for k in (None, 0, 1):
        mine = sorted((r.v, r.id, r.n) for r in rows if r.k == k)
        assert [n for *_, n in mine] == list(range(1, len(mine) + 1))
    every = numbered(ordered, [], "n").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(every) == (1, 20_000, 20_000)


def test_running_totals(spark, many_parts):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None, "b"]), p, rng.randrange(100)) for p in range(3000)]
    df = spark.createDataFrame(rows, "k string, p long, v long").repartition(4)
    got = {(r.k, r.p): r.s for r in running_total(df, ["k"], "p", "v", "s", stretch=64).collect()}
    totals: dict = {}
    for k, p, v in rows:
        assert got[k, p] == totals.get(k, 0)
        totals[k] = totals.get(k, 0) + v


def test_a_large_sheet_is_many_tasks_work(spark, many_parts):
    rows = spark.range(300_000).selectExpr("'f' AS f", "id % 7 DIV 6 AS s", "'x' AS sheet", "id AS r", "concat('row ', id) AS line")
    lines = workbook_lines(rows, "f", "s", "sheet", "r", "line").cache()
    assert lines.groupBy(F.spark_partition_id()).count().count() >= 4
    assert tuple(lines.agg(F.min("number"), F.max("number"), F.countDistinct("number")).first()) == (0, 300_003, 300_004)
    assert lines.where("line = 'row 6'").first().number == lines.where("line LIKE '--- Sheet%' AND number > 0").first().number + 1


def test_code_of_wide_tables_compiles(spark):
    """The session has ``spark.sql.codegen.fallback`` off, so code beyond the limit fails."""
    df = spark.createDataFrame([tuple(f"call 98765 4321{i} a@b.org" for i in range(8))], ", ".join(f"c{i} string" for i in range(8)))
    one = redact(df.select("c0"), "c0").first().c0
    assert redact(df, df.columns).first().c0 == one
