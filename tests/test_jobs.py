"""Sources, sinks, entities, regions, reports and the stream, on small fixtures."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from inkveil.operators import reports as R
from inkveil.operators.audit import append_audit, audit_log
from inkveil.operators.cells import lines_to_text, redact_cells, workbook_lines
from inkveil.operators.entities import (
    redact_entities, redact_entity_arrays, redact_with_entities, redact_with_entity_arrays, telling_labels,
)
from inkveil.operators.redact import redact
from inkveil.operators.regions import span_boxes, word_boxes
from inkveil.operators.tokens import drop_whitelisted
from inkveil.plans.redaction import spans_of, tagged as tag_texts
from inkveil.rules import DEFAULT_RULES, PatternRule, RuleSet
from inkveil.rules.files import CLEANSERS, FILE_LABELS
from inkveil.sources.files import (
    accepted, list_files, read_table, read_whitelist, route, scan_files, skipped, stem, stream_files, write_table,
)
from inkveil.sources.reports import read_report_files, read_reports, write_reports
from inkveil.streaming.corpus import redact_available
from tests import twin
from tests.conftest import DATA


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rule_tables():
    assert len(DEFAULT_RULES.patterns) == 28
    assert len({r.tag for r in DEFAULT_RULES.patterns}) == 27
    assert len(DEFAULT_RULES.contexts) == 16
    assert len(DEFAULT_RULES.keyword_rows()) == 58
    assert sum(redacts for *_, redacts in DEFAULT_RULES.keyword_rows()) == 34
    assert len(DEFAULT_RULES.whitelist) == 54
    assert len(FILE_LABELS) == 12 and len(CLEANSERS) == 8


def test_listing_and_routing(spark, tmp_path):
    for file in ["a.PDF", "b.tar.gz", ".png", "c.csv", "d", "e."]:
        (tmp_path / file).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.csv").write_text("x")
    for file in ["_x.pdf", ".h.pdf"]:
        (tmp_path / file).write_text("x")
    (tmp_path / "none.pdf").write_text("")
    found = route(list_files(spark, str(tmp_path)))
    assert {r["file_name"] for r in found.collect()} == {
        "a.PDF", "b.tar.gz", "c.csv", "d", "e.", ".png", "_x.pdf", ".h.pdf", "none.pdf"
    }
    assert {r["file_name"] for r in found.where("hidden").collect()} == {
        ".png", "_x.pdf", ".h.pdf", "none.pdf"
    }
    assert {r["file_name"] for r in accepted(found).collect()} == {
        "a.PDF", "c.csv", "_x.pdf", ".h.pdf", "none.pdf"
    }
    assert {(r["file_name"], r["suffix"]) for r in skipped(found).collect()} == {
        ("b.tar.gz", ".gz"), ("d", ""), ("e.", ""), (".png", "")
    }
    names = spark.createDataFrame([("x/a.b.png",), (".png",), ("c",)], "n string")
    assert rows(names.selectExpr(stem("n"))) == [("a.b",), (".png",), ("c",)]


def test_scanned_and_streamed_files(spark, tmp_path):
    inbox = tmp_path / "in"
    (inbox / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "aa"), ("b.PDF", "bbb"), ("c d.csv", "x"), ("_hidden.txt", "h")):
        (inbox / name).write_text(text)
    (inbox / "sub" / "e.txt").write_text("eeee")
    found = scan_files(spark, str(inbox))
    assert sorted((r.file_name, r.length) for r in found.collect()) == [("a.txt", 2), ("b.PDF", 3), ("c d.csv", 1)]
    assert scan_files(spark, str(inbox), "*.txt", nested=True).count() == 2
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()

    def batch():
        query = (
            stream_files(spark, str(inbox)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
            .trigger(availableNow=True).start(f"{tmp_path}/out")
        )
        query.awaitTermination()
        return sorted(r.file_name for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert batch() == ["a.txt", "b.PDF", "c d.csv"]
    (inbox / "new.txt").write_text("n")
    assert batch() == ["a.txt", "b.PDF", "c d.csv", "new.txt"]


def test_tables_keep_their_spelling(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text('id,note,n\n007,"mail a@b.example.com\nnow",1.50\n8,,\n')
    table = read_table(spark, str(source), multi_line=True)
    done = redact_cells(table, keep=["id"], log=True)
    assert rows(done.select("id", "note", "n").orderBy("id")) == [
        ("007", "mail <email>\nnow", "1.50"), ("8", None, None)
    ]
    assert [len(r["note_log"]) for r in done.orderBy("id").collect()] == [1, 0]
    write_table(done.select("id", "note", "n"), str(tmp_path / "out"))
    assert sorted(rows(read_table(spark, str(tmp_path / "out"), multi_line=True)))[0][1] == "mail <email>\nnow"


def test_whitelist_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" Data \n\nsystem\nDATA\n")
    words = read_whitelist(spark, str(tmp_path / "w.txt"))
    assert sorted(rows(words)) == [("data",), ("system",)]
    tokens = spark.createDataFrame([("DATA",), ("x",)], "token string")
    assert rows(drop_whitelisted(tokens, words)) == [("x",)]


def test_custom_rules(spark):
    own = RuleSet(patterns=(PatternRule(1, "<no$1>", r"\bx[&\[y]+\b"),), contexts=(), keywords={})
    df = spark.createDataFrame([("ax xyy x&y <",)], "t string")
    assert rows(redact(df, "t", own)) == [("ax <no$1> <no$1> <",)]


def test_audit_rows_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f.txt", "call 9876543210\nSource: me")], "f string, t string")
    audit = audit_log(redact(df, "t", log=True), "t_log", "f")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        append_audit(audit, path, fmt)
        append_audit(audit, path, fmt)
        reader = spark.read.option("header", True).option("escape", '"')
        stored = reader.format(fmt).load(path)
        assert stored.columns == ["timestamp", "file_name", "masked_original", "redacted_to",
                                  "reason"]
        assert sorted(rows(stored.select("masked_original", "redacted_to", "reason"))) == [
            ("**", "<source>", "Contextual: 'Source:'"),
        ] * 2 + [("98...10", "<account_no>", "Regex")] * 2


SPANS = "doc_id long, start_char long, end_char long, label string, text string"


def test_entities(spark):
    text = "Ann Lee of ACME paid 5 in é Paris"
    spans = [
        (1, 0, 7, "PERSON", "Ann Lee"), (1, 0, 7, "PERSON", "Ann Lee"), (1, 4, 14, "ORG", "Lee of ACM"),
        (1, 11, 15, "ORG", "ACME"), (1, 21, 22, "CARDINAL", "5"), (1, 28, 33, "GPE", "Paris"),
        (1, 16, 20, "NORP", "paid"), (1, 30, 99, "LOC", "ris and on"), (2, 0, 3, "PERSON", "the"),
    ]
    df = spark.createDataFrame([(1, text), (2, "the end"), (3, "none")], "doc_id long, text string")
    tagged = spark.createDataFrame(spans, SPANS)
    got = redact_entities(df, "doc_id", "text", tagged, log=True).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [
        "<person> of <organization> paid 5 in é <location>", "the end", "none"
    ]
    assert [tuple(s) for s in got[0]["rejected_spans"]] == [(4, 14, "ORG"), (30, 99, "LOC")]
    assert [e["original"] for e in got[0]["entity_log"]] == ["Ann Lee", "ACME", "Paris"]
    arrays = tagged.groupBy("doc_id").agg(F.collect_list(F.struct("start_char", "end_char", "label", "text")).alias("s"))
    beside = redact_entity_arrays(df.join(arrays, "doc_id", "left"), "text", "s", log=True).orderBy("doc_id").collect()
    assert [(r.text, r.rejected_spans, r.entity_log) for r in beside] == [
        (r.text, r.rejected_spans, r.entity_log) for r in got
    ]


def test_many_overlapping_spans(spark):
    text = "ab " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    k = spark.range(100_000)
    spans = k.selectExpr("1L AS doc_id", "id % 59990 AS start_char", "id % 59990 + 2 + id % 7 AS end_char",
                         "if(id % 2 = 0, 'ORG', 'GPE') AS label", "'ab cd' AS text")
    rows_ = {(r.start_char, -r.end_char, r.label) for r in spans.collect()}
    done, out, want = 0, [], []
    for start, back, label in sorted(rows_):
        if start >= done:
            want.append((text[done:start], DEFAULT_RULES.entity_tags[label]))
            done = -back
    out = "".join(a + b for a, b in want) + text[done:]
    assert redact_entities(df, "doc_id", "text", spans).first().text == out
    arrays = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_char", "end_char", "label", "text")).alias("s"))
    assert redact_entity_arrays(df.join(arrays, "doc_id"), "text", "s").first().text == out


def test_entities_within_the_cascade(spark):
    df = spark.createDataFrame([(1, "Age: 41 Bob of Wipro, 10.0.0.1")], "doc_id long, text string")
    after_patterns = twin.pattern_phase(twin.context_phase("Age: 41 Bob of Wipro, 10.0.0.1"))
    at = after_patterns.index("Bob")
    spans = spark.createDataFrame([(1, at, at + 3, "PERSON", "Bob")], SPANS)
    (row,) = redact_with_entities(df, "doc_id", "text", spans, log=True).collect()
    assert row["text"] == "Age: <age> <person> of <company_name>, <ipv4>"
    assert [e["phase"] for e in row["text_log"]] == [1, 2, 3, 4]


def test_telling_labels(spark):
    spans = [
        (1, 5, 9, "ORG", "ACME"), (1, 0, 2, "CARDINAL", "12"), (2, 0, 3, "CARDINAL", "123"),
        (3, 0, 4, "DATE", "1985"), (4, 0, 4, "DATE", "1990"), (5, 0, 3, "NORP", "Xyz"),
    ]
    got = telling_labels(spark.createDataFrame(spans, SPANS), ["doc_id"])
    assert sorted(rows(got)) == [(1, "ORG"), (2, "CARDINAL"), (4, "DATE")]


def test_regions(spark):
    words = spark.createDataFrame(
        [("f", 0, " a@b.example.com ", 41, 7), ("f", 1, "a@b.example.com", 40, 8),
         ("f", 2, "10", 99, 9), ("f", 3, "plain", 99, 9), ("f", 4, "SBI!", 99, 5)],
        "file string, i int, text string, conf int, x int",
    )
    assert rows(word_boxes(words).orderBy("i")) == [
        ("f", 0, 7, "a...@b...com", "<visual_regex_pattern_<email>>", "Image OCR"),
        ("f", 4, 5, "S**!", "<visual_keyword_banks_SBI>", "Image OCR"),
    ]
    spans = spark.createDataFrame([(1, "no"), (2, "at HDFC now")], "box int, text string")
    assert rows(span_boxes(spans)) == [(2,)]


def test_whole_texts_of_lines(spark):
    lines = spark.createDataFrame(
        [("a", n, "x" * n) for n in range(300)] + [("b", 1, "y" * 30_000), ("b", 20_000, "z"), ("c", 5, "")],
        "file string, n long, line string",
    ).repartition(4)
    got = dict(rows(lines_to_text(lines, "file", "n", "line")))
    assert got == {"a": "".join("x" * n + "\n" for n in range(300)), "b": "y" * 30_000 + "\nz\n", "c": "\n"}


def test_sheets_whose_rows_are_numbered_anyhow(spark):
    cells = [("f", 3, "late", 9, "c"), ("f", 1, "one", 1, "a"), ("f", 1, "one", 20_000, "b"), ("g", 0, "x", 7, "d")]
    sheets = spark.createDataFrame(cells, "file string, s int, sheet string, r int, line string")
    got = sorted(rows(workbook_lines(sheets, "file", "s", "sheet", "r", "line")))
    assert got == [("f", 0, "--- Sheet: one ---"), ("f", 1, "a"), ("f", 2, "b"), ("f", 3, ""), ("f", 4, "--- Sheet: late ---"),
                   ("f", 5, "c"), ("f", 6, ""), ("g", 0, "--- Sheet: x ---"), ("g", 1, "d"), ("g", 2, "")]


def test_numbers_need_no_rules_with_letters(spark):
    values = [4111111111111111, 12, 123456, -9876543210, 912345678901]
    cells = spark.createDataFrame([(v, str(v)) for v in values], "n long, t string")
    assert all(r["n"] == r["t"] for r in redact_cells(cells).collect())
    draw = random.Random(3)
    texts = ["".join(draw.choices("0123456789.-+", k=draw.randrange(1, 24))) for _ in range(2000)]
    numbers = spark.createDataFrame([(t,) for t in texts], "t string")
    few = redact(numbers, "t", DEFAULT_RULES.without_letters(), phases=("pattern",))
    assert rows(few) == rows(redact(numbers, "t", phases=("pattern",)))


def test_packed_cells_equal_single_ones(spark):
    draw = random.Random(5)
    def number():
        return draw.choice([None, draw.randrange(10**draw.randrange(1, 18)), -draw.randrange(10**12)])
    made = [(number(), number(), number(), "x") for _ in range(3000)]
    cells = spark.createDataFrame(made, "a long, b long, c long, t string").withColumn("d", F.expr("date_add('2024-01-01', cast(coalesce(a, 1) % 900 as int))"))
    together = redact_cells(cells).collect()
    for column in "abcd":
        alone = redact_cells(cells.select(column)).collect()
        assert [r[column] for r in together] == [r[column] for r in alone]
    texts = cells.select(*(F.col(c).cast("string").alias(c) for c in "abcd"))
    assert [r["a"] for r in redact(texts, list("abcd")).collect()] == [r["a"] for r in together]


def test_latest_report_does_not_depend_on_partitions(spark):
    made = [(f"a.{k % 2}", "2025-01-01 00:00:00" if k % 3 else None, f"s{k % 5}", None) for k in range(60)]
    schema = "source_file_name string, analysis_timestamp string, document_summary string, error string"
    reports = spark.createDataFrame(made, schema)
    got = [rows(R.latest_reports(reports.repartition(n))) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and got[0][0][3] == "s4"


REPORTS = {
    "image": {"document_summary": "Indoor", "key_security_findings": ["a", "b"], "people_count": 1,
              "redacted_content_noted": True, "source_file_name": "image.png",
              "source_file_type": "PNG Image", "analysis_timestamp": "2025-01-01 00:00:00"},
    "doc": {"document_summary": "Sheet", "key_security_findings": ["c"], "model_used": "m",
            "compliance_frameworks_referenced": [], "source_file_name": "doc.xlsx",
            "source_file_type": "Excel Spreadsheet"},
    "blank": {"document_summary": "Blank", "key_security_findings": "one",
              "source_file_name": "blank.pdf", "source_file_type": "PDF Document"},
    "mixed": {"people_count": "12 (seen)", "extra": {"x": 1}},
}


def test_report_files(spark, tmp_path):
    for stem_, report in REPORTS.items():
        (tmp_path / f"{stem_}_analysis.json").write_text(json.dumps(report, indent=4))
    (tmp_path / "bad_analysis.json").write_text('{"document_summary": ')
    (tmp_path / "other.json").write_text("{}")
    loaded = read_report_files(spark, str(tmp_path))
    by = {r["report_file"]: r for r in loaded.collect()}
    assert len(by) == 5 and not by["bad_analysis.json"]["readable"]
    assert (by["image_analysis.json"]["people_count"], by["image_analysis.json"]["people_count_num"]) == ("1", 1)
    assert (by["mixed_analysis.json"]["people_count"], by["mixed_analysis.json"]["people_count_num"]) == ("12 (seen)", 12)
    assert by["blank_analysis.json"]["key_security_findings"] == ["one"]
    assert by["doc_analysis.json"]["compliance_frameworks_referenced"] == []
    assert R.headline(loaded).first()[0].endswith("analysis of 5 processed files.")
    final = R.consolidated(loaded.where("readable"))
    assert rows(final) == [
        ("blank.pdf", "PDF Document", "Blank", ["one"]),
        ("doc.xlsx", "Excel Spreadsheet", "Sheet", ["c"]),
        ("image.png", "PNG Image", "Indoor", ["a", "b"]),
        ("N/A", "N/A", "No summary provided.", ["No findings reported."]),
    ]
    write_reports(loaded.where("readable"), str(tmp_path / "out"))
    again = read_reports(spark, str(tmp_path / "out"))
    assert sorted(rows(again.select("report_file", "document_summary"))) == sorted(
        rows(loaded.where("readable").select("report_file", "document_summary"))
    )


def test_responses_that_are_not_quite_json(spark):
    answers = ['{"document_summary": "a", "document_summary": "b", "x": {"y": NaN}}', '{"people_count": NaN, "list": [Infinity, -Infinity]}', '{"document_summary": NaN,, }']
    made = spark.createDataFrame([(str(i), "PDF", "m", "t", a) for i, a in enumerate(answers)],
                                 "file_name string, file_type string, model_used string, analysis_timestamp string, response string")
    got = R.parse_responses(made).orderBy("source_file_name").collect()
    assert [r.branch for r in got] == ["structured", "structured", "broken"]
    assert (got[0].document_summary, got[0].other_fields) == ("b", '{"x":{"y":"NaN"}}')
    assert (got[1].people_count, got[1].other_fields) == ("NaN", '{"list":["Infinity","-Infinity"]}')


def test_unknown_fields_survive_writing(spark, tmp_path):
    (tmp_path / "a_analysis.json").write_text('{"document_summary": "s", "more": [1, "x"]}')
    loaded = read_report_files(spark, str(tmp_path))
    write_reports(loaded, str(tmp_path / "out"))
    for df in (loaded, read_reports(spark, str(tmp_path / "out"))):
        assert df.first().other_fields in ('{"more":[1,"x"]}',)


def test_latest_report_per_stem(spark):
    made = spark.createDataFrame(
        [("a.png", "2025-01-01 00:00:00", "old", None), ("a.pdf", "2025-01-02 00:00:00", "new", None),
         ("a.gif", "2025-01-03 00:00:00", None, "failed"), ("b.pdf", None, "blank", None)],
        "source_file_name string, analysis_timestamp string, document_summary string, error string",
    )
    got = R.latest_reports(made).select("report_file", "document_summary")
    assert sorted(rows(got)) == [("a_analysis.json", "new"), ("b_analysis.json", "blank")]


def test_stream_equals_batch_and_sees_each_text_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "file string, t string"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        redact_available(stream, "t", "file", target, str(tmp_path / "audit"),
                         str(tmp_path / "checkpoint")).awaitTermination()

    first = spark.createDataFrame([("a", "HDFC 10.0.0.1"), ("b", "plain")], schema)
    first.write.parquet(source)
    run()
    spark.createDataFrame([("c", "Source: x")], schema).write.mode("append").parquet(source)
    run()
    done = spark.read.parquet(target)
    assert sorted(rows(done.select("file", "t"))) == [
        ("a", "<bank> <ipv4>"), ("b", "plain"), ("c", "Source: <source>")
    ]
    audit = spark.read.parquet(str(tmp_path / "audit"))
    assert sorted(rows(audit.select("file_name", "masked_original", "redacted_to"))) == [
        ("a", "10....1", "<ipv4>"), ("a", "H**C", "<bank>"), ("c", "*", "<source>")
    ]


def test_redaction_needs_no_shuffle(spark):
    df = spark.range(10).withColumn("t", F.lit("x 10.0.0.1"))
    plan = redact(df, "t", log=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_cascade_with_tagger_equals_twin_on_documents(spark):
    texts = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text")
    after = redact(texts, "text", phases=("context", "pattern"))
    tagged = spans_of(after)
    found = {}
    for span in tagged.collect():
        found.setdefault(span["doc_id"], []).append(span)
    got = dict(rows(redact_with_entities(texts, "doc_id", "text", tagged)))
    for doc_id, text in rows(texts):
        want = twin.redact(text, phases=("context", "pattern"))
        for span in sorted(found.get(doc_id, []), key=lambda s: -s["start_char"]):
            hit = want[span["start_char"]:span["end_char"]]
            assert hit == span["text"]
            tag = DEFAULT_RULES.entity_tags.get(span["label"])
            person = span["label"] != "PERSON" or (
                len(hit) >= 3 and hit.lower() not in ("the", "and", "for")
            )
            if tag and "<" not in hit and not twin.whitelisted(hit) and person:
                want = want[:span["start_char"]] + tag + want[span["end_char"]:]
        if len(text.strip()) >= 3:
            want = twin.merge(twin.keyword_phase(want))
        assert got[doc_id] == want
    beside = redact_with_entity_arrays(texts, "text", tag_texts)
    assert dict(rows(beside.select("doc_id", "text"))) == got
