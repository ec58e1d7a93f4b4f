"""From cleansed texts to prompts, from responses to reports, and to one table.

The model call itself is outside: prompts go out as a table and responses come
back as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.sql import Sql, fenced, replace_all, string
from inkveil.functions.text import strip
from inkveil.rules import reports as texts
from inkveil.rules.reports import REPORT_FIELDS, PromptTemplates
from inkveil.sources.files import stem


def _report(**fields: Sql) -> Sql:
    """A report struct with the given fields; the others are null."""
    return (
        "named_struct("
        + ", ".join(
            f"'{field}', CAST({fields.get(field, 'null')} AS {kind})"
            for field, kind in REPORT_FIELDS.items()
        )
        + ")"
    )


REPORT_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in REPORT_FIELDS.items()) + ">"


def is_blank(text: Sql, is_image: Sql) -> Sql:
    """Nothing to analyse: no text at all, only blanks, or the marker for that.  Images always go."""
    return (
        f"(NOT {is_image} AND coalesce({strip(text)}, '') IN ('', {string(texts.NO_TEXT)}))"
    )


def blank_report(file_name: Sql, file_type: Sql) -> Sql:
    return _report(
        document_summary=string(texts.BLANK_SUMMARY),
        key_security_findings=f"array({string(texts.BLANK_FINDING)})",
        source_file_name=file_name,
        source_file_type=file_type,
    )


def prompt(
    file_name: Sql,
    file_type: Sql,
    is_image: Sql,
    text: Sql,
    templates: PromptTemplates = PromptTemplates(),
) -> Sql:
    """The prompt for one file; the text is cut to what a prompt may hold."""
    places = {
        "{file_name}": file_name,
        "{file_type}": file_type,
        "{text}": f"left({text}, {texts.PROMPT_CHARACTERS})",
    }

    def fill(template: str) -> Sql:
        pieces = [template]
        for place in places:
            pieces = [p for piece in pieces for p in _around(piece, place)]
        return "concat(" + ", ".join(places.get(p) or string(p) for p in pieces if p) + ")"

    return f"if({is_image}, {fill(templates.image)}, {fill(templates.text)})"


def _around(piece: str, place: str) -> list[str]:
    """The piece cut at each occurrence of the place, which stays as its own piece."""
    out: list[str] = []
    for n, part in enumerate(piece.split(place)):
        out += [place, part] if n else [part]
    return out


def build_prompts(
    files: DataFrame, templates: PromptTemplates = PromptTemplates()
) -> DataFrame:
    """Prompt rows of the files that have something to analyse."""
    made = prompt("file_name", "file_type", "is_image", "coalesce(text, '')", templates)
    return files.where(f"NOT {is_blank('text', 'is_image')}").selectExpr(
        "file_name", "file_type", "is_image", f"{made} AS prompt"
    )


# ------------------------------------------------------------------ responses


def _get(field: str, kind: str, value: str = "data") -> Sql:
    return f"try_variant_get({value}, '$.{field}', '{kind}')"


def _list(field: str) -> Sql:
    """A list of strings; a single value becomes a list of one."""
    items = f"transform({_get(field, 'array<variant>')}, v -> {_as_text('v')})"
    return f"coalesce({items}, array_compact(array({_as_text(_get(field, 'variant'))})))"


def _as_text(value: Sql) -> Sql:
    return (
        f"if(is_variant_null({value}), null,"
        f" coalesce(try_variant_get({value}, '$', 'string'), to_json({value})))"
    )


def _present(field: str, value: Sql, otherwise: Sql) -> Sql:
    """The value of a field, or a default only where the field is missing."""
    return f"if({_get(field, 'variant')} IS NULL, {otherwise}, {value})"


def _typed_fields() -> dict[str, Sql]:
    """All fields of a report, read from the variant column ``data``."""
    out = {}
    for field, kind in REPORT_FIELDS.items():
        if kind == "array<string>":
            out[field] = f"if({_get(field, 'variant')} IS NULL, null, {_list(field)})"
        elif kind == "string":
            out[field] = _as_text(_get(field, "variant"))
        else:
            out[field] = _get(field, kind)
    known = ", ".join(string(field) for field in REPORT_FIELDS)
    others = f"map_filter({_get_all('map<string,variant>')}, (k, v) -> k NOT IN ({known}))"
    out["other_fields"] = f"coalesce({out['other_fields']}, nullif(to_json({others}), '{{}}'))"
    return out


def _get_all(kind: str) -> Sql:
    return f"try_variant_get(data, '$', '{kind}')"


def _parsed(df: DataFrame, text: Sql) -> DataFrame:
    """``df`` with the variant column ``data``, null where the text is no JSON.

    Of a repeated key the last one counts, for which Spark has a session option
    that is switched on here.  NaN and the infinities, which JSON does not have
    but models write, become text.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    quoted = replace_all(text, r"([:,\[]\s*)(NaN|-?Infinity)(?=\s*[,}\]])", '$1"$2"')
    return df.withColumn("data", F.expr(f"coalesce(try_parse_json({text}), try_parse_json({quoted}))"))


def parse_reports(df: DataFrame, column: str) -> DataFrame:
    """Read report objects from JSON text; ``readable`` is false for broken ones.

    The fields drift between reports: a count may be a number, digits or prose,
    a list may be a single value.  ``people_count_num`` has the leading digits.
    Fields that are not known are kept in ``other_fields``.
    """
    data = _parsed(df, column)
    kept = [c for c in df.columns if c != column]
    fields = {
        "readable": "coalesce(startswith(schema_of_variant(data), 'OBJECT'), false)",
        **_typed_fields(),
    }
    leading = f"nullif(regexp_extract(people_count, {string(r'^[0-9]+')}, 0), '')"
    return data.selectExpr(*kept, fenced(fields)).withColumn(
        "people_count_num", F.expr(f"try_cast({leading} AS bigint)")
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Report rows from model responses.

    Takes ``file_name, file_type, model_used, analysis_timestamp, response`` and
    an optional ``error`` of the call; gives one row per response with the
    fields of a report and the branch that was taken.
    """
    error = "error" if "error" in responses.columns else "string(null)"
    cut = responses.selectExpr(
        "file_name", "file_type", "model_used", "analysis_timestamp", "response",
        f"coalesce({error}, if(coalesce(response, '') = '', {string(texts.EMPTY_RESPONSE)}, null))"
        " AS failure",
        f"{strip('response')} AS answer",
    ).withColumn("braced", F.expr(f"regexp_extract(answer, {string(r'(?s)\{.*\}')}, 0)"))
    parsed = _parsed(cut, "nullif(braced, '')")
    fields = _typed_fields()
    fields["document_summary"] = _present(
        "document_summary", fields["document_summary"], string(texts.MISSING_SUMMARY)
    )
    fields["key_security_findings"] = _present(
        "key_security_findings",
        fields["key_security_findings"],
        f"array({string(texts.MISSING_FINDING)})",
    )
    about = {"source_file_name": "file_name", "source_file_type": "file_type"}
    by = {**about, "model_used": "model_used"}
    start = f"left(answer, {texts.SUMMARY_CHARACTERS})"
    branches: dict[str, dict[str, Sql]] = {
        "failed": {**about, "error": final_error("failure", "file_name")},
        "unstructured": {
            **by,
            "document_summary": f"concat({string(texts.UNSTRUCTURED_SUMMARY)}, file_type, ': ',"
            f" if(answer = '', {string(texts.UNSTRUCTURED_EMPTY)}, {start}))",
            "key_security_findings": f"array({string(texts.UNSTRUCTURED_FINDING)},"
            f" concat({string(texts.RAW_LENGTH[0])}, char_length(answer), {string(texts.RAW_LENGTH[1])}))",
            "raw_analysis": f"nullif(left(answer, {texts.RAW_ANALYSIS_CHARACTERS}), '')",
        },
        "broken": {
            **by,
            "document_summary": string(texts.BROKEN_SUMMARY),
            "key_security_findings":
                f"array({string(texts.BROKEN_FINDING + texts.BROKEN_CAUSE)})",
            "raw_response": f"left(response, {texts.RAW_RESPONSE_CHARACTERS})",
        },
        "structured": {**fields, **by, "analysis_timestamp": "analysis_timestamp"},
    }
    branch = (
        "CASE WHEN failure IS NOT NULL THEN 'failed' WHEN braced = '' THEN 'unstructured'"
        " WHEN data IS NULL THEN 'broken' ELSE 'structured' END"
    )

    def chosen(field: str, kind: str) -> Sql:
        cases = " ".join(
            f"WHEN '{b}' THEN {values[field]}" for b, values in branches.items() if field in values
        )
        return f"CAST({f'CASE branch {cases} END' if cases else 'null'} AS {kind})"

    return parsed.withColumn("branch", F.expr(branch)).selectExpr(
        "branch", fenced({field: chosen(field, kind) for field, kind in REPORT_FIELDS.items()})
    )


def error_class(message: Sql) -> Sql:
    """What to do about a failed call: wait and retry, give up, or retry and then fail."""
    low = f"lower({message})"
    return (
        f"CASE WHEN contains({message}, '429') OR contains({low}, 'quota')"
        f" OR contains({low}, 'rate limit') THEN 'rate_limit'"
        f" WHEN contains({low}, 'api key') OR contains({low}, 'unauthorized') THEN 'fatal'"
        f" WHEN {message} IS NOT NULL THEN 'retry' END"
    )


def final_error(message: Sql, file_name: Sql) -> Sql:
    """Error text of the report once all attempts have failed."""
    return (
        f"CASE {error_class(message)}"
        f" WHEN 'rate_limit' THEN concat({string(texts.ALL_RETRIES_FAILED[0])}, {file_name},"
        f" {string(texts.ALL_RETRIES_FAILED[1])})"
        f" WHEN 'fatal' THEN {string(texts.KEY_ERROR)}"
        f" WHEN 'retry' THEN concat({string(texts.ANALYSIS_FAILED)}, {message}) END"
    )


# --------------------------------------------------------------- compilation


def report_file(file_name: Sql) -> Sql:
    return f"concat({stem(file_name)}, '_analysis.json')"


def latest_reports(reports: DataFrame) -> DataFrame:
    """One report per report file: the latest, then the last file name.

    Reports with an error are not kept.  Where time and name are equal the other
    fields decide, in their order, so the result does not depend on partitions.
    A maximum is taken in part before the shuffle, so a name shared by many
    reports stays cheap.
    """
    named = reports.where("error IS NULL").withColumn(
        "report_file", F.expr(report_file("source_file_name"))
    )
    first = ["analysis_timestamp", "source_file_name"]
    rest = [c for c in reports.columns if c not in first and c != "error"]
    age = F.coalesce("analysis_timestamp", F.lit("")).alias("age")
    newest = named.groupBy("report_file").agg(
        F.max(F.struct(age, "source_file_name", *rest, "analysis_timestamp", "error")).alias("report")
    )
    return newest.select("report_file", *(F.col("report")[c].alias(c) for c in reports.columns))


def consolidated(reports: DataFrame, order: str = "report_file") -> DataFrame:
    """The four columns of the final report, in order of the report files."""
    return reports.orderBy(order).select(
        F.coalesce("source_file_name", F.lit(texts.NOT_AVAILABLE)).alias("File Name"),
        F.coalesce("source_file_type", F.lit(texts.NOT_AVAILABLE)).alias("File Type"),
        F.coalesce("document_summary", F.lit(texts.NO_SUMMARY)).alias("File Description"),
        F.coalesce("key_security_findings", F.array(F.lit(texts.NO_FINDINGS))).alias(
            "Key Security Findings"
        ),
    )


def headline(reports: DataFrame) -> DataFrame:
    """The sentence above the table; broken report files count too."""
    return reports.agg(
        F.format_string(texts.HEADLINE, F.count("*")).alias("headline")
    )
