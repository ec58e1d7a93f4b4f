"""The corpus run as a stream: every new text once, and its audit rows with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inkveil.functions.sql import Sql, name
from inkveil.operators.audit import masked_log
from inkveil.operators.redact import ALL_PHASES, redact
from inkveil.rules import DEFAULT_RULES, RuleSet


def write_redacted(
    texts: DataFrame,
    column: str,
    file_name: Sql,
    target: str,
    audit: str,
    rules: RuleSet = DEFAULT_RULES,
    phases: tuple[str, ...] = ALL_PHASES,
) -> None:
    """Write the redacted texts, then the audit rows from what was written.

    The cascade runs once.  Only masked originals are written, and a repeated
    write replaces the first one.
    """
    done = redact(texts, column, rules, phases, log=True)
    log = name(column + "_log")
    done.selectExpr(
        f"* EXCEPT ({log})",
        f"{file_name} AS audit_file_name",
        "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss') AS redacted_at",
        f"{masked_log(log)} AS redactions",
    ).write.mode("overwrite").parquet(target)
    written = texts.sparkSession.read.parquet(target)
    written.selectExpr(
        "redacted_at AS timestamp", "audit_file_name AS file_name", "inline(redactions)"
    ).write.mode("overwrite").parquet(audit)


def redact_available(
    stream: DataFrame,
    column: str,
    file_name: Sql,
    target: str,
    audit: str,
    checkpoint: str,
    rules: RuleSet = DEFAULT_RULES,
) -> StreamingQuery:
    """Redact what has arrived since the last run, then stop.

    Each batch has its own directory under ``target`` and ``audit``, so a batch
    that is run again after a failure leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        part = f"batch={number}"
        write_redacted(batch, column, file_name, f"{target}/{part}", f"{audit}/{part}", rules)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
