"""Running totals and row numbers of groups of any size.

A window over a group is one task's work.  Here a group is cut into stretches
that many tasks share: each stretch adds up its rows, the totals of the
stretches, which are few, are added up in order, and every row gets what lies
before its stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.functions.sql import name

#: Places of a group that are added up together.
STRETCH = 4096


def running_total(
    df: DataFrame, keys: Sequence[str], place: str, value: str, before: str, stretch: int = STRETCH
) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the group's rows at lesser places.

    ``place`` is a whole number that occurs once in a group.  A stretch holds
    ``stretch`` places, so the totals of a group are so many times fewer.
    """
    part, own, earlier = "__part", "__own", "__earlier"
    parts = df.withColumn(part, F.expr(f"{name(place)} DIV {stretch}"))
    at = [F.col(name(k)) for k in keys]
    totals = parts.groupBy(*at, part).agg(F.sum(name(value)).alias(own))
    up_to = Window.partitionBy(*at).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(earlier, F.coalesce(F.sum(own).over(up_to), F.lit(0))).drop(own)
    inside = Window.partitionBy(*at, part).orderBy(name(place)).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn(own, F.coalesce(F.sum(name(value)).over(inside), F.lit(0)))
    met = _joined(summed, totals, [*keys, part])
    return met.withColumn(before, F.col(earlier) + F.col(own)).drop(part, own, earlier)


def placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in order over all partitions, with ``__part`` (rising) and ``__at`` (rising within a part).

    Parts are ranges of the order, sampled by Spark, so they are about equally
    large whatever the keys are.  The result is to be written before it is read
    twice, as another run may cut elsewhere.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spot = F.monotonically_increasing_id()
    return ordered.withColumn("__at", spot).withColumn("__part", F.shiftright("__at", 33))


def numbered(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Rows of ``placed`` (written, its order led by the keys) with their number in the group, from 1.

    What is added up is one line per group and part; without keys all rows are
    one group.
    """
    at = [F.col(name(k)) for k in keys]
    lines = df.groupBy(*at, "__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    up_to = Window.partitionBy(*at).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("__earlier", F.coalesce(F.sum("__rows").over(up_to), F.lit(0))).drop("__rows")
    met = _joined(df, lines, [*keys, "__part"])
    own = F.col("__at") - F.col("__first") + 1 + F.col("__earlier")
    return met.withColumn(number, own).drop("__part", "__at", "__first", "__earlier")


def _joined(df: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal keys meet, null ones too."""
    renamed = lines.select(
        *[F.col(name(k)).alias(f"__key_{n}") for n, k in enumerate(keys)],
        *[c for c in lines.columns if c not in keys],
    )
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(name(k)).eqNullSafe(F.col(f"__key_{n}"))
    return df.join(renamed, same).drop(*[f"__key_{n}" for n in range(len(keys))])
