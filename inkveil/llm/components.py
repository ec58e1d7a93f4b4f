"""Connected components of a graph that is a table of edges.

Large-star and small-star steps by turns: every node hangs its larger, then its
smaller neighbours on the least node it knows.  Minima are found by aggregation
before anything is joined, so a node with very many neighbours is no single
task's work, and every round is a written table, so a lost executor does not
bring back earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of the component.

    Loops count for nothing, repeated edges once; without edges no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = written(pairs.filter("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("m"))
        large = now.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        both = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(both.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
