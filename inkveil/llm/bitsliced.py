"""Exact top-k by inner product on a bit-sliced index.

Candidates are dealt into blocks of equal size.  A block keeps, for each
dimension and bit, one bitmap over its rows.  A query's score of all rows of a
block at once is a sum of such bitmaps, added with full adders; the result is
again a number in slices, from which the best rows are taken by going from the
most significant slice downward.  Rows that tie on the boundary are settled by
their id.  Queries meet the candidates block by block, and only k rows per
query leave a group of blocks.

Defined cases: vectors that are null, or hold a null or a non-finite component,
take no part, nor do rows without an id; vectors of other lengths are filled up
with zeros; quantised components beyond +-2**62, and scores among a query's best
that a long cannot hold, are an error.  Rows with the query's id count as its own row.  A query that is there twice is
answered twice.  With fewer than k candidates all are returned; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import small_batches, table
from inkveil.llm.vectors import best, gathered, usable, widened

SCALE, K, QUERY_EVERY = 64, 20, 20
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
LARGEST, LONG = 2**62, 2**63 - 1
_BLOCK = "block int, width int, bits int, least long, ids binary, slices binary"
_QUERIES = "part int, q_width int, q_ids binary, q_values binary"
_FOUND = "uid long, query_id long, vec_id long, score long"


def quantised(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if len(out) and np.abs(out).max(initial=0) > LARGEST:
        raise ValueError(f"components of more than {LARGEST / scale:g} have no scores that fit a long")
    return out.astype(np.int64)


def sliced(values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The least value, the number of bits, and bitmaps (dimension, bit, words) of values (rows, dimensions)."""
    rows, width = values.shape
    least = int(values.min(initial=0))
    bits = int(values.max(initial=0) - least).bit_length()
    words = (rows + 63) // 64
    out = np.zeros((width, bits, words * 8), np.uint8)
    shifted = (values - least).T
    for bit in range(bits):
        packed = np.packbits((shifted >> bit & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, bit, : packed.shape[1]] = packed
    return least, bits, out.view(np.uint64)


def added(levels: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The slices of a sum of bitmaps; ``levels[w]`` holds arrays of bitmaps of weight 2**w."""
    out, w = [], 0
    while levels:
        x = levels.pop(w, None)
        if x is None:
            out.append(None)
            w += 1
            continue
        x = np.concatenate(x) if len(x) > 1 else x[0]
        while len(x) > 1:
            third = max(1, len(x) // 3)
            a, b = x[:third], x[third : 2 * third]
            rest = x[2 * third :]
            half = a ^ b
            if len(rest) >= third:
                c, rest = rest[:third], rest[third:]
                carry, total = a & b | half & c, half ^ c
            else:  # two are left
                carry, total = a & b, half
            levels.setdefault(w + 1, []).append(carry)
            x = np.concatenate((total, rest)) if len(rest) else total
        out.append(x[0])
        w += 1
    return out


def top_rows(total: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of rows surely among the k highest, and of those that tie for the places left."""
    sure, tied = np.zeros_like(among), among.copy()
    if int(np.bitwise_count(among).sum()) <= k:
        return tied, sure
    for piece in reversed(total):
        if piece is None:
            continue
        some = sure | tied & piece
        n = int(np.bitwise_count(some).sum())
        if n > k:
            tied &= piece
        else:
            sure = some
            tied &= ~piece
            if n == k:
                return sure, np.zeros_like(tied)
    return sure, tied


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """Candidates in order of their ids, with their slices and the slices' complements."""

    def __init__(self, ids: np.ndarray, width: int, bits: int, least: int, slices: np.ndarray) -> None:
        self.ids, self.width, self.bits, self.least = ids, width, bits, least
        words = (len(ids) + 63) // 64
        plain = slices.reshape(width, bits, words)
        self.both = np.stack((plain, ~plain))
        every = np.zeros(words * 64, np.uint8)
        every[: len(ids)] = 1
        self.every = np.packbits(every, bitorder="little").view(np.uint64)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, ties to the smaller id."""
        size, negative = np.abs(query), (query < 0).astype(np.int64)
        levels: dict[int, list[np.ndarray]] = {}
        for i in range(int(size.max(initial=0)).bit_length()):
            dims = np.flatnonzero(size >> i & 1)
            if len(dims):
                picked = self.both[negative[dims], dims]
                for j in range(self.bits):
                    levels.setdefault(i + j, []).append(picked[:, j])
        total = added(levels)
        among = self.every.copy()
        for row in range(*np.searchsorted(self.ids, (own, own + 1)).tolist()):
            among[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sure, tied = top_rows(total, among, k)
        rows = rows_of(sure)
        rows = np.concatenate((rows, rows_of(tied)[: k - len(rows)]))
        at, bit = rows >> 6, (rows & 63).astype(np.uint64)
        base = self.least * sum(query.tolist()) - ((1 << self.bits) - 1) * sum(size[query < 0].tolist())
        # Sums that might leave 63 bits are Python's integers.
        exact = max(len(total), abs(base).bit_length()) > 61
        scores = np.full(len(rows), base, object if exact else np.int64)
        for w, piece in enumerate(total):
            if piece is not None:
                scores += (piece[at] >> bit & np.uint64(1)).astype(scores.dtype) << w
        if exact and any(not -LONG < s < LONG for s in scores.tolist()):
            raise ValueError("a score among the best does not fit a long")
        return rows, scores.astype(np.int64)


def _indexed(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = gathered(batches)
        if not len(ids):
            return
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], quantised(x[order], scale)
        least, bits, slices = sliced(values)
        yield pa.RecordBatch.from_pylist(
            [{"block": TaskContext.get().partitionId(), "width": x.shape[1], "bits": bits, "least": least,
              "ids": ids.tobytes(), "slices": slices.tobytes()}],
            pa.schema([("block", pa.int32()), ("width", pa.int32()), ("bits", pa.int32()), ("least", pa.int64()),
                       ("ids", pa.binary()), ("slices", pa.binary())]),
        )

    return run


def _packed_queries(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = gathered(batches)
        if len(ids):
            yield pa.RecordBatch.from_pylist(
                [{"part": TaskContext.get().partitionId(), "q_width": x.shape[1], "q_ids": ids.tobytes(),
                  "q_values": quantised(x, scale).tobytes()}],
                pa.schema([("part", pa.int32()), ("q_width", pa.int32()), ("q_ids", pa.binary()), ("q_values", pa.binary())]),
            )

    return run


def _searched(k: int):
    """Joined blocks and query parts to the k best of each query; parts of one key follow one another."""
    schema = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    worst = np.iinfo(np.int64).max

    def rows(key, held) -> pa.RecordBatch:
        ids, scores, found = held
        n = (scores != worst).sum(axis=1)
        uid = np.repeat(np.arange(len(ids)) + (key[0] << 32), n)
        some = scores != worst
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (uid, np.repeat(ids, n), found[some], -scores[some])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if (r["part"], r["lot"]) != key:
                    if held:
                        yield rows(key, held)
                    key, ids = (r["part"], r["lot"]), np.frombuffer(r["q_ids"], np.int64)
                    held = ids, np.full((len(ids), 0), worst), np.full((len(ids), 0), worst)
                block = Block(np.frombuffer(r["ids"], np.int64), r["width"], r["bits"], r["least"], np.frombuffer(r["slices"], np.uint64))
                queries = np.frombuffer(r["q_values"], np.int64).reshape(-1, r["q_width"])
                queries = widened(queries, block.width)
                scores, found = np.full((len(queries), k), worst), np.full((len(queries), k), worst)
                for q, (query, own) in enumerate(zip(queries, held[0].tolist(), strict=True)):
                    at, score = block.search(query, own, k)
                    scores[q, : len(at)], found[q, : len(at)] = -score, block.ids[at]
                held = held[0], *best(np.hstack((held[1], scores)), np.hstack((held[2], found)), k)
        if held:
            yield rows(key, held)

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    scale: float = SCALE,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score: of each query (id, x) the k best of ``vectors`` (id, x).

    The two sides meet on (query part, lot of blocks).  There are as many lots
    as keep all cores busy, so each part of the queries is copied that often
    and the blocks once per part; that is the work an exact answer takes.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-vectors.count() // block_rows))
    parts = max(1, -(-queries.count() // query_rows))
    lots = min(blocks, max(1, -(-4 * spark.sparkContext.defaultParallelism // parts)))
    index = vectors.repartition(blocks).transform(small_batches).mapInArrow(_indexed(scale), _BLOCK)
    index = index.withColumn("lot", F.col("block") % lots).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.repartition(parts).transform(small_batches).mapInArrow(_packed_queries(scale), _QUERIES)
    asked = asked.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    found = index.join(asked, ["part", "lot"]).transform(small_batches).mapInArrow(_searched(k), _FOUND)
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def topk_of_embeddings(spark: SparkSession, directory: str) -> DataFrame:
    """The 20 rows of highest inner product for every vector whose id is divisible by 20."""
    vectors = usable(table(spark, directory, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("id") % QUERY_EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
