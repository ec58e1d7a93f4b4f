"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample on the driver and routes every row to a
leaf.  A query goes through the tree best bin first: a priority queue holds the
nodes met so far by the distance of their centre, and the nearest one is opened
next, until enough leaves are reached.  How many are enough is calibrated: for
a bounded set of queries the true neighbours are found by scanning all rows,
and the visits are widened until the asked share of them lies in visited
leaves; a query whose leaves hold fewer than k other rows goes on until they
do, so that it gets all it can.  Whole leaves are searched, whatever their size: rows of a leaf are
dealt over as many cells as they need, and small leaves share a cell.

Defined cases: vectors that are null, zero, or hold a null or a non-finite
component take no part, nor do rows without an id; vectors of other lengths
are filled up with zeros.  Rows with the query's id count as its own row.  A
query that is there twice is answered twice.  Distances too large for a double
are infinite.  Ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import small_batches, table, written
from inkveil.llm.vectors import best, gathered, matrix, usable, widened

K, QUERY_EVERY = 10, 100
SAMPLE_ROWS, BRANCHES, LEAF_ROWS, ROUNDS = 20_000, 8, 16, 6
#: Queries whose true neighbours are found to calibrate, and the share to reach.
CALIBRATION_QUERIES, RECALL = 128, 0.97
CELL_ROWS, QUERY_ROWS = 1024, 1024
_LARGEST_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Tree:
    """Node 0 is the root; children of a node follow one another; leaves have none."""

    centres: np.ndarray
    first: np.ndarray  # first child, -1 for a leaf
    count: np.ndarray
    leaf: np.ndarray  # number of a leaf in tree order, -1 otherwise

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every node."""
        x = widened(x, self.centres.shape[1])
        at = np.zeros(len(x), np.int64)
        while True:
            open_ = self.first[at] >= 0
            if not open_.any():
                return self.leaf[at]
            for node in np.unique(at[open_]).tolist():
                rows = np.flatnonzero(at == node)
                children = np.arange(self.first[node], self.first[node] + self.count[node])
                at[rows] = children[_squares(x[rows], self.centres[children]).argmin(axis=1)]

    def visits(self, x: np.ndarray, most: int, rows: np.ndarray | None = None, wanted: np.ndarray | None = None) -> Iterator[list[int]]:
        """For each row the leaves in the order of a best-bin-first traversal, ``most`` of them.

        With the number of ``rows`` in each leaf, a traversal goes on until its
        leaves hold as many as are ``wanted`` for the row.
        """
        held = [0] * self.leaves if rows is None else rows.tolist()
        needs = [0] * len(x) if wanted is None else wanted.tolist()
        near = _squares(widened(x, self.centres.shape[1]), self.centres)
        first, count, leaf = self.first.tolist(), self.count.tolist(), self.leaf.tolist()
        for distance, need in zip(near.tolist(), needs, strict=True):
            queue, out = [(0.0, 0)], []
            while queue and (len(out) < most or need > 0):
                _, node = heapq.heappop(queue)
                if first[node] < 0:
                    out.append(leaf[node])
                    need -= held[leaf[node]]
                for child in range(first[node], first[node] + count[node]):
                    heapq.heappush(queue, (distance[child], child))
            yield out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        out = (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)
    return np.nan_to_num(out, nan=np.inf, posinf=np.inf)


def _means(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray | None:
    """The group of each row after some rounds of k-means, None where rows can't be told apart."""
    kinds = np.unique(x, axis=0) if len(x) <= 4 * k else x
    centres = kinds[draw.choice(len(kinds), min(k, len(kinds)), replace=False)]
    for _ in range(ROUNDS):
        group = _squares(x, centres).argmin(1)
        used = np.unique(group)
        centres = np.stack([x[group == g].mean(0) for g in used])
    group = _squares(x, centres).argmin(1)
    return group if len(np.unique(group)) > 1 else None


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Tree:
    """Split the sample by k-means until at most ``leaf_rows`` rows are together."""
    draw = np.random.default_rng(seed)
    centres, first, count = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [-1], [0]
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        group = _means(x[rows], branches, draw) if len(rows) > leaf_rows else None
        if group is None:
            continue
        parts = [rows[group == g] for g in np.unique(group)]
        first[node], count[node] = len(centres), len(parts)
        for part in parts:
            todo.append((len(centres), part))
            centres.append(x[part].mean(0))
            first.append(-1)
            count.append(0)
    leaf, seen, stack = np.full(len(centres), -1), 0, [0]
    while stack:  # leaves are numbered so that neighbours in the tree are neighbours in number
        node = stack.pop()
        if first[node] < 0:
            leaf[node], seen = seen, seen + 1
        stack.extend(range(first[node] + count[node] - 1, first[node] - 1, -1) if first[node] >= 0 else ())
    return Tree(np.array(centres), np.array(first), np.array(count), leaf)


def sampled(vectors: DataFrame, rows: int) -> np.ndarray:
    """At most about ``rows`` vectors, chosen by a hash of their ids."""
    there = vectors.count()
    part = min(1.0, rows / max(1, there))
    lucky = F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(1 << 30)) < int(part * (1 << 30))
    picked = (vectors.filter(lucky) if part < 1 else vectors).limit(2 * rows).orderBy("id", "x").select("x").toArrow()
    parts = [matrix(c) for c in picked.column("x").chunks if len(c)]
    width = max((p.shape[1] for p in parts), default=0)
    return np.concatenate([widened(p, width) for p in parts]) if parts else np.zeros((0, 0))


def routed(vectors: DataFrame, tree: Tree) -> DataFrame:
    """id, x and leaf of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.route(matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int32())], names=["id", "x", "leaf"])

    return vectors.transform(small_batches).mapInArrow(run, "id long, x array<double>, leaf int")


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, each from the differences themselves."""
    width = max(q.shape[1], x.shape[1])
    q, x = widened(q, width), widened(x, width)
    out = np.empty((len(q), len(x)))
    step = max(1, 4_000_000 // max(1, x.size))
    with np.errstate(over="ignore"):
        for at in range(0, len(q), step):
            d = q[at : at + step, None, :] - x[None]
            out[at : at + step] = np.sqrt(np.einsum("qxd,qxd->qx", d, d))
    return out


def paired_distances(q: np.ndarray, x: np.ndarray, who: np.ndarray, what: np.ndarray) -> np.ndarray:
    """``distances(q, x)[who, what]``, only these worked out."""
    width = max(q.shape[1], x.shape[1])
    q, x = widened(q, width), widened(x, width)
    out = np.empty(len(who))
    step = max(1, 1_000_000 // max(1, width))
    with np.errstate(over="ignore"):
        for at in range(0, len(who), step):
            d = q[who[at : at + step]] - x[what[at : at + step]]
            out[at : at + step] = np.sqrt(np.einsum("nd,nd->n", d, d))
    return out


def nearest(q: np.ndarray, x: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) among the allowed ones, with all that may be among a row's k nearest.

    Squares by way of a product are off by a known bound at most: what is
    farther than k others by more than that is left out, so whatever
    ``distances`` gives, its k least and all that equal them are here.
    """
    width = max(q.shape[1], x.shape[1])
    q, x = widened(q, width), widened(x, width)
    with np.errstate(over="ignore", invalid="ignore"):
        size = (q * q).sum(1)[:, None] + (x * x).sum(1)
        near = size - 2 * (q @ x.T)
        # Of either way to work it out, of the root, and of numbers too small for full precision.
        off = size * ((8 * width + 64) * 2.0**-53) + 1e-290
        sure = np.isfinite(near) & np.isfinite(off)
        farthest = np.where(sure & allowed, near + off, np.inf)
        bound = np.partition(farthest, k - 1, axis=1)[:, k - 1 : k] if len(x) >= k else np.inf
        return np.nonzero(allowed & (~sure | (near - off <= bound)))


def true_neighbours(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """q (number of the query), vec_id, leaf, score: exact, by a scan of all rows (a bounded set of queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full((len(ids), 0), np.inf), np.full((len(ids), 0), _LARGEST_ID)
        leaves: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = part.column(0).to_numpy(zero_copy_only=False)
                d = distances(queries, matrix(part.column(1)))
                d[ids[:, None] == own[None]] = np.nan
                named = np.where(np.isnan(d), _LARGEST_ID, own[None])
                held = best(np.hstack((held[0], np.nan_to_num(d, nan=np.inf, posinf=np.inf))), np.hstack((held[1], named)), k)
                leaves.update(zip(own.tolist(), part.column(2).to_numpy(zero_copy_only=False).tolist(), strict=True))
                near = set(held[1].ravel().tolist())
                leaves = {i: leaf for i, leaf in leaves.items() if i in near}
        some = held[1] != _LARGEST_ID
        found = held[1][some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(ids)), some.sum(1)), pa.int32()), pa.array(found, pa.int64()),
             pa.array([leaves[i] for i in found.tolist()], pa.int32()), pa.array(held[0][some], pa.float64())],
            names=["q", "vec_id", "leaf", "score"],
        )

    found = rows.transform(small_batches).mapInArrow(run, "q int, vec_id long, leaf int, score double")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def calibrated(rows: DataFrame, asked: DataFrame, tree: Tree, k: int, recall: float, most: int = CALIBRATION_QUERIES) -> int:
    """The fewest visits with which the asked share of true neighbours is found."""
    some = asked.orderBy(F.xxhash64("id", F.lit("calibrate")), "id").limit(most).toArrow()
    if not some.num_rows:
        return 1
    ids, queries = gathered(some.to_batches())
    truth = true_neighbours(rows, ids, queries, k).select("q", "leaf").toPandas()
    order = list(tree.visits(queries, tree.leaves))
    places = [{leaf: i for i, leaf in enumerate(x)} for x in order]
    needed = sorted(places[q][leaf] + 1 for q, leaf in zip(truth["q"], truth["leaf"], strict=True))
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def cells_of(counts: np.ndarray, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of each leaf; leaves that fit together share one."""
    first, number = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    cell, filled = 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if filled and filled + n > cell_rows:
            cell, filled = cell + 1, 0
        first[leaf], number[leaf] = cell, max(1, -(-n // cell_rows))
        cell, filled = cell + int(number[leaf]) - 1, filled + n if number[leaf] == 1 else cell_rows
    return first, number


def _dealt(first: np.ndarray, number: np.ndarray):
    """Rows to their cells; those of a large leaf go to its cells in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            leaf = batch.column(2).to_numpy(zero_copy_only=False)
            cell = first[leaf] + (seen + np.arange(len(leaf))) % number[leaf]
            seen += len(leaf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["id", "x", "leaf", "cell"])

    return run


def _cell(part: pa.Table) -> pa.Table:
    part = part.combine_chunks().sort_by([("leaf", "ascending"), ("id", "ascending")])
    x = matrix(part.column("x").combine_chunks())
    leaf = part.column("leaf").to_numpy().astype(np.int32)
    return pa.table({
        "cell": part.column("cell").slice(0, 1), "width": pa.array([x.shape[1]], pa.int32()),
        "ids": pa.array([part.column("id").to_numpy().tobytes()]), "leaves": pa.array([leaf.tobytes()]),
        "values": pa.array([x.tobytes()]),
    })


def _asked(tree: Tree, visits: int, k: int, counts: np.ndarray, first: np.ndarray, number: np.ndarray):
    """Queries (id, x, own) to rows of the leaves that begin in one cell: the queries that visit them, and (leaf, query) pairs.

    A leaf of many cells is one row with the range of its cells, so that what a
    task holds is bounded by its queries and the leaves of the tree.
    """
    names = ("uids", "q_ids", "q_values", "visit_leaf", "visit_q")
    schema = pa.schema([("first", pa.int64()), ("last", pa.int64()), ("q_width", pa.int32()), *((n, pa.binary()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        ids, x = gathered(parts)
        if not len(ids):
            return
        own = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts])
        visited = [np.array(v, np.int32) for v in tree.visits(x, visits, counts, own + k)]
        leaf, q = np.concatenate(visited), np.repeat(np.arange(len(ids), dtype=np.int32), [len(v) for v in visited])
        some = counts[leaf] > 0
        leaf, q = leaf[some], q[some]
        order = np.argsort(first[leaf], kind="stable")
        leaf, q = leaf[order], q[order]
        cells, starts = np.unique(first[leaf], return_index=True)
        base = TaskContext.get().partitionId() << 32
        for cell, start, end in zip(cells.tolist(), starts.tolist(), [*starts[1:].tolist(), len(leaf)], strict=True):
            used, at = np.unique(q[start:end], return_inverse=True)
            columns = (used.astype(np.int64) + base, ids[used], x[used], leaf[start:end], at.astype(np.int32))
            row = {n: c.tobytes() for n, c in zip(names, columns, strict=True)}
            last = cell + int(number[leaf[start:end]].max()) - 1
            yield pa.RecordBatch.from_pylist([{"first": cell, "last": last, "q_width": x.shape[1], **row}], schema)

    return run


def _visited(k: int):
    """Joined cells and queries to the k nearest rows of each query in the leaves it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids, leaves = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["leaves"], np.int32)
                x = np.frombuffer(r["values"]).reshape(len(ids), r["width"])
                uids, q_ids = np.frombuffer(r["uids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                queries = np.frombuffer(r["q_values"]).reshape(len(uids), r["q_width"])
                visit_leaf, visit_q = np.frombuffer(r["visit_leaf"], np.int32), np.frombuffer(r["visit_q"], np.int32)
                held, at = np.unique(leaves, return_inverse=True)
                visited = np.zeros((len(uids), len(held)), bool)
                some = np.isin(visit_leaf, held)
                visited[visit_q[some], np.searchsorted(held, visit_leaf[some])] = True
                who, what = nearest(queries, x, visited[:, at] & (q_ids[:, None] != ids[None]), k)
                if not len(who):
                    continue
                d, own = paired_distances(queries, x, who, what), ids[what]
                order = np.lexsort((own, d, who))
                who, d, own = who[order], d[order], own[order]
                starts = np.searchsorted(who, who)
                kept = np.arange(len(who)) - starts < k
                who, d, own = who[kept], d[kept], own[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[who]), pa.array(q_ids[who]), pa.array(own), pa.array(d)],
                    names=["uid", "query_id", "vec_id", "score"],
                )

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: of each query (id, x) the k nearest found among ``vectors`` (id, x)."""
    tree = fit_tree(sampled(vectors, SAMPLE_ROWS))
    rows = written(routed(vectors, tree), "routed")
    visits = calibrated(rows, queries, tree, k, recall)
    counts = np.zeros(max(1, tree.leaves), np.int64)
    for r in rows.groupBy("leaf").count().collect():  # one row per leaf of the bounded tree
        counts[r["leaf"]] = r["count"]
    first, number = cells_of(counts, cell_rows)
    cells = rows.transform(small_batches).mapInArrow(_dealt(first, number), "id long, x array<double>, leaf int, cell long")
    cells = cells.groupBy("cell").applyInArrow(_cell, "cell long, width int, ids binary, leaves binary, values binary")
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    # A query's own rows are no answers to it, so leaves with so many more are opened.
    same = rows.select("id").join(queries.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("own"))
    known = queries.join(same, "id", "left").select("id", "x", F.coalesce("own", F.lit(0)).cast("long").alias("own"))
    asked = known.repartition(parts).transform(small_batches).mapInArrow(
        _asked(tree, visits, k, counts, first, number),
        "first long, last long, q_width int, uids binary, q_ids binary, q_values binary, visit_leaf binary, visit_q binary",
    )
    asked = asked.withColumn("cell", F.explode(F.sequence("first", "last"))).drop("first", "last")
    # Spark judges the questions by the queries, and a query is in many of them: by a merge, nothing is broadcast.
    # Its right side is held for a key; that is one row of a cell.
    found = asked.hint("merge").join(cells, "cell").transform(small_batches).mapInArrow(_visited(k), "uid long, query_id long, vec_id long, score double")
    order = Window.partitionBy("uid").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbours_of_embeddings(spark: SparkSession, directory: str) -> DataFrame:
    """The 10 nearest rows found for every vector whose id is divisible by 100."""
    vectors = usable(table(spark, directory, "embeddings"), "vec_id", "embedding", nonzero=True)
    return search(vectors, vectors.filter(F.col("id") % QUERY_EVERY == 0))
