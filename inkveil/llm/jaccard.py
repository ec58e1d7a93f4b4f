"""Exact Jaccard join of documents on word n-grams, size-aware.

Documents with equal sets are one node.  Small sets are joined by enumeration:
two linked sets share a subset that lacks at most a tenth of either, so all
such subsets are listed and equal ones meet.  Large sets are joined by inverted
lists: linked sets share one of their rarest elements, so lists over these
bring candidates together, and there the inverted lists of whole sets are
scanned to count every overlap.  The boundary is where listing subsets starts
to cost more than scanning, by the sizes and repetitions found in the corpus.

Hot lists do not become pairs.  Lists only say which nodes have to be compared
(components of nodes that share a rare element at similar size); each such
group is cut into blocks by size and volume, a task compares two blocks, and
what leaves it is a spanning forest of the links found.  Which elements are
common is found by lossy counting over all documents; it decides the order of
elements alone, so the result does not depend on it.

Elements are 64-bit hashes of n-grams; sets are equal when two 64-bit sums over
their elements and their sizes are.

Defined cases: a document with fewer words than an n-gram has one element, its
whole sequence of words; a null text or one without words has none and is
linked with nothing; repeated documents are linked unless they are empty;
documents with the same id stay rows of their own; an empty table gives no
rows.  Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkveil.llm.common import all_of, named, small_batches, table, text_rows, written
from inkveil.llm.components import components

WORDS, PERCENT = 3, 90
#: Elements put last in the order for being common: how many at most, and from how many documents on.
COMMON, COMMON_FROM = 200_000, 32
#: Lossy counting: elements counted together, and the fewest documents among them to be noted.
COUNTED_TOGETHER, NOTED_FROM = 4_000_000, 3
#: Elements with smaller hashes, a quarter, come first in the order of elements.
FIRST = np.uint64(2**62)
#: Smallest hashes kept to estimate how often an element repeats.
SKETCH = 1024
#: Elements in a block of sets that are compared.
BLOCK_ELEMENTS = 150_000
#: Bytes of text hashed together (a longer word is hashed whole).
BYTES_TOGETHER = 1_000_000
#: Listing more subsets than this for one set is never considered.
MOST_SUBSETS = 1000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, factor: np.uint64 = _M1) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * factor
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to sets of 64-bit hashes of their n-grams, many texts at once.

    ``bytes.lower`` knows ASCII alone, so it lower-cases A-Z.  A word's hash is a
    polynomial over its bytes (each byte first becomes a random number), taken
    from running sums over all texts; hashes of words make those of n-grams.
    """

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        draw = np.random.default_rng(5)
        self.symbol = draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        """Powers of the base, and of its inverse modulo 2**64, up to n."""
        if len(self.power) <= n:
            size = max(n + 1, 2 * len(self.power))
            for name, base in (("power", _M1), ("inverse", np.uint64(pow(int(_M1), -1, 2**64)))):
                steps = np.full(size, base)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def _words(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start, and their hashes; piece by piece, cut at blanks."""
        gaps = np.flatnonzero(self.blank[joined])
        starts, words, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        while at < len(joined):
            cut = int(np.searchsorted(gaps, at + BYTES_TOGETHER))
            until = int(gaps[cut]) if cut < len(gaps) else len(joined)
            part = joined[at:until]
            self._reach(len(part))
            solid = ~self.blank[part]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
            start, end = edge[::2], edge[1::2]
            running = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.symbol[part] * self.power[: len(part)], out=running[1:])
            hashes = (running[end] - running[start]) * self.inverse[start] + (end - start).astype(np.uint64)
            starts.append(start + at)
            words.append(_mix(hashes))
            at = until
        return np.concatenate(starts), np.concatenate(words)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct elements of each text."""
        data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        start, word = self._words(np.frombuffer(b" ".join([*data, b""]), np.uint8))
        bounds = np.cumsum([len(d) + 1 for d in data])
        last = np.searchsorted(start, bounds)
        grams = word[: max(0, len(word) - self.words + 1)]
        for i in range(1, self.words):
            grams = _mix(grams) * _M1 + word[i : len(grams) + i]
        grams, out, first = _mix(grams), [], 0
        for behind in last.tolist():
            if behind - first >= self.words:
                out.append(np.unique(grams[first : behind - self.words + 1]))
            elif behind > first:  # too few words for one n-gram: all of them are the only one
                whole = np.array([behind - first], np.uint64)
                for x in word[first:behind]:
                    whole = _mix(whole * _M1 + x)
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
            first = behind
        return out


def sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each element adds to the two sums that stand for a set."""
    return _mix(x, _M1), _mix(x ^ _M2, np.uint64(0xD6E8FEB86659FD93))


def spare(n: int, percent: int = PERCENT) -> int:
    """How many elements of n a linked set can lack."""
    return n - -(-percent * n // 100)


def subsets(n: int, percent: int = PERCENT) -> int:
    return sum(comb(n, k) for k in range(spare(n, percent) + 1))


def boundary(sizes: dict[int, int], repetition: float, percent: int = PERCENT) -> int:
    """The largest size up to which listing subsets costs no more than scanning lists.

    Listing costs one row per subset.  Scanning costs a row and a list of
    average length per rare element, and comparing two sets with each other
    for each further entry of a list.
    """
    best = 0
    for n in range(1, max(sizes, default=0) + 1):
        listing = subsets(n, percent)
        if listing > MOST_SUBSETS:
            break
        rare = spare(n, percent) + 1
        scanning = rare * (1 + repetition) + rare * (repetition - 1) * 2 * n
        if listing > scanning:
            break
        best = n
    return best


@dataclass(frozen=True)
class Plan:
    """``small``: the largest size whose subsets are listed; ``common``: elements that come last, by count."""

    small: int
    common: np.ndarray
    counts: np.ndarray
    words: int
    percent: int

    @property
    def listed_from(self) -> int:
        """The least size that can link with a set larger than ``small``."""
        return -(-self.percent * (self.small + 1) // 100)

    def rare(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements that compete for the places in inverted lists, and those sure of one.

        In the order of all elements those with small hashes that are not
        common come first, by the number of sets they are in (counted later);
        then the others by hash; then the common ones by count.
        """
        places = spare(len(x), self.percent) + 1
        times = np.zeros(len(x), np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, x), len(self.common) - 1)
            times = np.where(self.common[at] == x, self.counts[at], 0)
        first = (times == 0) & (x < FIRST)
        listed = x[first]
        rest, times = x[~first], times[~first]
        return listed, rest[np.lexsort((rest, times))[: max(0, places - len(listed))]]


def surveyed(docs: DataFrame, text: str, words: int, percent: int) -> Plan:
    """One pass over all documents: common elements, sizes, and how often elements repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, total, least = Shingler(words), [], 0, np.zeros(0, np.uint64)
        sizes: dict[int, int] = {}

        def noted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            some = n >= NOTED_FROM
            return rows(0, found[some].view(np.int64), n[some])

        for batch in text_rows(batches, 0):
            for x in shingler.sets(batch.column(0).to_pylist()):
                if len(x):
                    sizes[len(x)] = sizes.get(len(x), 0) + 1
                    held.append(x)
                    total += len(x)
                    if len(least) < SKETCH or x[0] < least[-1]:
                        least = np.unique(np.concatenate((least, x[:SKETCH])))[:SKETCH]
                if total >= COUNTED_TOGETHER:
                    yield noted()
                    held, total = [], 0
        yield noted()
        yield rows(1, np.array(list(sizes), np.int64), np.array(list(sizes.values()), np.int64))
        yield rows(2, least.view(np.int64), np.ones(len(least), np.int64))

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind), pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "n"])

    found = docs.select(F.col(text).alias("text")).transform(small_batches).mapInArrow(run, "kind int, key long, n long")
    found = written(found.groupBy("kind", "key").agg(F.sum("n").alias("n")), "survey")
    top = found.filter(f"kind = 0 AND n >= {COMMON_FROM}").orderBy(F.desc("n"), "key").limit(COMMON).select("key", "n").toPandas()
    common = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    # Sizes up to where subsets could be listed, the number of all elements, and the sketch: all bounded.
    few = {r["key"]: r["n"] for r in found.filter("kind = 1 AND key < 100").collect()}
    everything = found.filter("kind = 1").agg(F.sum(F.col("key") * F.col("n"))).first()[0] or 0
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    sketch = [r[0] + (1 << 63) for r in found.filter("kind = 2").orderBy(unsigned).limit(SKETCH).select(unsigned).collect()]
    different = len(sketch) if len(sketch) < SKETCH else (SKETCH - 1) * 2**64 / max(sketch)
    repetition = max(1.0, everything / max(1, different))
    return Plan(boundary(few, repetition, percent), common[order], top["n"].to_numpy(np.int64)[order], words, percent)


def _described(plan: Plan, kind: T.DataType):
    """Documents to size, sums, elements for inverted lists, and the subsets of small sets (sums and size)."""
    longs = T.ArrayType(T.LongType())
    fields = {"doc_id": kind, "n": T.IntegerType(), "h1": T.LongType(), "h2": T.LongType(), "listed": longs, "sure": longs, "s1": longs, "s2": longs, "kept": T.ArrayType(T.IntegerType())}
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, lists, none = Shingler(plan.words), pa.list_(pa.int64()), np.zeros(0, np.int64)
        for batch in text_rows(batches, 1):
            columns: list[list] = [[] for _ in range(8)]
            for x in shingler.sets(batch.column(1).to_pylist()):
                a, b = sums(x)
                h1, h2 = a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)
                listed, sure = plan.rare(x) if len(x) >= max(1, plan.listed_from) else (x[:0], x[:0])
                s1, s2, kept = none, none, none
                if 0 < len(x) <= plan.small:
                    gone = [c for k in range(spare(len(x), plan.percent) + 1) for c in combinations(range(len(x)), k)]
                    s1 = (np.array([h1]) - [a[list(c)].sum(dtype=np.uint64) for c in gone]).view(np.int64)
                    s2 = (np.array([h2]) - [b[list(c)].sum(dtype=np.uint64) for c in gone]).view(np.int64)
                    kept = np.array([len(x) - len(c) for c in gone])
                row = len(x), h1.view(np.int64), h2.view(np.int64), listed.view(np.int64), sure.view(np.int64), s1, s2, kept
                for column, v in zip(columns, row, strict=True):
                    column.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), lists, lists, lists, lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return run, schema


def _linked(c: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * c >= percent * (n + m - c)


def _small_links(nodes: DataFrame, percent: int) -> DataFrame:
    """Links by equal subsets.

    If two sets link by a subset they share, each also links by it with the
    smallest set that has it, so links to that one make the same components.
    """
    keys = nodes.select("node", "n", F.explode(F.arrays_zip("s1", "s2", "kept")).alias("s")).select("node", "n", "s.*")
    least = keys.groupBy("s1", "s2", "kept").agg(F.min(F.struct("n", "node")).alias("least"))
    met = keys.join(least, ["s1", "s2", "kept"])
    ok = _linked(F.col("kept"), F.col("n"), F.col("least.n"), percent) & (F.col("node") != F.col("least.node"))
    return met.filter(ok).select(F.col("node").alias("a"), F.col("least.node").alias("b"))


def size_class(n: Column, percent: int) -> Column:
    """Linked sets are in the same class of sizes or in neighbouring ones."""
    step = float(np.log(100 / percent)) * (1 + 1e-9)
    return F.floor(F.log(n.cast("double")) / step).cast("int")


def _entries(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, n, element): the elements in a node's places that other nodes may have too.

    Elements that compete for places are counted first; those of one set alone
    take places, but no list.  Common elements (of copies and boilerplate, as
    the survey of all documents found them) do not compete: they have their
    places for sure, so they are not counted, and no list that is counted here
    is long.
    """
    sure = nodes.select("node", "n", F.explode("sure").alias("element"))
    lists = nodes.select("node", "n", F.size("listed").alias("competing"), F.explode("listed").alias("element"))
    shared = lists.withColumn("sets", F.count("*").over(Window.partitionBy("element"))).filter("sets > 1")
    of_node = Window.partitionBy("node")
    places = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    taken = F.col("competing") - F.count("*").over(of_node)  # by elements of this set alone
    rank = F.row_number().over(of_node.orderBy("sets", "element"))
    ranked = shared.withColumns({"taken": taken, "rank": rank}).filter(F.col("rank") + F.col("taken") <= places)
    return ranked.select("node", "n", "element").unionAll(sure)


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, root): nodes that have to be compared have the same root.

    In each inverted list, nodes of two neighbouring size classes are held
    together by edges to the least of them.
    """
    size = size_class(F.col("n"), percent)
    entries = written(_entries(nodes, percent).select("node", "element", F.explode(F.array(size, size + 1)).alias("size")), "entries")
    least = entries.groupBy("element", "size").agg(F.min("node").alias("least"), F.count("*").alias("c")).filter("c > 1")
    edges = entries.join(least, ["element", "size"]).filter("node <> least")
    return components(edges.select(F.col("node").alias("a"), F.col("least").alias("b")))


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the number of elements it shares with every set, by scanning the inverted lists of its elements."""
    sizes = np.array([len(s) for s in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    entries = owner[np.argsort(element, kind="stable")]
    lengths = np.bincount(element)
    starts = np.cumsum(lengths) - lengths
    first = np.cumsum(sizes) - sizes
    for i in range(len(sets)):
        own = element[first[i] : first[i] + sizes[i]]
        n, begin = lengths[own], starts[own]
        places = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield i, np.bincount(entries[places], minlength=len(sets))


def forest(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect what the links among these sets connect."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets])
    out = []
    for i, shared in overlaps(sets):
        for j in np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared)).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _compared(percent: int):
    """Rows sorted by cell to the links within each cell."""

    def links(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        nodes = np.array([r[0] for r in rows])
        found = forest(nodes, [np.frombuffer(r[1], np.uint64) for r in rows], percent) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for key, node, elements in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != cell:
                    if held:
                        yield links(held)
                    cell, held = key, []
                if not held or held[-1][0] != node:
                    held.append((node, elements))
        if held:
            yield links(held)

    return run


def _large_links(docs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Links among the nodes that share rare elements, exact."""
    roots = _candidates(nodes.filter("size(listed) + size(sure) > 0"), plan.percent)
    active = roots.join(nodes.select("node", "n", "h1", "h2", "doc_id"), "node")
    active = written(active.withColumn("size", size_class(F.col("n"), plan.percent)), "active")
    blocks = active.groupBy("root", "size").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("blocks"), F.count("*").alias("members"))
    blocks = written(blocks, "blocks")
    beside = {}
    for name, shift in (("lower", -1), ("upper", 1)):
        beside[name] = blocks.select("root", (F.col("size") - shift).alias("size"), F.col("blocks").alias(name))
    placed = active.join(blocks, ["root", "size"]).join(beside["lower"], ["root", "size"], "left").join(beside["upper"], ["root", "size"], "left")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block)

    def cells(count: Column, cross: int, size: Column, ends) -> Column:
        """One cell for each block of the other side."""
        numbers = F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda t: F.struct(size.alias("size"), F.lit(cross).alias("cross"), *(e.alias(k) for k, e in zip("ij", ends(t), strict=True))))

    own, size = F.col("block"), F.col("size")
    within = F.when(F.col("members") > 1, F.col("blocks")).otherwise(0)
    every = F.concat(
        cells(within, 0, size, lambda t: (F.least(own, t), F.greatest(own, t))),
        cells(F.col("upper"), 1, size + 1, lambda t: (own, t)),
        cells(F.col("lower"), 1, size, lambda t: (t, own)),
    )
    placed = placed.select("doc_id", "n", "h1", "h2", "node", F.transform(every, lambda c: F.concat_ws("/", "root", *(c[k] for k in ("size", "cross", "i", "j")))).alias("cells"))
    # A node's text is that of a document with its id and its set.
    same = [F.col(f"d.{k}") == F.col(f"p.{k}") for k in ("n", "h1", "h2")]
    texts = _summed(docs, plan).alias("d").join(placed.alias("p"), all_of([*same, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))]))
    rows = texts.select("p.node", "p.cells", "d.text").filter(F.size("cells") > 0).transform(small_batches).mapInArrow(_elements(plan), "cell string, node long, elements binary")
    return rows.repartition("cell").sortWithinPartitions("cell", "node").transform(small_batches).mapInArrow(_compared(plan.percent), "a long, b long")


def _summed(docs: DataFrame, plan: Plan) -> DataFrame:
    """The documents with size and sums of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(plan.words)
        for batch in text_rows(batches, 1):
            sets = shingler.sets(batch.column(1).to_pylist())
            h = [[v.sum(dtype=np.uint64).view(np.int64) for v in sums(x)] for x in sets]
            columns = [pa.array([len(x) for x in sets], pa.int32()), *(pa.array([v[k] for v in h], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "n", "h1", "h2"])

    fields = [T.StructField("n", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
    return docs.transform(small_batches).mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def _elements(plan: Plan):
    """Nodes with text and cells to one row per cell with the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(plan.words)
        for batch in text_rows(batches, 2):
            sets = shingler.sets(batch.column(2).to_pylist())
            for node, cells, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.string()), pa.array([node] * len(cells), pa.int64()), pa.array([x.tobytes()] * len(cells), pa.binary())],
                    names=["cell", "node", "elements"],
                )

    return run


def _joined(docs: DataFrame, words: int, percent: int) -> tuple[Plan, DataFrame, DataFrame]:
    """The plan; doc_id, n, h1, h2 of every row; and the different sets (h1, h2, n, node, least id) with their root, null where nothing is linked."""
    plan = surveyed(docs, "text", words, percent)
    run, schema = _described(plan, docs.schema["doc_id"].dataType)
    rows = written(docs.transform(small_batches).mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "rows")
    some = rows.filter("n > 0")
    classes = written(some.groupBy("h1", "h2", "n").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least")), "classes")
    nodes = some.withColumnRenamed("uid", "node").join(classes.select("node"), "node", "left_semi")
    links = _small_links(nodes.filter(F.size("kept") > 0), percent).unionAll(_large_links(docs, nodes, plan))
    return plan, rows.select("doc_id", "n", "h1", "h2"), written(classes.join(components(links), "node", "left"), "found")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows whose sets have at least ``percent`` hundredths of their union in
    common are linked; component_id is the least id reachable by links.
    """
    _, rows, sets = _joined(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), words, percent)
    linked, alone = sets.filter("root IS NOT NULL"), sets.filter("root IS NULL")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    of_set = linked.join(least, "root").select("h1", "h2", "n", "component").unionAll(alone.select("h1", "h2", "n", "least"))
    out = rows.join(of_set, ["h1", "h2", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without all but one of each group, with their columns.

    The document with the least id stays; documents without words all stay.
    """
    names = docs.columns
    plan, _, sets = _joined(docs.select("doc_id", "text"), words, percent)
    first = sets.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("least", "node", "n", "h1", "h2")).alias("x"))
    name = F.coalesce(F.col("__id").cast("string"), F.lit("null"))
    first = first.select("x.n", "x.h1", "x.h2", F.col("x.least").alias("__id")).withColumn("__id", name).withColumn("__first", F.lit(True))
    held = docs.select("doc_id", "text", F.struct(*map(named, names)).alias("__row"))
    rows = _summed(held, plan).select("__row", "n", "h1", "h2", F.col("doc_id").alias("__id")).withColumn("__id", name)
    met = rows.join(first, ["n", "h1", "h2", "__id"], "left")
    again = F.row_number().over(Window.partitionBy("n", "h1", "h2", "__id").orderBy(F.lit(1)))
    kept = met.withColumn("__again", again).filter((F.col("n") == 0) | F.col("__first") & (F.col("__again") == 1))
    return kept.select(*(F.col("__row").getField(c).alias(c) for c in names))


def components_of_documents(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return grouped(table(spark, directory, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                      WHEN len(w) > 0 THEN [len(w) || chr(10) || array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d
), s AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (
  SELECT a AS node, a AS seen FROM p
  UNION
  SELECT r.node, p.b FROM r JOIN p ON r.seen = p.a
), c AS (
  SELECT node, min(seen) AS least FROM r GROUP BY node
)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, coalesce(c.least, g.doc_id) AS component_id
FROM g LEFT JOIN c ON c.node = g.doc_id
"""
