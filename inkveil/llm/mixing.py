"""Mixing sources to target weights, in blocks of words.

The words of each source, document after document, are packed into blocks of
fixed length.  The mix consists of shards of slots; each shard draws how many
of its slots go to which source (whole expected slots for certain, the rest
multinomially).  The slots of a source are numbered through all shards, a
pseudorandom permutation of the source's block numbers per round turns slot
numbers into block numbers, and a join by block number says how often each
block, and so each document's words, are taken.

Nothing but sizes is shuffled to find out what is taken.  Positions of documents
within a source, and of slots, come from running totals over stretches, so a
source of any size is spread over many tasks.  The driver holds one line per
source.

What comes out is the mix itself: ``placements`` (which block fills which slot
of which shard), ``packed`` (the words of the blocks in their slots) and
``mix_corpus`` (the documents made of the word ranges that were taken).

Defined cases: a null text has size 0; documents without words are taken 0
times; a null source is a source of its own, the last one; sources without
words have target 0; documents with equal id are kept apart; an empty table
gives no rows.  No block is taken more than 3 times.  The result depends on the
rows, the seed and the parameters, not on partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import named, table, written
from inkveil.operators.numbering import running_total

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
BLOCK_WORDS, SHARD_SLOTS, BUCKET_ROWS, SEED = 32, 4096, 1024, 11
#: Words of a block where blocks become texts; slots filled by one task.
STAGE_WORDS, SLOTS_AT_ONCE = 128, 200_000
#: Beyond so many sources their lines are not broadcast by force.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Source:
    """One source: its words and blocks, the words wanted, and the slots expected."""

    name: str | None
    size: int
    target: float
    blocks: int
    slots: float


def targets(sizes: list[int], weights: list[float], most: float = MOST_TIMES) -> list[float]:
    """Shares of the whole by weight, none above ``most`` times its size; what is cut off is shared again."""
    out, left, active = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while active:
        share = left / sum(weights[i] for i in active)
        over = [i for i in active if weights[i] * share > most * sizes[i]]
        for i in over or active:
            out[i] = float(most * sizes[i]) if over else weights[i] * share
        if not over:
            break
        left -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def sources_of(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> list[Source]:
    """The sources by code point, null last; weights repeat along them."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))])
    blocks = [-(-n // block_words) for n in sizes]
    return [
        Source(r["source"], n, t, b, t * b / n if n else 0.0)
        for r, n, t, b in zip(rows, sizes, wanted, blocks, strict=True)
    ]


def permuted(index: np.ndarray, size: int, key: str) -> np.ndarray:
    """A pseudorandom permutation of range(size) at these places: a Feistel network, walked until in range."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.blake2b(key.encode(), digest_size=32).digest(), np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for k in keys:
                mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
            out[todo] = left << np.uint64(half) | right
            todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _drawn(sources: list[Source], shards: int, seed: int):
    """Shards to (shard, source, n): slots of the shard that go to the source."""
    expected = np.array([s.slots for s in sources]) / shards
    sure = np.floor(expected)
    rest = expected - sure

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"].tolist():
                draw = np.random.default_rng((seed, shard))
                open_slots = rest.sum()
                n = int(open_slots) + int(draw.random() < open_slots - int(open_slots))
                counts = sure + (draw.multinomial(n, rest / open_slots) if n else 0)
                some = np.flatnonzero(counts)
                n = counts[some].astype(np.int64)
                yield pd.DataFrame({"shard": shard, "source_at": some.astype(np.int32), "n": n, "first": n.cumsum() - n})

    return run


def _slots(sources: list[Source], seed: int):
    """Runs of slot numbers of a source to block numbers; slots past the last allowed round stay empty.

    All runs of a source in a batch go through its permutation together.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at, runs in part.groupby("source_at"):
                source = sources[at]
                start, n = runs["start"].to_numpy(), runs["n"].to_numpy()
                n = np.clip(MOST_TIMES * source.blocks - start, 0, n)
                shard = np.repeat(runs["shard"].to_numpy(), n)
                within = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
                slot = np.repeat(start, n) + within
                turn, place = slot // source.blocks, slot % source.blocks
                block = np.empty(len(slot), np.int64)
                for t in np.unique(turn).tolist():
                    block[turn == t] = permuted(place[turn == t], source.blocks, f"{seed}/{source.name is None}/{source.name}/{t}")
                slot_in_shard = np.repeat(runs["first"].to_numpy(), n) + within
                yield pd.DataFrame({"shard": shard, "slot": slot_in_shard, "source_at": np.int32(at), "block": block})

    return run


def unfolded(placements: DataFrame) -> DataFrame:
    """What comes of ``placements``, to be joined by a merge.

    Spark judges it by the runs of slots, which are few small rows, and would
    send the blocks of the whole mix to the driver to broadcast them.
    """
    return placements.hint("merge")


def placed(sized: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``sized`` with ``start``: the words before the document in its source.

    Documents go by bucket, then id and size; a bucket holds about
    ``bucket_rows`` documents of all sources.
    """
    buckets = max(1, sized.count() // bucket_rows)
    rows = sized.filter(F.col("size") > 0).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    per_bucket = rows.groupBy("source_at", "bucket").agg(F.sum("size").alias("words"))
    per_bucket = running_total(per_bucket, ["source_at"], "bucket", "words", "base").drop("words")
    within = Window.partitionBy("source_at", "bucket").orderBy("doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(within), F.lit(0))
    return rows.withColumn("inside", inside).join(per_bucket, ["source_at", "bucket"]).withColumn("start", F.col("base") + F.col("inside"))


@dataclass(frozen=True)
class Mix:
    """``rows`` (uid, doc_id, source, size, source_at, source_size, target), the sources, and the parameters."""

    rows: DataFrame
    sources: list[Source]
    block_words: int
    shard_slots: int
    seed: int

    def placements(self) -> DataFrame:
        """(shard, slot, source_at, block): which block fills each slot of each shard.

        A shard's slots are numbered by source; shuffle them by (seed, shard,
        slot) to read a shard in a random order.
        """
        spark, sources = self.rows.sparkSession, self.sources
        slots = sum(s.slots for s in sources)
        shards = max(1, math.ceil(slots / self.shard_slots))
        counts = spark.range(shards).mapInPandas(_drawn(sources, shards, self.seed), "shard long, source_at int, n long, first long")
        runs = running_total(counts, ["source_at"], "shard", "n", "start")
        # So many parts that each fills about as many slots; runs are small rows, and Spark would put all into one.
        runs = runs.repartition(max(1, math.ceil(slots / SLOTS_AT_ONCE)), "shard", "source_at")
        return runs.mapInPandas(_slots(sources, self.seed), "shard long, slot long, source_at int, block long")

    def pieces(self) -> DataFrame:
        """(uid, source_at, block, first, words): the words of each document, from ``first`` on, that lie in each block."""
        size = self.block_words
        spot = placed(self.rows)
        start, end = F.col("start"), F.col("start") + F.col("size")
        blocks = F.sequence(F.floor(start / size), F.floor((end - 1) / size))
        cut = spot.select("uid", "source_at", start.alias("start"), end.alias("end"), F.explode(blocks).alias("block"))
        first, last = F.greatest(F.col("start"), F.col("block") * size), F.least(F.col("end"), (F.col("block") + 1) * size)
        return cut.select("uid", "source_at", "block", (first - F.col("start")).alias("first"), (last - first).alias("words"))

    def taken(self) -> DataFrame:
        """``pieces`` that are taken, with how many ``times``."""
        times = self.placements().groupBy("source_at", "block").agg(F.count("*").alias("times"))
        return self.pieces().join(unfolded(times), ["source_at", "block"])


def mix_of(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> Mix:
    """The mix of ``sized`` (uid, doc_id, source, size)."""
    sources = sources_of(sized, weights, block_words)
    known_lines = [(i, s.name, s.size, s.target) for i, s in enumerate(sources)]
    known = sized.sparkSession.createDataFrame(known_lines, "source_at int, name string, source_size long, target double")
    narrow = F.broadcast(known) if len(sources) <= BROADCAST_SOURCES else known
    rows = sized.join(narrow, sized["source"].eqNullSafe(known["name"])).drop("name")
    return Mix(rows, sources, block_words, shard_slots, seed)


def mixed(sized: DataFrame, **parameters) -> DataFrame:
    """``sized`` (uid, doc_id, source, size) with source_size, target and taken."""
    mix = mix_of(sized, **parameters)
    taken = mix.taken().groupBy("uid").agg(F.sum(F.col("words") * F.col("times")).cast("long").alias("taken"))
    return mix.rows.join(taken, "uid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("source_at")


def mix_of_documents(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    docs = table(spark, directory, "documents").select("doc_id", "source", words_in(F.col("text")).alias("size"))
    sized = written(docs.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    return mixed(sized).select("doc_id", "size", "source_size", "target", "taken")


def _rows_and_mix(docs: DataFrame, block_words: int, seed: int) -> tuple[DataFrame, Mix]:
    """The documents (uid, row: all their columns, text, size) written, and their mix."""
    held = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.col("doc_id"), F.col("source"), F.col("text"))
    rows = written(held.withColumn("size", words_in(F.col("text"))).withColumn("uid", F.monotonically_increasing_id()), "mixed")
    return rows, mix_of(rows.select("uid", "doc_id", "source", "size"), block_words=block_words, seed=seed)


#: A word with the blanks behind it (the first one with those before it too).
_WORD_AND_BLANKS = r"(?:\A[\x20\x09-\x0D]++)?+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def packed(docs: DataFrame, block_words: int = STAGE_WORDS, seed: int = SEED) -> DataFrame:
    """(shard, slot, part, doc_id, first, words, text): the words of every slot's block, document after document.

    ``part`` orders the pieces of a block; ``first`` is the place of a piece's
    first word in its document.  Blocks and slots meet by block number.
    """
    rows, mix = _rows_and_mix(docs, block_words, seed)
    pieces = mix.pieces()
    of_doc = pieces.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("block", "first", "words", "source_at"))).alias("pieces"))
    cut = rows.select("uid", "doc_id", F.regexp_extract_all("text", F.lit(_WORD_AND_BLANKS), F.lit(0)).alias("w")).join(of_doc, "uid")
    texts = F.transform("pieces", lambda p: F.struct(p["block"].alias("block"), p["source_at"].alias("source_at"), p["first"].alias("first"), p["words"].alias("words"), F.array_join(F.slice("w", (p["first"] + 1).cast("int"), p["words"].cast("int")), "").alias("text")))
    each = cut.select("uid", "doc_id", F.inline(texts))
    met = unfolded(mix.placements()).join(each, ["source_at", "block"])
    part = F.row_number().over(Window.partitionBy("shard", "slot").orderBy("doc_id", F.length("text"), "uid"))
    return met.withColumn("part", part).select("shard", "slot", "part", "doc_id", "first", "words", "text")


def mix_corpus(docs: DataFrame, block_words: int = STAGE_WORDS, seed: int = SEED) -> DataFrame:
    """The documents as the mix takes them, with their columns.

    Row number n of a document holds the words of its blocks that are taken n
    times or more, in their order and with the blanks between them; whole
    documents keep their text as it is.  ``n_chars``, where there is one,
    follows the text.  Documents without words stay once.
    """
    names = docs.columns
    rows, mix = _rows_and_mix(docs, block_words, seed)
    ranges = mix.taken().groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("ranges"))
    met = rows.join(ranges, "uid", "left").filter((F.col("size") == 0) | F.col("ranges").isNotNull())
    most = F.coalesce(F.array_max(F.transform("ranges", lambda r: r["times"])), F.lit(1)).cast("int")
    again = met.withColumn("turn", F.explode(F.sequence(F.lit(1), most)))
    chosen = F.filter("ranges", lambda r: r["times"] >= F.col("turn"))
    again = again.withColumn("chosen", chosen).withColumn("words", F.aggregate("chosen", F.lit(0).cast("long"), lambda n, r: n + r["words"]))
    cut = F.regexp_extract_all("text", F.lit(_WORD_AND_BLANKS), F.lit(0))
    joined = F.array_join(F.flatten(F.transform("chosen", lambda r: F.slice("w", (r["first"] + 1).cast("int"), r["words"].cast("int")))), "")
    whole = (F.col("size") == 0) | (F.col("words") == F.col("size"))
    again = again.withColumn("w", F.when(~whole, cut)).withColumn("new", F.when(whole, F.col("text")).otherwise(F.rtrim(joined)))
    columns = {c: F.col("row").getField(c) for c in names}
    columns["text"] = F.col("new")
    if "n_chars" in names:
        columns["n_chars"] = F.when(whole, columns["n_chars"]).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return again.select(*(columns[c].alias(c) for c in names))
