"""Sizes and targets against plain Python; taken words near their targets."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm.mixing import MOST_TIMES, mix_corpus, mix_of, mix_of_documents, mixed, packed, permuted, targets, words_in

DATA = "/root/testdata/sf0.01"


def plain_targets(sizes):
    """By bisection on the level, not by resharing."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    low, high = 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * s, w * level) for s, w in zip(sizes, weights, strict=True)) < sum(sizes) else (low, level)
    return [min(3 * s, w * low) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("sizes", [[10], [5, 0, 7], [100, 1, 1], [1, 1, 1000, 3, 50], [0, 0]])
def test_targets(sizes):
    got = targets(sizes, [1 + i % 3 for i in range(len(sizes))])
    assert np.allclose(got, plain_targets(sizes), rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000])
def test_permutation(size):
    assert sorted(permuted(np.arange(size), size, "k").tolist()) == list(range(size))
    if size > 16:
        assert permuted(np.arange(size), size, "k").tolist() != permuted(np.arange(size), size, "l").tolist()


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text").collect()
    rows = [tuple(r) for r in mix_of_documents(spark, DATA).collect()]
    sizes = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    total: Counter = Counter()
    for i, n in sizes.items():
        total[source[i]] += n
    names = sorted(total)
    want = dict(zip(names, plain_targets([total[n] for n in names]), strict=True))
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for doc_id, size, source_size, target, n in rows:
        assert size == sizes[doc_id] and source_size == total[source[doc_id]] and 0 <= n <= MOST_TIMES * size
        assert target == pytest.approx(want[source[doc_id]])
        taken[source[doc_id]] += n
    for name in names:
        assert taken[name] == pytest.approx(want[name], rel=0.03)
    assert sorted(rows) == sorted(tuple(r) for r in mix_of_documents(spark, DATA).collect())


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i % 90, ["a", "b", None, "é"][i % 4], i % 37) for i in range(800)], "doc_id long, source string, size long")
    def rows(parts):
        sized = docs.repartition(parts).withColumn("uid", F.monotonically_increasing_id())
        return sorted(map(tuple, mixed(sized, block_words=8, shard_slots=64).select("doc_id", "size", "target", "taken").collect()))
    got = rows(1)
    assert got == rows(5) and len(got) == 800


def test_words(spark):
    texts = ["a b\tc\nd\x0be\x0cf\rg", "", None, " \t", "x y z", "\x1cq"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(words_in(F.col("text"))).collect()] == [7, 0, 0, 0, 1, 1]


def listed(mix):
    """Placements as a list, and the words of each document, source after source, in the order of the mix."""
    slots = sorted(map(tuple, mix.placements().collect()))
    return slots, sorted(map(tuple, mix.pieces().collect()))


def test_taken_against_a_walk_over_blocks(spark):
    docs = spark.createDataFrame([(i % 90, ["a", "b", None, "é"][i % 4], i % 37, i) for i in range(800)], "doc_id long, source string, size long, uid long")
    size = 8
    mix = mix_of(docs, block_words=size, shard_slots=64)
    slots, pieces = listed(mix)
    # Every word of every source is in one block, blocks are full but for the last, and a document's pieces follow one another.
    words, starts = defaultdict(int), defaultdict(list)
    for uid, at, block, first, n in pieces:
        words[at, block] += n
        starts[uid].append((first, n))
    for i, source in enumerate(mix.sources):
        assert [words[i, b] for b in range(source.blocks)] == [size] * (source.blocks - 1) + [source.size - size * (source.blocks - 1)]
    for uid, parts in starts.items():
        parts.sort()
        assert [f for f, _ in parts] == [sum(n for _, n in parts[:j]) for j in range(len(parts))] and sum(n for _, n in parts) == uid % 37
    # Each slot once, no block more often than allowed, shards about full.
    assert len({s[:2] for s in slots}) == len(slots)
    times = Counter(s[2:] for s in slots)
    assert max(times.values()) <= MOST_TIMES
    per_shard = Counter(s[0] for s in slots)
    assert all(sorted(s[1] for s in slots if s[0] == shard) == list(range(n)) for shard, n in per_shard.items())
    # A walk over the slots gives what is taken of each document.
    walked: Counter = Counter()
    held = defaultdict(list)
    for uid, at, block, _, n in pieces:
        held[at, block].append((uid, n))
    for _, _, at, block in slots:
        for uid, n in held[at, block]:
            walked[uid] += n
    assert {r.uid: r.taken for r in mixed(docs, block_words=size, shard_slots=64).collect()} == {uid: walked[uid] for uid in range(800)}


def test_blocks_of_the_mix_are_not_broadcast(spark):
    """Few runs of slots unfold into all blocks, so their size says nothing of what a broadcast would hold."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a' AS source", "40L AS size", "id AS uid").localCheckpoint()
    texts = docs.selectExpr("doc_id", "source", "repeat('w ', 40) AS text")
    for df in (mix_of(docs, block_words=2).taken(), packed(texts, block_words=2)):
        assert len(df.collect()) >= 50_000
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Join" in x and "block" in x]
        assert joins and not any("Broadcast" in x for x in joins)


def test_blocks_are_packed_with_their_words(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(i * 7 % 60)), f"s{i % 3}") for i in range(120)] + [(500, "\n lead  and\ttail \n", "s0"), (501, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {i: (t or "").split() for i, t, _ in rows}
    blocks = defaultdict(list)
    for r in packed(docs, block_words=16).collect():
        assert r.text.split() == texts[r.doc_id][r.first : r.first + r.words]
        blocks[r.shard, r.slot].append((r.part, r.words))
    assert all(sorted(p for p, _ in b) == list(range(1, len(b) + 1)) and sum(n for _, n in b) <= 16 for b in blocks.values())
    assert sum(sum(n for _, n in b) == 16 for b in blocks.values()) >= len(blocks) - 9


def test_many_stretches(spark):
    """Prefix sums over buckets and shards of one source that is nearly all."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), (F.col("id") % 5).alias("size"), F.col("id").alias("uid"))
    docs = docs.unionByName(docs.limit(10).withColumn("source", F.lit("b")).withColumn("uid", F.col("uid") + 100_000))
    mix = mix_of(docs, block_words=2, shard_slots=4)
    slots = mix.placements().groupBy("source_at", "block").count()
    assert slots.agg(F.max("count")).first()[0] <= MOST_TIMES
    taken = {r.source: r.n for r in mixed(docs, block_words=2, shard_slots=4).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    wanted = {s.name: s.target for s in mix.sources}
    assert taken["hot"] == pytest.approx(wanted["hot"], rel=0.01) and taken["b"] == pytest.approx(wanted["b"], rel=0.5, abs=20)


def test_corpus_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, size string, uid int, taken int, `a.b` int, __uid int"
    more = ("x", 2, 3, 4, 5)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(20 + i % 50)), "en", f"s{i % 5}", 1, *more) for i in range(400)]
    rows += [(900, None, None, None, None, *more), (901, "", "en", "s0", 0, *more), (None, "n1 n2 n3", "en", "s1", 8, *more), (None, "m1 m2", "en", "s1", 5, *more)]
    docs = spark.createDataFrame(rows, schema)
    out = mix_corpus(docs, block_words=16)
    assert out.columns == docs.columns
    got = out.collect()
    assert got == mix_corpus(docs.repartition(3), block_words=16).collect() or Counter(got) == Counter(mix_corpus(docs.repartition(3), block_words=16).collect())
    counts = Counter(r.doc_id for r in got)
    assert counts[900] == counts[901] == 1 and max(n for i, n in counts.items() if i is not None) <= MOST_TIMES
    texts = {r[0]: r[1] for r in rows[:400]}
    words: Counter = Counter()
    for r in got:
        if r.doc_id is None or r.doc_id >= 900:
            continue
        mine, all_ = r.text.split(), texts[r.doc_id].split()
        assert len(set(mine)) == len(mine) and [w for w in all_ if w in set(mine)] == mine
        assert (r.n_chars == len(r.text)) if len(mine) < len(all_) else (r.text == texts[r.doc_id] and r.n_chars == 1)
        words[r.source] += len(mine)
    sizes = [sum(len(r[1].split()) for r in rows[:400] if r[3] == f"s{k}") for k in range(5)]
    for k, t in enumerate(plain_targets(sizes)):
        assert words[f"s{k}"] == pytest.approx(t, rel=0.06)
    assert mix_corpus(docs.filter("doc_id < 0")).count() == 0


def test_one_dominating_document(spark):
    """Whole documents could give all of a source's words or none."""
    rows = [(0, " ".join(f"w{j}" for j in range(40_000)), "a")] + [(1 + i, " ".join(f"v{j}" for j in range(400)), "bc"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words: Counter = Counter()
    for r in mix_corpus(docs).collect():
        words[r.source] += len(r.text.split())
    for name, t in zip("abc", plain_targets([40_000, 40_000, 40_000]), strict=True):
        assert words[name] == pytest.approx(t, rel=0.03)
