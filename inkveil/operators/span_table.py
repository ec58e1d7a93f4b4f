"""Entity spans as a table of any size, chosen and put in by many tasks.

Of overlapping spans the one that starts first stands (the longest of those
that start together); a span is kept if it starts where the last kept one
ended, or later.  That goes from span to span through a text.  Here a text is
cut into stretches of positions.  Each stretch works out, for every place where
an earlier span may end, where its own last kept span then ends; as different
beginnings soon meet, that is a short list.  Chaining the lists, one line per
stretch, tells each stretch where to begin, and all stretches choose at once.

Long texts are cut into chunks, each of which takes the spans that touch it, so
neither the spans nor the text of a long document are one task's work; only the
finished chunks of a text are put together again.  Texts of one stretch are
chosen for and filled in as they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.sql import let, name, strings
from inkveil.functions.text import chunks, cut
from inkveil.operators.entities import redactable
from inkveil.operators.redact import redact
from inkveil.rules import DEFAULT_RULES, RuleSet
from inkveil.sources.shared import written

#: Positions of a stretch; characters of a chunk.
STRETCH, CHUNK = 1 << 16, 1024


def _firsts(part: pa.Table) -> np.ndarray:
    """Where another (text, stretch) begins."""
    key, stretch = part.column(0).combine_chunks(), part.column(1).to_numpy()
    if pa.types.is_nested(key.type):
        told = key.to_pylist()
        other = np.fromiter((a != b for a, b in zip(told[1:], told[:-1], strict=True)), bool, len(told) - 1)
    else:
        other = np.diff(key.dictionary_encode().indices.to_numpy()) != 0
    return np.flatnonzero(np.concatenate(([True], other | (np.diff(stretch) != 0))))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in parts of whole (text, stretch) groups, and where in a part each group begins."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        first = _firsts(held)
        if len(first) > 1:
            yield held.slice(0, first[-1]), first[:-1]
            held = held.slice(first[-1])
    if held is not None:
        yield held, _firsts(held)


def _next(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The span that is kept behind each one: the first that starts at its end or later."""
    return np.searchsorted(starts, ends)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per stretch: (up_to, ends): beginning at ``up_to[i]`` or before, the last kept span ends at ``ends[i]``."""
    schema = None
    for part, first in _whole(batches):
        for at, to in zip(first.tolist(), [*first[1:].tolist(), part.num_rows], strict=True):
            group = part.slice(at, to - at)
            starts, ends = (group.column(c).to_numpy() for c in (2, 3))
            after, last = _next(starts, ends), ends.copy()
            for i in range(len(starts) - 1, -1, -1):
                if after[i] < len(starts):
                    last[i] = last[after[i]]
            turns = np.flatnonzero(np.append(last[1:] != last[:-1], True))
            schema = schema or pa.schema([part.schema.field(0), ("stretch", pa.int64()), ("up_to", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_arrays(
                [group.column(0).slice(0, 1).combine_chunks(), group.column(1).slice(0, 1).combine_chunks(),
                 pa.array([starts[turns]], pa.list_(pa.int64())), pa.array([last[turns]], pa.list_(pa.int64()))],
                schema=schema,
            )


#: More than any position; sets groups apart that are searched together.
_APART = 1 << 32


def _greedy(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, begin: np.ndarray) -> list[int]:
    """The kept ones of groups that begin at ``first``, each from its ``begin`` on."""
    group = np.zeros(len(starts), np.int64)
    group[first[1:]] = 1
    apart = group.cumsum() * _APART
    after = _next(starts + apart, ends + apart).tolist()
    begins = np.searchsorted(starts + apart, begin + apart[first]).tolist()
    chosen = []
    for at, to in zip(begins, [*first[1:].tolist(), len(starts)], strict=True):
        while at < to:
            chosen.append(at)
            at = after[at]
    return chosen


def _taken(part: pa.Table, columns: list[int], rows: list[int] | np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in part.select(columns).take(pa.array(rows, pa.int64())).combine_chunks().to_batches():
        yield pa.RecordBatch.from_arrays(batch.columns, names=names)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, stretch, start, end, begin, label_at) to (text, start, end, label_at) of the kept ones."""
    for part, first in _whole(batches):
        starts, ends, begin = (part.column(c).to_numpy() for c in (2, 3, 4))
        yield from _taken(part, [0, 2, 3, 5], _greedy(starts, ends, first, begin[first]), ["key", "start_char", "end_char", "label_at"])


_SPAN = ["key", "stretch", "start_char", "end_char", "label_at", "far"]


def _inside(batches: Iterator[pa.RecordBatch], labels: int, stretch: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (text, stretch, start, rank, length) to ``_SPAN``: of the spans that start at one place the longest inside the text.

    A stretch begins with a row of the text's length, at start -1; without one there is no such text.
    """
    held = None  # that row of the last stretch, and its last span
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        seen = 0 if held is None else held.num_rows
        part = part if held is None else pa.concat_tables([held, part])
        first, start, rank, length = _firsts(part), *(part.column(c).to_numpy() for c in (2, 3, 4))
        group = np.zeros(len(start), np.int64)
        group[first[1:]] = 1
        group = group.cumsum()
        size = np.where(start[first] == -1, length[first], 0)[group]
        label_at = rank % labels
        end = (label_at - rank) // labels
        rows = np.flatnonzero((start >= 0) & (end <= size))
        new = np.append(True, (np.diff(group[rows]) != 0) | (np.diff(start[rows]) != 0))[: len(rows)]
        rows = rows[new]
        last = rows[group[rows] == group[-1]][-1:]
        held = part.take(pa.array([*first[-1:].tolist(), *[r for r in last.tolist() if r != first[-1]]], pa.int64())).combine_chunks()
        rows = rows[rows >= seen]
        spans = part.select([0, 1, 2]).append_column("end_char", pa.array(end)).append_column("label_at", pa.array(label_at.astype(np.int32)))
        yield from _taken(spans.append_column("far", pa.array(size > stretch)), list(range(6)), rows, _SPAN)


def _near_kept(labels: int, stretch: int):
    """Rows as for ``_inside`` to ``_SPAN``: the kept ones of texts of one stretch, and all of longer texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first in _whole(_inside(batches, labels, stretch)):
            starts, ends, far = part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(5).to_numpy()
            kept = far.copy()
            kept[_greedy(starts, ends, first, np.zeros(len(first), np.int64))] = True
            yield from _taken(part, list(range(6)), np.flatnonzero(kept), _SPAN)

    return run


def _labels(rules: RuleSet) -> list[tuple[str, str]]:
    """Labels that have a tag, with it, in Spark's order of strings."""
    return sorted(((k, v) for k, v in rules.entity_tags.items() if v), key=lambda pair: pair[0].encode())


def _placed(spans: DataFrame, key: str, rules: RuleSet) -> DataFrame:
    """(key, start_char, end_char, rank, text) of the spans that are to be put in; rank: end and label in one number, the farthest end first."""
    labels = _labels(rules)
    label_at = f"array_position(array({strings(k for k, _ in labels)}), label) - 1"
    rank = F.expr(f"bigint(-end_char) * {len(labels)} + {label_at}")
    return redactable(spans, rules).select(F.col(name(key)).alias("key"), "start_char", "end_char", rank.alias("rank"), "text")


def _longest(df: DataFrame, key: str, column: str, spans: DataFrame, rules: RuleSet, stretch: int) -> DataFrame:
    """``_SPAN`` and text: of the spans that start at one place the longest inside the text.

    Of equally long ones the first by label stands, then by text.  ``far`` tells
    texts of more than one stretch.
    """
    labels = len(_labels(rules))
    inside = _placed(spans, key, rules).join(_sizes(df, key, column), "key").where("start_char >= 0 AND start_char < end_char AND end_char <= length")
    longest = inside.groupBy("key", F.col("start_char").cast("long").alias("start_char")).agg(
        F.min(F.struct("rank", "text")).alias("best"), F.max("length").alias("length")
    )
    at = f"pmod(best.rank, {labels})"
    return longest.selectExpr(
        "key", f"start_char DIV {stretch} AS stretch", "start_char", f"({at} - best.rank) DIV {labels} AS end_char",
        f"int({at}) AS label_at", f"length > {stretch} AS far", "best.text AS text",
    )


def _chained(far: DataFrame) -> DataFrame:
    """``far`` (``_longest`` of texts of several stretches, written) with ``begin``: where the last span kept before its stretch ends."""
    kind = far.schema["key"].dataType.simpleString()
    narrow = far.select("key", "stretch", "start_char", "end_char")
    sorted_ = narrow.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "start_char")
    exits = sorted_.mapInArrow(_exits, f"key {kind}, stretch long, up_to array<long>, ends array<long>")
    # One line per stretch of a text: its length bounds them.
    lines = exits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("stretch", "up_to", "ends"))).alias("lines"))
    goes_on = "filter(arrays_zip(l.up_to, l.ends), x -> x.up_to >= acc.begin)"
    step = let("on", goes_on, "if(size(on) > 0, on[0].ends, acc.begin)")
    chained = (
        "aggregate(lines, named_struct('begin', 0L, 'out', CAST(array() AS array<struct<stretch:bigint,begin:bigint>>)),"
        f" (acc, l) -> named_struct('begin', {step}, 'out', concat(acc.out,"
        " array(named_struct('stretch', l.stretch, 'begin', acc.begin)))), acc -> acc.out)"
    )
    begins = lines.select("key", F.expr(f"inline({chained})"))
    return far.join(begins, ["key", "stretch"])


def _chosen(begun: DataFrame) -> DataFrame:
    """(key, start_char, end_char, label_at) of the kept ones among spans with ``begin``."""
    kind = begun.schema["key"].dataType.simpleString()
    begun = begun.select("key", "stretch", "start_char", "end_char", "begin", "label_at")
    begun = begun.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "start_char")
    return begun.mapInArrow(_kept, f"key {kind}, start_char long, end_char long, label_at int")


def _told(rules: RuleSet, field: int) -> str:
    """The label (0) or the tag (1) of ``label_at``."""
    return f"array({strings(pair[field] for pair in _labels(rules))})[label_at]"


def chosen_spans(df: DataFrame, key: str, column: str, spans: DataFrame, rules: RuleSet = DEFAULT_RULES, stretch: int = STRETCH) -> DataFrame:
    """(key, start_char, end_char, label, text, tag) of the spans that are put in.

    ``spans`` has the key, start_char, end_char, label and text; ``df``, read
    for the lengths of its texts, has one row per key.
    """
    every = written(_longest(df, key, column, spans, rules, stretch), "spans")
    # The first stretch of a text begins at its beginning, so only texts of several are chained.
    near = every.where("NOT far").withColumn("begin", F.lit(0).cast("long"))
    begun = near.unionByName(_chained(every.where("far")).select(*near.columns))
    met = every.select("key", "start_char", "text").join(_chosen(begun), ["key", "start_char"])
    return met.selectExpr("key", "start_char", "end_char", f"{_told(rules, 0)} AS label", "text", f"{_told(rules, 1)} AS tag")


def _sizes(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, length, rows): of the longest text of each key, and how many there are."""
    lengths = df.groupBy(F.col(name(key)).alias("key")).agg(F.max(F.char_length(name(column))).alias("length"), F.count("*").alias("rows"))
    return lengths.where("key IS NOT NULL")


def chosen_tags(
    df: DataFrame, key: str, column: str, spans: DataFrame, rules: RuleSet = DEFAULT_RULES, stretch: int = STRETCH, sizes: DataFrame | None = None
) -> DataFrame:
    """The same without label and text, (key, start_char, end_char, tag): what ``put_in`` needs.

    Spans and the lengths of texts are dealt by stretch together, once; texts
    of one stretch are done there.  ``sizes`` are those of ``df``, if known.
    """
    sizes = _sizes(df, key, column) if sizes is None else sizes
    labels = len(_labels(rules))
    heads = sizes.where("length > 0").selectExpr(
        "key", f"explode(sequence(0L, (length - 1) DIV {stretch})) AS stretch", "-1L AS start_char", "0L AS rank", "bigint(length) AS length"
    )
    placed = _placed(spans, key, rules).where("key IS NOT NULL AND start_char >= 0 AND start_char < end_char")
    placed = placed.selectExpr("key", f"bigint(start_char) DIV {stretch} AS stretch", "bigint(start_char) AS start_char", "rank", "0L AS length")
    dealt = heads.unionByName(placed).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "start_char", "rank")
    kind = dealt.schema["key"].dataType.simpleString()
    schema = f"key {kind}, stretch long, start_char long, end_char long, label_at int, far boolean"
    every = written(dealt.mapInArrow(_near_kept(labels, stretch), schema), "spans")
    done = every.where("NOT far").select("key", "start_char", "end_char", "label_at")
    return done.unionByName(_chosen(_chained(every.where("far")))).selectExpr("key", "start_char", "end_char", f"{_told(rules, 1)} AS tag")


def _in_chunks(df: DataFrame, key: str, column: str, chosen: DataFrame, chunk: int) -> DataFrame:
    """(__key, __new): the texts with their tags, chunk by chunk in many tasks; texts of equal key are taken together."""
    text = name(column)
    first, last = f"(start_char DIV {chunk})", f"((end_char - 1) DIV {chunk})"
    touched = chosen.selectExpr("key", "start_char", "end_char", "tag", f"explode(sequence({first}, {last})) AS n")
    # Within a chunk: from, to, and the tag where the span begins.
    part = (
        f"struct(int(greatest(start_char - n * {chunk}, 0)) AS first, int(least(end_char - n * {chunk}, {chunk})) AS last,"
        f" if(start_char DIV {chunk} = n, tag, '') AS tag)"
    )
    of_chunk = touched.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.expr(part))).alias("spans"))
    pieces = f"transform(sequence(0L, char_length({text}) DIV {chunk}), i -> substring({text}, int(i * {chunk}) + 1, {chunk}))"
    whole = df.select(F.col(name(key)).alias("key"), F.col(text).alias("whole"))
    whole = whole.join(chosen.select("key").distinct(), "key", "left_semi")
    pieces = pieces.replace(text, "whole")
    chunks = whole.selectExpr("key", f"posexplode({pieces}) AS (n, chunk)").withColumn("n", F.col("n").cast("long"))
    gap = "substring(chunk, if(i = 0, 0, spans[i - 1].last) + 1, s.first - if(i = 0, 0, spans[i - 1].last))"
    done = (
        f"if(spans IS NULL, chunk, concat(array_join(transform(spans, (s, i) -> concat({gap}, s.tag)), ''),"
        " substring(chunk, element_at(spans, -1).last + 1)))"
    )
    # Spark judges lists by their columns, not by how long they are.
    finished = chunks.join(of_chunk.hint("merge"), ["key", "n"], "left").selectExpr("key", "n", f"{done} AS chunk")
    texts = finished.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "chunk"))).alias("__chunks"))
    return texts.selectExpr("key AS __key", "array_join(transform(__chunks, c -> c.chunk), '') AS __new")


def _in_rows(df: DataFrame, key: str, column: str, chosen: DataFrame) -> DataFrame:
    """``df`` with the spans of each text put in beside it."""
    listed = chosen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "tag"))).alias("__spans"))
    met = df.join(listed.withColumnRenamed("key", "__of").hint("merge"), F.col(name(key)) == F.col("__of"), "left")
    text, before = name(column), "if(i = 0, 0L, __spans[i - 1].end_char)"
    spliced = let(
        "pieces", chunks(text),
        f"concat(array_join(transform(__spans, (s, i) -> concat({cut('pieces', before, 's.start_char')}, s.tag)), ''),"
        f" {cut('pieces', 'element_at(__spans, -1).end_char', f'char_length({text})')})",
    )
    done = f"if(__spans IS NULL, {text}, {spliced}) AS {text}"
    return met.selectExpr(*[done if c == column else name(c) for c in df.columns])


def put_in(
    df: DataFrame, key: str, column: str, chosen: DataFrame, chunk: int = CHUNK, row_chars: int = STRETCH, sizes: DataFrame | None = None
) -> DataFrame:
    """``df`` with the tags of ``chosen`` (spans that do not overlap) in place of what they cover.

    Texts up to ``row_chars`` are moved to their spans once; longer ones, and
    those of one key, go chunk by chunk.  ``sizes`` are those of ``df``, if known.
    """
    sizes = _sizes(df, key, column) if sizes is None else sizes
    apart = written(sizes.where(f"rows > 1 OR length > {row_chars}").select("key"), "apart")
    if apart.isEmpty():
        return _in_rows(df, key, column, chosen)
    done = _in_rows(df, key, column, chosen.join(apart, "key", "left_anti"))
    whole = df.select(name(key), name(column)).join(apart.toDF("__apart"), F.col(name(key)) == F.col("__apart"), "left_semi")
    texts = _in_chunks(whole, key, column, chosen.join(apart, "key", "left_semi"), chunk)
    met = done.join(texts, F.col(name(key)) == F.col("__key"), "left")
    return met.select(*[F.coalesce("__new", F.col(name(c))).alias(c) if c == column else F.col(name(c)) for c in df.columns])


def redact_entity_table(df: DataFrame, key: str, column: str, spans: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Replace the spans of a table by their tags; ``key`` is unique in ``df``, which is read twice."""
    sizes = written(_sizes(df, key, column), "sizes")
    chosen = written(chosen_tags(df, key, column, spans, rules, sizes=sizes), "chosen")
    return put_in(df, key, column, chosen, sizes=sizes)


def redact_with_span_table(
    df: DataFrame,
    key: str,
    column: str,
    tagger: Callable[[DataFrame], DataFrame],
    rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """The full cascade; ``tagger`` gives the table of spans of the texts after the patterns."""
    before = written(redact(df, column, rules, ("context", "pattern")), "patterns")
    done = redact_entity_table(before, key, column, tagger(before), rules)
    return redact(done, column, rules, ("keyword", "merge"))


def entity_audit(chosen: DataFrame, log: str = "entry") -> DataFrame:
    """(key, entry) of every span put in, in the form of a log (``redact.LOG_TYPE``'s elements)."""
    entry = (
        "named_struct('phase', 3, 'ord', 0, 'tag', tag, 'original', text, 'reason', concat('NER: ', label))"
    )
    return chosen.selectExpr("key", f"{entry} AS {name(log)}")
