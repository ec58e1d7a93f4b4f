"""Byte-level BPE with a bitmap queue of merge ranks.

All pre-tokens to merge lie behind one another in one linked list.  A bucket
per merge rank holds the positions whose pair has that rank; a hierarchy of
64-way bitmaps tells by find-first-set which bucket is next.  A whole bucket is
merged at once with numpy, entries that went stale are skipped, and new pairs
go into their buckets.  The work follows the bytes and the ranks they use, not
the square of a pre-token's length, so a pre-token of a megabyte is no worse
than as many short ones.

Defined cases: a null text counts as empty; an empty text has no ids; repeated
documents are encoded row by row; an empty table gives no rows; strings of
special tokens are ordinary text.  Columns besides the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from inkveil.llm.common import small_batches, table, text_rows

NONE = np.int32(2**31 - 1)
_SHIFT = 21
#: Characters of text worked on at one time, pre-tokens of one long text at one time, kept pre-tokens.
CHARS_AT_ONCE, PIECES_AT_ONCE, KEPT = 2_000_000, 500_000, 300_000
#: Longer pre-tokens are not kept.
KEPT_LENGTH = 48


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by rank, and the rank of each pair of tokens that makes a token."""

    tokens: list[bytes]
    pattern: str
    byte_ids: np.ndarray
    pairs: np.ndarray  # sorted left << _SHIFT | right
    merged: np.ndarray  # the rank of each
    early: np.ndarray  # whether a pair with this token can rank before the token itself


def load(path: str, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
    """Read a rank file: lines of a base64 token and its rank."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return build(ranks, pattern)


def build(ranks: dict[bytes, int], pattern: str) -> Vocabulary:
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the ranks lack the bytes {missing}")
    keys, values, early = [], [], np.zeros(size, bool)
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << _SHIFT | right)
                values.append(rank)
                early[[x for x in (left, right) if rank <= x]] = True
    order = np.argsort(np.array(keys, np.int64))
    return Vocabulary(
        tokens,
        pattern,
        np.array([ranks[bytes([b])] for b in range(256)], np.int32),
        np.array(keys, np.int64)[order],
        np.array(values, np.int32)[order],
        early,
    )


class RankQueue:
    """Buckets of positions by rank under a hierarchy of bitmaps."""

    def __init__(self, ranks: int) -> None:
        self.levels = []
        while True:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * ranks)
            if ranks == 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        ends = [*starts[1:].tolist(), len(ranks)]
        for rank, start, end in zip(ranks[starts].tolist(), starts.tolist(), ends, strict=True):
            bucket = self.buckets.get(rank)
            if bucket is None:
                self.buckets[rank] = [positions[start:end]]
                self._mark(rank)
            else:
                bucket.append(positions[start:end])

    def _mark(self, at: int) -> None:
        for level in self.levels:
            at, bit = at >> 6, at & 63
            before = level[at]
            level[at] = before | 1 << bit
            if before:
                return

    def _clear(self, at: int) -> None:
        for level in self.levels:
            at, bit = at >> 6, at & 63
            level[at] &= ~(1 << bit)
            if level[at]:
                return

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank and its positions, or None when all buckets are empty."""
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << 6 | (word & -word).bit_length() - 1
        self._clear(at)
        chunks = self.buckets.pop(at)
        return at, chunks[0] if len(chunks) == 1 else np.unique(np.concatenate(chunks))


def merge_all(pieces: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The ids of each piece (a non-empty byte string)."""
    if not pieces:
        return []
    lengths = np.array([len(p) for p in pieces])
    n = int(lengths.sum())
    ends = np.cumsum(lengths)
    ids = np.full(n + 1, -1, np.int64)
    ids[:n] = v.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces)), lengths)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = n  # the element behind the last is no part of any pair
    before[ends - lengths] = n
    alive = np.ones(n, bool)

    def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << _SHIFT | right
        keys[(left < 0) | (right < 0)] = -1
        found = np.minimum(np.searchsorted(v.pairs, keys), len(v.pairs) - 1)
        return np.where(v.pairs[found] == keys, v.merged[found], NONE)

    rank_at = np.full(n + 1, NONE, np.int32)
    if len(v.pairs):
        rank_at[:n] = rank_of(ids[:n], ids[after[:n]])
    queue = RankQueue(len(v.tokens))
    first = np.flatnonzero(rank_at != NONE)
    queue.push(rank_at[first], first)
    while (least := queue.pop()) is not None:
        rank, at = least
        at = at[rank_at[at] == rank]
        if len(at) > 1:
            if v.early[rank]:  # a new pair may go first: one merge per piece, then look again
                lead = np.concatenate(([True], piece[at[1:]] != piece[at[:-1]]))
                rest = at[~lead]
                queue.push(np.full(len(rest), rank), rest)
                at = at[lead]
            else:  # of pairs that share an element the left one goes first
                steps = np.arange(len(at))
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                at = at[(steps - np.maximum.accumulate(np.where(chained, 0, steps))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        behind = after[gone]
        ids[at] = rank
        after[at] = behind
        before[behind] = at
        alive[gone] = False
        rank_at[gone] = NONE
        ahead = before[at]
        places = np.concatenate((at, ahead[ahead != n]))
        rank_at[places] = new = rank_of(ids[places], ids[after[places]])
        some = new != NONE
        queue.push(new[some], places[some])
    kept = np.flatnonzero(alive)
    bounds = np.searchsorted(kept, ends)
    out, flat, start = [], ids[kept].tolist(), 0
    for end in bounds.tolist():
        out.append(flat[start:end])
        start = end
    return out


class Encoder:
    """Encodes texts; keeps the ids of pre-tokens it has met, a bounded number of them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.split = regex.compile(vocabulary.pattern)
        self.whole = {t.decode(): (i,) for i, t in enumerate(vocabulary.tokens) if t and _is_text(t)}
        self.kept: dict[str, tuple[int, ...]] = {}

    def _known(self, parts: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of these pre-tokens and of those kept."""
        whole, kept = self.whole, self.kept
        fresh = [p for p in parts if p not in kept]
        new = {p: whole[p] for p in fresh if p in whole}
        merge = [p for p in fresh if p not in new]
        new.update(zip(merge, map(tuple, merge_all([p.encode() for p in merge], self.v)), strict=True))
        if len(kept) + len(new) > KEPT:
            self.kept = kept = {p: kept[p] for p in parts if p in kept}
        short = {p: ids for p, ids in new.items() if len(p) <= KEPT_LENGTH}
        kept.update(short)
        return kept if len(short) == len(new) else kept | new

    def encode(self, texts: list[str]) -> Iterator[array]:
        """The ids of each text."""
        small = [self.split.findall(t) if len(t) <= CHARS_AT_ONCE else None for t in texts]
        known = self._known(set(chain.from_iterable(p for p in small if p)))
        for text, parts in zip(texts, small, strict=True):
            ids = array("i")
            if parts is not None:
                ids.extend(chain.from_iterable(map(known.__getitem__, parts)))
                yield ids
                continue
            matches = (m.group() for m in self.split.finditer(text))
            while parts := list(islice(matches, PIECES_AT_ONCE)):
                ids.extend(chain.from_iterable(map(self._known(set(parts)).__getitem__, parts)))
            yield ids


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def decode(ids, vocabulary: Vocabulary) -> bytes:
    return b"".join(map(vocabulary.tokens.__getitem__, ids))


def _lists(ids: list[array]) -> pa.Array:
    counts = np.array([0, *map(len, ids)], np.int32).cumsum(dtype=np.int32)
    flat = np.concatenate([np.frombuffer(i, np.int32) for i in ids]) if counts[-1] else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(counts), pa.array(flat))


def encoded(docs: DataFrame, vocabulary: Vocabulary, keys: list[str], text: str = "text") -> DataFrame:
    """The keys with ``ids``, the token ids of the text."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return _mapped(docs, vocabulary, keys, text, fields, lambda texts, ids: [_lists(ids)])


def round_trips(docs: DataFrame, vocabulary: Vocabulary, keys: list[str], text: str = "text") -> DataFrame:
    """The keys with ``ids`` and ``round_trip``: whether they decode to the text."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]

    def each(texts: list[str], ids: list[array]) -> list[pa.Array]:
        return [_lists(ids), pa.array([decode(i, vocabulary) == t.encode() for t, i in zip(texts, ids, strict=True)])]

    return _mapped(docs, vocabulary, keys, text, fields, each)


def digests(docs: DataFrame, vocabulary: Vocabulary, keys: list[str], text: str = "text") -> DataFrame:
    """The keys with the number of ids and digests of the ids and of the decoded bytes."""
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    written = [str(i) for i in range(len(vocabulary.tokens))]

    def each(texts: list[str], ids: list[array]) -> list[pa.Array]:
        listed = [hashlib.sha256(" ".join([written[i] for i in x]).encode()).hexdigest() for x in ids]
        back = [hashlib.sha256(decode(x, vocabulary)).hexdigest() for x in ids]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(listed), pa.array(back)]

    return _mapped(docs, vocabulary, keys, text, fields, each)


def _mapped(docs, vocabulary, keys, text, fields, each) -> DataFrame:
    chosen = docs.select(*keys, docs[text].alias("__text"))
    schema = T.StructType([*(f for f in chosen.schema.fields if f.name != "__text"), *fields])
    last, names = len(keys), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in text_rows(batches, last, CHARS_AT_ONCE):
            texts = [t or "" for t in part.column(last).to_pylist()]
            columns = each(texts, list(encoder.encode(texts)))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(last)), *columns], names=names)

    return chosen.transform(small_batches).mapInArrow(run, schema)


def encoding_of_documents(spark: SparkSession, directory: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every document."""
    vocabulary = load(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(table(spark, directory, "documents"), vocabulary, ["doc_id"])
