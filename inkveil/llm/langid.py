"""Language identification by unigrams of pieces, summed over all segmentations.

The pieces are a fixed public vocabulary.  A word's probability in a language
is the sum, over every way to cut it into pieces, of the product of the pieces'
probabilities; the forward algorithm adds them up.  Piece probabilities come
from expected counts over all training documents (forward-backward): in the
first round all pieces are equally likely, so the counts follow the shape of
words only, and each further round starts from the probabilities of the last.

Words of a batch that are equally long go through the lattice together, and a
bounded number of words is kept with its probabilities.  Learning sends one
number per piece and language out of a task, whatever the task has read.

Defined cases: a null text and one without a letter are ``und`` with score 0,
as is every text when nothing could be learned; ties go to the first language
by code point; documents without a language do not train; repeated documents
are judged row by row; an empty table gives no rows.  Characters that are no
piece count as their UTF-8 bytes, which are pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import fold, small_batches, table, text_rows

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Added to every expected count; rounds of learning; words kept in a task.
SMOOTHING, ROUNDS, KEPT = 0.01, 1, 200_000
_START = "▁"
_WORD = r"\p{L}+"
_RESCALE = 16


_BASE, _SLOT = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_BITS = 18
#: Characters of equally long words that are worked on together; longer words than this are learned from in logarithms.
_TOGETHER, _PLAIN = 65_536, 24
#: Sums whose logarithm may fall below this are taken in logarithms: far from a double's least, so that nothing that counts is lost.
_SMALL = -500.0


def _codes(words: list[str]) -> np.ndarray:
    """Code points (words, characters); the words are equally long."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


@dataclass(frozen=True)
class Pieces:
    """Numbers of the pieces by a hash of their characters, and of the pieces that stand for single bytes."""

    keys: np.ndarray  # by number; 0 for those that are no text
    slots: np.ndarray  # open addressing; -1 where empty
    of_byte: tuple[int, ...]
    longest: int

    @property
    def size(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, -1 for none."""
        shape, hashes = hashes.shape, hashes.ravel()
        slot = (hashes * _SLOT >> np.uint64(64 - _BITS)).astype(np.int64)
        out = self.slots[slot]
        again = np.flatnonzero((out >= 0) & (self.keys[out] != hashes))
        while len(again):
            slot[again] = slot[again] + 1 & (1 << _BITS) - 1
            out[again] = self.slots[slot[again]]
            again = again[(out[again] >= 0) & (self.keys[out[again]] != hashes[again])]
        return out.reshape(shape)


def make_pieces(texts: dict[int, str], of_byte: dict[int, int], size: int) -> Pieces:
    """``texts``: number and characters of each piece that is a text."""
    keys, slots = np.zeros(size, np.uint64), np.full(1 << _BITS, -1, np.int32)
    if 2 * len(texts) > len(slots):
        raise ValueError("too many pieces")
    for number, text in texts.items():
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c)) % 2**64
        keys[number] = h
        slot = h * int(_SLOT) % 2**64 >> 64 - _BITS
        while slots[slot] >= 0:
            slot = slot + 1 & (1 << _BITS) - 1
        slots[slot] = number
    return Pieces(keys, slots, tuple(of_byte[b] for b in range(256)), max(map(len, texts.values())))


def load_pieces(path: str) -> Pieces:
    """The vocabulary of a sentencepiece model that has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, of_byte = {}, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            texts[i] = piece
    return make_pieces(texts, of_byte, model.get_piece_size())


class Lattice:
    """All segmentations of words, each with a word start before it, into pieces."""

    def __init__(self, pieces: Pieces, probability: np.ndarray, start: str = _START) -> None:
        """``probability``: (pieces, columns); a column is a language."""
        self.pieces, self.columns, self.start = pieces, probability.shape[1], start
        self.rare: dict[int, int] = {}  # code points that are no piece
        self.table = np.vstack((probability, np.zeros((1, self.columns))))  # the last row: no such piece
        with np.errstate(divide="ignore"):
            self.logs = np.log(self.table)
        self.low = self.logs.min(1, initial=0.0)

    def _rare(self, code: int) -> int:
        """The number of a character that is no piece: its bytes' probabilities multiplied."""
        found = self.rare.get(code)
        if found is None:
            at = [self.pieces.of_byte[b] for b in chr(code).encode("utf-8", "surrogatepass")]
            logs = self.logs[at].sum(0)
            self.rare[code] = found = self.pieces.size + len(self.rare)
            self.table = np.vstack((self.table[:-1], self.table[at].prod(0), self.table[-1:]))
            self.logs = np.vstack((self.logs[:-1], logs, self.logs[-1:]))
            self.low = np.concatenate((self.low[:-1], [logs.min(initial=0.0)], self.low[-1:]))
        return found

    def edges(self, words: list[str]) -> list[np.ndarray]:
        """For each length from 1 the numbers (words, places) of the pieces that begin there, -1 for none."""
        codes = _codes([self.start + w for w in words])
        n = codes.shape[1]
        hashes, out = codes, []
        for length in range(1, min(n, self.pieces.longest) + 1):
            if length > 1:
                hashes = hashes[:, :-1] * _BASE + codes[:, length - 1 :]
            numbers = self.pieces.find(hashes)
            if length == 1 and (numbers < 0).any():
                numbers = numbers.copy()
                for code in np.unique(codes[numbers < 0]).tolist():
                    numbers[(numbers < 0) & (codes == code)] = self._rare(code)
            out.append(numbers)
        return out

    def log_probability(self, words: list[str]) -> np.ndarray:
        """(words, columns)."""
        out = np.empty((len(words), self.columns))
        for rows, same in _by_length(words):
            edges = self.edges(same)
            small = self._small(edges, self.low, self.pieces.longest + _RESCALE)
            for some, forward in ((~small, self._forward), (small, self._forward_logs)):
                if some.all():
                    out[rows] = forward(edges)
                elif some.any():
                    out[rows[some]] = forward([e[some] for e in edges])
        return out

    def _small(self, edges: list[np.ndarray], low: np.ndarray, reach: int) -> np.ndarray:
        """Which words have ``reach`` characters in a row that, one by one, are too unlikely for plain sums."""
        along = low[edges[0]].cumsum(1)
        along = np.hstack((np.zeros((len(along), 1)), along))
        reach = min(reach, along.shape[1] - 1)
        return ~((along[:, reach:] - along[:, : along.shape[1] - reach]).min(1) >= _SMALL)

    def _forward_logs(self, edges: list[np.ndarray]) -> np.ndarray:
        words, n = edges[0].shape
        sums = [np.zeros((words, self.columns))]
        for end in range(1, n + 1):
            parts = [sums[end - k - 1] + self.logs[edges[k][:, end - k - 1]] for k in range(min(end, len(edges)))]
            sums.append(np.logaddexp.reduce(parts))
        return sums[n]

    def _forward(self, edges: list[np.ndarray]) -> np.ndarray:
        weight = [self.table[e] for e in edges]
        words, n = edges[0].shape
        sums, scale = [np.ones((words, self.columns))], np.zeros((words, self.columns))
        for end in range(1, n + 1):
            total = sums[end - 1] * weight[0][:, end - 1]
            for length in range(2, min(end, len(edges)) + 1):
                total += sums[end - length] * weight[length - 1][:, end - length]
            sums.append(total)
            if end % _RESCALE == 0:  # what later positions can still reach is brought back to size
                recent = range(max(0, end - self.pieces.longest), end + 1)
                top = np.maximum.reduce([sums[i] for i in recent])
                top = np.where(top > 0, top, 1)
                for i in recent:
                    sums[i] = sums[i] / top
                scale += np.log(top)
        with np.errstate(divide="ignore"):
            return np.log(sums[n]) + scale

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected numbers of pieces, (pieces, columns of counts).

        ``counts``: (words, languages).  With one column of probabilities it
        serves all languages, otherwise each has its own.
        """
        out = np.zeros((self.pieces.size, counts.shape[1]))
        for rows, same in _by_length(words):
            edges = self.edges(same)
            for first in range(self.columns):
                every = slice(None) if self.columns == 1 else slice(first, first + 1)
                n = edges[0].shape[1]
                small = self._small(edges, self.logs[:, first], n) if n <= _PLAIN else np.ones(len(rows), bool)
                for some, plain in ((~small, True), (small, False)):
                    if some.all():
                        self._add(out[:, every], edges, first, counts[rows][:, every], plain)
                    elif some.any():
                        self._add(out[:, every], [e[some] for e in edges], first, counts[rows[some]][:, every], plain)
        return out

    def _add(self, out: np.ndarray, edges: list[np.ndarray], column: int, counts: np.ndarray, plain: bool) -> None:
        """Forward and backward sums, plain or in logarithms."""
        words, n = edges[0].shape
        plus, times = (np.add, np.multiply) if plain else (np.logaddexp, np.add)
        weight = [(self.table if plain else self.logs)[e, column] for e in edges]
        one = np.full(words, 1.0 if plain else 0.0)
        ahead, behind = [one], {n: one}
        for end in range(1, n + 1):
            parts = [times(ahead[end - k - 1], weight[k][:, end - k - 1]) for k in range(min(end, len(edges)))]
            ahead.append(plus.reduce(parts))
        for at in range(n - 1, -1, -1):
            parts = [times(behind[at + k + 1], weight[k][:, at]) for k in range(min(n - at, len(edges)))]
            behind[at] = plus.reduce(parts)
        ahead, behind = np.stack(ahead, 1), np.stack([behind[i] for i in range(n + 1)], 1)
        whole = ahead[:, n:]
        for k, numbers in enumerate(edges):
            through = times(times(ahead[:, : n - k], weight[k]), behind[:, k + 1 :])
            row, place = np.nonzero(numbers >= 0)
            share = through[row, place] / whole[row, 0] if plain else np.exp(through[row, place] - whole[row, 0])
            found = numbers[row, place]
            for j in range(counts.shape[1]):
                sums = np.bincount(found, share * counts[row, j], self.pieces.size + len(self.rare))
                out[:, j] += sums[: self.pieces.size]
                for code, number in self.rare.items() if k == 0 else ():
                    for b in chr(code).encode("utf-8", "surrogatepass"):
                        out[self.pieces.of_byte[b], j] += sums[number]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(lengths[order]) > 0))) if len(words) else []
    for rows in np.split(order, starts[1:]) if len(words) else ():
        step = max(1, _TOGETHER // (1 + len(words[rows[0]])))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, [words[i] for i in part.tolist()]


def words_of(text: str, pattern: regex.Pattern) -> list[str]:
    return pattern.findall(text.lower())


@dataclass(frozen=True)
class Model:
    languages: list[str]
    probability: np.ndarray  # (pieces, languages)
    prior: np.ndarray  # logarithms


def learn(
    docs: DataFrame, pieces: Pieces, text: str = "text", lang: str = "lang", rounds: int = ROUNDS, smoothing: float = SMOOTHING
) -> Model:
    """Learn from all rows that have a text and a language."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = None
    for _ in range(rounds):
        sums = rows.transform(small_batches).mapInArrow(_expected(pieces, model), "lang string, piece int, n double")
        got = sums.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = got[got["piece"] >= 0]
        documents = got[got["piece"] < 0].set_index("lang")["n"]
        languages = sorted(documents.index)
        if not languages:
            return Model([], np.zeros((pieces.size, 0)), np.zeros(0))
        total = np.full((pieces.size, len(languages)), smoothing)
        column = {name: i for i, name in enumerate(languages)}
        np.add.at(total, (counts["piece"].to_numpy(int), counts["lang"].map(column).to_numpy(int)), counts["n"].to_numpy(float))
        share = np.array([documents[name] for name in languages], float)
        model = Model(languages, total / total.sum(0), np.log(share / share.sum()))
    return model


def _expected(pieces: Pieces, model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(_WORD)
        start = np.full((pieces.size, 1), 1 / pieces.size) if model is None else model.probability
        documents: Counter = Counter()
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def settle() -> None:
            if model is not None:
                for name in model.languages:
                    words.setdefault(name, Counter())
            names = sorted(words) if model is None else model.languages
            every = list({w for c in words.values() for w in c})
            lattice = Lattice(pieces, start)
            for at in range(0, len(every), 16384):
                part = every[at : at + 16384]
                counts = np.array([[words[name].get(w, 0) for w in part] for name in names], float).T
                found = lattice.expected(part, counts)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + found[:, k]
            words.clear()

        for batch in text_rows(batches, 1):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                documents[name] += 1
                words.setdefault(name, Counter()).update(words_of(text, pattern))
            if sum(map(len, words.values())) > KEPT:
                settle()
        settle()
        for name, n in documents.items():
            found = sums.get(name, np.zeros(pieces.size))
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(some) + 1)), pa.array([-1, *some.tolist()], pa.int32()), pa.array([float(n), *found[some].tolist()])],
                names=["lang", "piece", "n"],
            )

    return run


def identified(docs: DataFrame, model: Model, pieces: Pieces, keys: list[str], text: str = "text") -> DataFrame:
    """The keys with ``lang_pred`` and ``score``, the posterior probability of that language."""
    chosen = docs.select(*keys, F.col(text).alias("__text"))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*(f for f in chosen.schema.fields if f.name != "__text"), *fields])
    last, names = len(keys), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(_WORD)
        lattice = Lattice(pieces, model.probability)
        at: dict[str, int] = {}
        values = np.zeros((0, len(model.languages)))
        for batch in text_rows(batches, last):
            found = [words_of(t or "", pattern) for t in batch.column(last).to_pylist()]
            new = list({w for words in found for w in words if w not in at}) if model.languages else []
            if len(at) + len(new) > KEPT:
                new = list({w for words in found for w in words}) if model.languages else []
                at, values, lattice = {}, values[:0], Lattice(pieces, model.probability)
            if new:
                at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
                values = np.vstack((values, lattice.log_probability(new)))
            predicted, scores = [], []
            for words in found:
                if not words or not model.languages:
                    predicted.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = model.prior + values[[at[w] for w in words]].sum(0)
                best = int(total.argmax())
                predicted.append(model.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(last)), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], names=names
            )

    return chosen.transform(small_batches).mapInArrow(run, schema)


def languages_of_documents(spark: SparkSession, directory: str, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    docs = table(spark, directory, "documents")
    pieces = load_pieces(path or public_tokenizers.path("piece_bpe_32k.model"))
    model = learn(docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT), pieces)
    return identified(docs, model, pieces, ["doc_id"]).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )
