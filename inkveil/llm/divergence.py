"""How far the sources of a language are apart, by their terms, on count-level bitmaps.

One scan counts terms per language and source; a task adds up what it reads
before anything is shuffled.  The terms that enough documents of a language
hold get ids in order of frequency.  For every group (language and source) and
every count, the ids of the terms with this count are a bitset in words of 64;
only words with a set bit are rows.  As neighbouring ids are about equally
frequent, a word holds few levels of counts, and terms that share a level share
a row.

For two groups, AND and popcount of their levels give the joint cells: how many
terms have this count here and that count there.  A cell is multiplied by the
divergence of its two counts.  Cells with a zero are complements: a level's
size less its cells with the other group's levels, and all terms less both
groups' sets.  Written out, that is a sum over cells that are there, a sum over
each group's levels, and one product, so that absent terms are never listed.

Words are the unit of the join: no group, however large, and no term, however
frequent, is one task's work.  What is returned holds all pairs of sources of a
language, by its nature.

Defined cases: null text, language and source count as empty strings; a group
without terms has count 0 for every kept term; a language without kept terms
has value 0 for every pair and no terms; repeated documents count each; an
empty table gives no rows.  Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import small_batches, table, text_rows, written

LEAST_DOCUMENTS, PRIOR, SCALE, TOP = 10, 2, 1_000_000_000, 10
WORD_BITS = 64
#: Different (group, term) counts that a task holds before it hands them on.
HELD = 300_000
_DOCUMENT = 1 << 40
_SEPARATORS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Bytes of UTF-8: separators to blanks, A-Z to a-z, all others to themselves.
_FOLD = bytes(32 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents, handed on whenever there are many."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            found = list(terms.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(lang), len(terms)),
                    pa.repeat(pa.scalar(source), len(terms)),
                    pa.array(list(terms), pa.binary()).cast(pa.string()),
                    pa.array([n % _DOCUMENT for n in found], pa.int64()),
                    pa.array([n // _DOCUMENT for n in found], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "documents"],
            )

    for batch in text_rows(batches, 2):
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for lang, source, text in zip(langs, sources, texts, strict=True):
            terms = held.setdefault((lang, source), {})
            before = len(terms)
            for term, n in Counter(text.translate(_FOLD).split()).items():
                terms[term] = terms.get(term, 0) + n + _DOCUMENT
            size += len(terms) - before
        if size > HELD:
            yield from handed_on()
            held, size = {}, 0
    yield from handed_on()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, documents): occurrences, and documents with the term."""
    empty = F.lit("")
    rows = docs.select(F.coalesce(docs[lang], empty).alias("lang"), F.coalesce(docs[source], empty).alias("source"), F.coalesce(docs[text], empty).alias("text"))
    parts = small_batches(rows).mapInArrow(_partial, "lang string, source string, term string, n long, documents long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (size + PRIOR * terms)), exactly; 1 without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(27,0)")
    below = F.nullif((size + PRIOR * terms).cast("decimal(27,0)"), F.lit(0))
    return F.coalesce(F.call_function("div", above, below) + 1, F.lit(1)).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so longs hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """The tables that both reports need; intermediate ones are written."""

    def __init__(self, docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> None:
        counts = written(term_counts(docs), "counts")
        terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents"))
        terms = terms.filter(F.col("documents") >= least_documents).drop("documents")
        order = [F.col("lang"), F.col("total").desc(), F.col("term")]
        numbered = terms.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
        terms = written(numbered, "terms")
        #: lang, term, source, n, total (in the language), id
        self.kept = written(counts.drop("documents").join(terms, ["lang", "term"]), "kept")
        of_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
        of_group = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        empty = F.lit("")
        occurring = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
        known = occurring.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["terms", "lang_size", "size"])
        #: lang, source, terms, lang_size, size, zero (the share of count 0)
        self.groups = written(known.withColumn("zero", share(F.lit(0), F.col("size"), F.col("terms"))), "groups")

    def levels(self) -> DataFrame:
        """(lang, word, source, p, zero, bits): the terms of a word with one count in a group."""
        word, bit = F.expr(f"id DIV {WORD_BITS}"), F.expr(f"int(id % {WORD_BITS})")
        bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")
        levels = self.kept.groupBy("lang", word.alias("word"), "source", "n").agg(bits)
        sized = levels.join(self.groups, ["lang", "source"])
        return sized.select("lang", "word", "source", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), "zero", "bits")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for any two sources of a language, both ways."""
        levels = written(self.levels(), "levels")
        left = levels.select("lang", "word", *(F.col(c).alias(f"a_{c}") for c in ("source", "p", "zero", "bits")))
        right = levels.select("lang", "word", *(F.col(c).alias(f"b_{c}") for c in ("source", "p", "zero", "bits")))
        p, q, p0, q0 = (F.col(c) for c in ("a_p", "b_p", "a_zero", "b_zero"))
        cell = F.bit_count(F.col("a_bits").bitwiseAND(F.col("b_bits")))
        met = left.join(right, ["lang", "word"]).filter((F.col("a_source") < F.col("b_source")) & (cell > 0))
        both = met.groupBy("lang", "a_source", "b_source").agg(
            F.sum(cell * (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))).alias("both")
        )
        sizes = levels.groupBy("lang", "source", "p", "zero").agg(F.sum(F.bit_count("bits")).alias("n"))
        others = self.groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("q0"), "terms")
        own, zero = F.col("p"), F.col("zero")
        one = sizes.join(others, "lang").filter(F.col("source") != F.col("item"))
        one = one.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (apart(own, F.col("q0")) - apart(zero, F.col("q0")))).alias("one"))
        one = written(one, "one")
        pair = self.groups.select("lang", "source", "zero").join(others, "lang").filter(F.col("source") < F.col("item"))
        back = one.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("one").alias("back"))
        both = both.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), "both")
        keys = ["lang", "source", "item"]
        whole = pair.join(one, keys, "left").join(back, keys, "left").join(both, keys, "left").na.fill(0, ["one", "back", "both"])
        value = (F.col("terms") * apart(zero, F.col("q0")) + F.col("one") + F.col("back") + F.col("both")).alias("value")
        ends = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
        return whole.select("lang", F.explode(ends).alias("e"), value).select("lang", "e.*", "value")

    def telling_terms(self) -> DataFrame:
        """(lang, source, item, value) for the terms more usual in a group than in its language."""
        known = self.kept.join(self.groups, ["lang", "source"])
        p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("total"), F.col("lang_size"), F.col("terms"))
        shares = known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        return shares.filter("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out.filter(F.col("rank") <= top) if top else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")


def divergence_of_documents(spark: SparkSession, directory: str) -> DataFrame:
    """lang, source, part, item, value and rank for all pairs of sources and the most telling terms."""
    audit = Audit(table(spark, directory, "documents"))
    return ranked(audit.pairs(), "pair").unionByName(ranked(audit.telling_terms(), "term", TOP))


def _share_sql(n: str, size: str, terms: str) -> str:
    return f"(1 + ({SCALE}::HUGEINT * ({n} + {PRIOR})) // ({size} + {PRIOR} * {terms}))"


ORACLE = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS uid,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, source, uid, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT uid) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS terms, sum(total) AS lang_size FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(terms, 0) AS terms, coalesce(lang_size, 0) AS lang_size, coalesce(size, 0) AS size
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_share_sql("coalesce(c.n, 0)", "size", "terms")} AS p,
  {_share_sql("total", "lang_size", "terms")} AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT lang, source, 'pair' AS part, item, coalesce(f.value, 0) AS value FROM
  (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source)
  LEFT JOIN f USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= {TOP}
"""
