"""Licences in texts, by the Dice coefficient over word bigrams.

Everything is built-in expressions.  A text is taken apart into lines,
paragraphs of several lines, sentences (which may begin and end inside a line,
or go over several) and, where there are several paragraphs, the text as a
whole.  Such a unit and a template are normalised alike (letters A-Z
lower-cased, everything but letters a-z and digits a blank) and compared as
sets of word bigrams: twice the shared ones over the sum of both sizes.

A coefficient of t needs sizes within a factor of (2 - t) / t, so a unit only
meets templates of such sizes, and units that fit no template are dropped
before their bigrams are listed.  It also leaves at most a share of
(2 - 2t) / (2 - t) of a template's bigrams unmatched.  So some words are chosen
such that more of every template's bigrams than that hold one of them; what
holds none of these words is like no template, and goes before anything else is
done with it.  Bigrams meet those of the templates in a hash join with the
fixed, small table of template bigrams; only matches are counted and shuffled.

Defined cases: a null text counts as empty; units with fewer than two words
match nothing; a sentence that is a whole line is a line only; the best template
of a unit counts, ties go to the first by name and part; repeated documents give
their matches each; documents without a match give no rows.  Columns besides the
named ones are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import table
from inkveil.llm.license_texts import FULL, NAMED, SENTENCES

LEAST = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER, _GAP = "[^a-z0-9]+", r"\n[ \t\r]*\n"
_STOP = r"([.!?])[ \t\r\n]+"


def templates() -> list[tuple[str, int, str]]:
    """Licence, part and text: whole licences, their paragraphs, and notices."""
    out = []
    for name, text in FULL.items():
        parts = [text, *(text.split("\n\n") if "\n\n" in text else ())]
        out += [(name, i, part) for i, part in enumerate(parts)]
    for name, titles in NAMED.items():
        notices = [s.format(t) for t in titles for s in SENTENCES]
        out += [(name, 100 + i, notice) for i, notice in enumerate(notices)]
    return out


def words(text: Column) -> Column:
    """The words of a text, normalised."""
    plain = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _OTHER, " "))
    return F.split(plain, " ", -1)


def pairs(column: str) -> Column:
    """The distinct bigrams of an array of words."""
    last = F.size(column) - 1
    first, second = F.slice(column, F.lit(1), last), F.slice(column, F.lit(2), last)
    return F.array_distinct(F.zip_with(first, second, lambda a, b: F.concat_ws(" ", a, b)))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once, however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_bigrams(df: DataFrame) -> DataFrame:
    """The rows whose ``text`` has two words or more, with their bigrams ``b``."""
    several = once(df, "w", words(F.col("text"))).drop("text").filter(F.size("w") > 1)
    return once(several, "b", pairs("w")).drop("w")


def telling_words(texts: list[str], least: float) -> list[str]:
    """Words of which every unit with a coefficient of ``least`` or more holds one.

    Chosen greedily; long words first, as those are rarer.
    """
    kinds = []
    for text in texts:
        w = re.sub(_OTHER, " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()
        kinds.append(set(zip(w, w[1:], strict=False)))
    open_ = [(b, (2 - 2 * least) / (2 - least) * len(b) + 1e-9) for b in kinds if b]
    out: list[str] = []
    while open_:
        gain: Counter = Counter()
        for bigrams, spare in open_:
            held = Counter(w for pair in bigrams for w in set(pair))
            for w, n in held.items():
                gain[w] += min(n, spare + 1) * (1 if len(w) > 5 else 0.15)
        out.append(min(gain, key=lambda w: (-gain[w], w)))
        left = [({p for p in b if out[-1] not in p}, spare, len(b)) for b, spare in open_]
        open_ = [(b, spare - (n - len(b))) for b, spare, n in left if spare >= n - len(b)]
    return [w for w in out if not any(o != w and o in w for o in out)]


def _holds(text: Column, some: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in some), F.lit(False))


def units(docs: DataFrame, some: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, uid, unit, number and text of lines, paragraphs, sentences and whole texts that hold one of these words."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("uid", F.monotonically_increasing_id())
    rows = once(rows, "low", F.lower("t")).filter(_holds(F.col("low"), some)).drop("low")
    rows = once(rows, "lines", F.split("t", "\n", -1))

    def listed(unit: str, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(unit).alias("unit"), i.alias("number"), x.alias("text")))

    paragraphs = F.filter(listed("paragraph", F.split("t", _GAP, -1)), lambda x: F.contains(x["text"], F.lit("\n")))
    cut = F.split(F.regexp_replace("t", _STOP, "$1\x01"), f"\x01|{_GAP}", -1)
    sentences = F.filter(listed("sentence", cut), lambda x: ~F.array_contains("lines", x["text"]))
    whole = F.when(F.col("t").rlike(_GAP), listed("text", F.array("t")))
    none = F.array().cast("array<struct<unit:string,number:int,text:string>>")
    every = F.concat(listed("line", F.col("lines")), paragraphs, sentences, F.coalesce(whole, none))
    each = rows.select("doc_id", "uid", F.inline(every))
    return once(each, "low", F.lower("text")).filter(_holds(F.col("low"), some)).drop("low")


def known(spark: SparkSession, texts: list[tuple[str, int, str]]) -> DataFrame:
    """licence, part, m (number of bigrams) and bigram of the templates."""
    rows = with_bigrams(spark.createDataFrame(texts, "licence string, part int, text string"))
    return rows.select("licence", "part", F.size("b").alias("m"), F.explode("b").alias("bigram"))


def _fits(sizes: list[int], factor: float) -> Column:
    """Whether a unit of n bigrams can be like a template of one of these sizes."""
    fits = F.lit(False)
    for m in sizes:
        fits = fits | ((F.col("n") * factor >= m) & (F.col("n") <= m * factor))
    return fits


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, texts: list[tuple[str, int, str]] | None = None) -> DataFrame:
    """doc_id, unit, number, licence, part and score of every unit that is a licence text."""
    spark = docs.sparkSession
    texts = templates() if texts is None else texts
    wanted = known(spark, texts)
    factor = (2 - least) / least
    sizes = sorted({r["m"] for r in wanted.select("m").distinct().collect()})  # as many as templates
    rows = with_bigrams(units(docs, telling_words([t for *_, t in texts], least), key, text)).withColumn("n", F.size("b")).filter(_fits(sizes, factor))
    rows = rows.select("doc_id", "uid", "unit", "number", "n", F.explode("b").alias("bigram"))
    # The templates are a fixed list, so their table is small whatever the documents are.
    met = rows.join(F.broadcast(wanted), "bigram").filter((F.col("n") * factor >= F.col("m")) & (F.col("n") <= F.col("m") * factor))
    shared = met.groupBy("doc_id", "uid", "unit", "number", "licence", "part", "n", "m").agg(F.count("*").alias("c"))
    score = 2 * F.col("c") / (F.col("n") + F.col("m"))
    scored = shared.withColumn("score", score).filter(F.col("score") >= least)
    best = scored.groupBy("doc_id", "uid", "unit", "number").agg(F.min(F.struct((-F.col("score")).alias("low"), "licence", "part")).alias("x"))
    return best.select("doc_id", "unit", "number", "x.licence", "x.part", (-F.col("x.low")).alias("score"))


def licenses_of_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Every licence text in the documents."""
    return found(table(spark, directory, "documents"))


def _oracle() -> str:
    quoted = ", ".join("('{}', {}, '{}')".format(n, p, t.replace("'", "''")) for n, p, t in templates())
    normal = f"trim(regexp_replace(translate({{}}, '{_UPPER}', '{_LOWER}'), '{_OTHER}', ' ', 'g'))"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    factor = (2 - LEAST) / LEAST
    return f"""
WITH k AS (SELECT * FROM (VALUES {quoted}) v(licence, part, t)),
kw AS (SELECT licence, part, string_split({normal.format("t")}, ' ') AS w FROM k),
kb AS (SELECT licence, part, {pairs} AS b FROM kw),
km AS (SELECT licence, part, len(b) AS m, unnest(b) AS bigram FROM kb),
d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT uid, doc_id, regexp_split_to_array(t, '{_GAP}') AS p, string_split(t, chr(10)) AS l, t FROM d),
u AS (
  SELECT uid, doc_id, 'line' AS unit, unnest(range(len(l))) AS number, unnest(l) AS t FROM p
  UNION ALL
  SELECT * FROM (SELECT uid, doc_id, 'paragraph', unnest(range(len(p))), unnest(p) AS t FROM p) WHERE contains(t, chr(10))
  UNION ALL
  SELECT uid, doc_id, unit, number, t FROM (SELECT uid, doc_id, 'sentence' AS unit, l, unnest(range(len(s))) AS number, unnest(s) AS t
    FROM (SELECT *, regexp_split_to_array(regexp_replace(t, '{_STOP}', '\\1' || chr(1), 'g'), chr(1) || '|{_GAP}') AS s FROM p)) WHERE NOT list_contains(l, t)
  UNION ALL
  SELECT uid, doc_id, 'text', 0, t FROM p WHERE len(p) > 1
),
uw AS (SELECT uid, doc_id, unit, number, string_split({normal.format("t")}, ' ') AS w FROM u),
ub AS (SELECT uid, doc_id, unit, number, {pairs} AS b FROM uw WHERE len(w) > 1),
um AS (SELECT uid, doc_id, unit, number, len(b) AS n, unnest(b) AS bigram FROM ub WHERE len(b) > 0),
s AS (
  SELECT uid, doc_id, unit, number, licence, part, 2.0::DOUBLE * count(*) / (n + m) AS score
  FROM um JOIN km USING (bigram) WHERE n * {factor!r}::DOUBLE >= m AND n <= m * {factor!r}::DOUBLE
  GROUP BY uid, doc_id, unit, number, licence, part, n, m
),
r AS (SELECT *, row_number() OVER (PARTITION BY uid, unit, number ORDER BY score DESC, licence, part) AS place FROM s WHERE score >= {LEAST})
SELECT doc_id, unit, CAST(number AS INTEGER) AS number, licence, CAST(part AS INTEGER) AS part, score FROM r WHERE place = 1
"""


ORACLE = _oracle()
