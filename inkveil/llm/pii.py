"""Personal data in texts: fixed patterns, and contexts learned from what they find.

Everything is built-in expressions.  One scan takes from each text the matches
of the patterns and the words that could be identifiers (those with a digit or
an @), each with the length of the text between it and the one before; running
sums over these lengths are the positions.  Texts themselves are not shuffled.

What the patterns find are seeds.  The word before an identifier is a lexical
pattern.  A pattern's confidence is the share of its occurrences that the
scores of the identifiers behind it account for; an identifier's score is 1 for
a seed, else the chance that one of its patterns is right.  Both are worked out
by turns over the graph of patterns and identifiers; in each round every
pattern takes part that stands before an identifier believed so far.  Patterns
that are sure enough and stand before enough different identifiers that are
seeds, or believed for other patterns' sake, discover the identifiers behind
them that no pattern of the base knows.

A pattern's occurrences are counted over the words of all documents.

The patterns are written without loops that Java runs by recursion and without
starts in the middle of a run, so that time follows a text's length.  They
match what their plain forms (see PLAIN) match.

Defined cases: a null text counts as empty; an empty text has no spans;
positions are code points, ends exclusive; repeated documents are scanned row
by row; an empty table gives no rows.  Discovered spans that touch a span of
the base are left to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import table, written

KINDS = ("email", "ip", "card", "phone", "context")

# The base kinds as they are specified.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PLAIN["phone"],
}
#: What a text needs for a match to be possible.
_NEEDS = {"email": "@", "phone": "+"}
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_EDGES = r"^[\"'(\[<{]++|[\"')\]>},;:.!?]++$"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z"

#: Rounds over the graph; the confidence and the different known identifiers of a pattern that may discover;
#: the fewest digits and characters of what it discovers; characters before a word that are looked at first.
ROUNDS, SURE, SEEDS, DIGITS, LENGTH, NEAR = 3, 0.5, 5, 2, 4, 64


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """The matches with the length of the text before each; the last entry, without a match, is the rest."""
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda m, gap: F.struct(m.alias("match"), F.length(gap).alias("gap")),
    )
    return F.when(possible & text.rlike(pattern), pairs)


def _tokens(text: Column) -> Column:
    """Words that may be identifiers, with the word before."""
    def before(gap: Column) -> Column:
        # The end of the gap settles it where it holds all of the word; a longer word, or one before many blanks, is looked for in all of it.
        near = F.nullif(F.regexp_extract(F.substr(gap, F.lit(-NEAR)), r"\s(\S++)\s++\z", 1), F.lit(""))
        return F.lower(F.coalesce(near, F.regexp_extract(gap, r"(?<!\S)(\S++)\s++\z", 1)))

    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), F.split(text, _TOKEN, -1),
        lambda m, gap: F.struct(m.alias("match"), F.length(gap).alias("gap"), before(gap).alias("before")),
    )
    return F.when(text.rlike("[0-9@]"), pairs)


def gathered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One written row per document: uid, id, and what the scan finds."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = {k: _matches(F.col("t"), p, F.col("t").contains(_NEEDS[k]) if k in _NEEDS else F.lit(True)) for k, p in _LINEAR.items()}
    rows = rows.select("doc_id", *(c.alias(k) for k, c in found.items()), _tokens(F.col("t")).alias("token"))
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "found")


def _placed(rows: DataFrame, column: str) -> DataFrame:
    """uid, start and the fields of each entry that is a match."""
    entries = rows.select("uid", F.posexplode(column).alias("at", "e")).select("uid", "at", "e.*")
    running = Window.partitionBy("uid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length("match"), F.lit(0))
    start = F.sum(F.col("gap") + size).over(running) - size
    return entries.withColumn("start", start).filter(F.col("match").isNotNull()).drop("gap", "at")


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(_IP)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), F.expr("luhn_check(regexp_replace(match, '[^0-9]', ''))")).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(rows: DataFrame) -> DataFrame:
    """uid, start, kind (its number), end: the valid matches of the patterns."""
    out = None
    for number, kind in enumerate(KINDS[:4]):
        spans = _placed(rows, kind).filter(_valid(kind, F.col("match")))
        spans = spans.select("uid", "start", F.lit(number).alias("kind"), (F.col("start") + F.length("match")).alias("end"))
        out = spans if out is None else out.unionAll(spans)
    return out


def candidates(rows: DataFrame, base: DataFrame) -> DataFrame:
    """uid, start, end, identifier, pattern, seed of the words that may be identifiers, without their edges."""
    words = _placed(rows, "token")
    core = F.regexp_replace("match", _EDGES, "")
    lead = F.length("match") - F.length(F.regexp_replace("match", r"^[\"'(\[<{]++", ""))
    words = words.select("uid", (F.col("start") + lead).alias("start"), core.alias("identifier"), F.col("before").alias("pattern"))
    words = words.filter(F.length("identifier") > 0).withColumn("end", F.col("start") + F.length("identifier"))
    # Both kinds of spans by position: a word touches a base span that began before its end and is not over at its start.
    nothing = F.lit(None).cast("string")
    both = words.select("uid", "start", "end", "identifier", "pattern").unionAll(base.select("uid", "start", "end", nothing, nothing))
    in_order = Window.partitionBy("uid").orderBy("start")
    is_base = F.col("identifier").isNull()
    over = F.max(F.when(is_base, F.col("end"))).over(in_order.rangeBetween(Window.unboundedPreceding, 0))
    # From behind, as a frame that reaches to the end is worked out anew for every row.
    from_behind = Window.partitionBy("uid").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    begun = F.min(F.when(is_base, F.col("start"))).over(from_behind)
    seed = F.coalesce(over > F.col("start"), F.lit(False)) | F.coalesce(begun < F.col("end"), F.lit(False))
    return both.withColumn("seed", seed).filter(~is_base)


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """pattern and total: how often each word is in all documents."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"\s++")).alias("pattern"))
    return words.filter("pattern <> ''").groupBy("pattern").agg(F.count("*").alias("total"))


def confidences(found: DataFrame, totals: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """pattern, confidence and known (how many different identifiers behind it are seeds or sure without it)."""
    edges = written(found.filter("pattern <> ''").groupBy("pattern", "identifier").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    # No semi-join: the optimizer would push it below the counting, and shuffle every word.
    totals = written(totals.join(edges.select("pattern").distinct(), "pattern"), "patterns")
    # Identifiers that are not believed at all are not listed.  ``doubts``: the logarithm of the chance that no pattern is right.
    scores = edges.filter("seed").select("identifier").distinct().select("identifier", F.lit(True).alias("seen"), F.lit(0.0).alias("doubts"))
    score = F.when(F.col("seen"), 1.0).otherwise(1 - F.exp("doubts"))
    for _ in range(rounds):
        believed = edges.select("pattern", "identifier", "n").join(scores, "identifier").groupBy("pattern").agg(F.sum(F.col("n") * score).alias("believed"))
        patterns = totals.join(believed, "pattern").select("pattern", F.least(F.lit(1.0), F.col("believed") / F.col("total")).alias("confidence"))
        patterns = written(patterns.withColumn("doubt", F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))), "confidences")
        scores = edges.join(patterns, "pattern").groupBy("identifier").agg(F.max("seed").alias("seen"), F.sum("doubt").alias("doubts"))
        scores = written(scores, "scores")
    # A pattern's own belief in an identifier does not count for it.
    others = F.col("seen") | (1 - F.exp(F.col("doubts") - F.col("doubt")) >= sure)
    met = edges.select("pattern", "identifier").join(patterns, "pattern").join(scores, "identifier")
    known = met.groupBy("pattern").agg(F.first("confidence").alias("confidence"), F.sum(others.cast("int")).alias("known"))
    return known.select("pattern", "confidence", "known")


def discovered(found: DataFrame, patterns: DataFrame, sure: float = SURE, seeds: int = SEEDS) -> DataFrame:
    """uid, start, kind, end of the unseen identifiers behind patterns that are sure."""
    chosen = patterns.filter((F.col("confidence") >= sure) & (F.col("known") >= seeds)).select("pattern")
    likely = (F.length(F.regexp_replace("identifier", "[^0-9]", "")) >= DIGITS) | F.col("identifier").contains("@")
    new = found.filter(~F.col("seed") & likely & (F.length("identifier") >= LENGTH))
    return new.join(chosen, "pattern", "left_semi").select("uid", "start", F.lit(4).alias("kind"), "end")


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans, an array of (start, kind number, end) in order, for every document."""
    rows = gathered(docs, key, text)
    base = written(base_spans(rows), "base")
    found = written(candidates(rows, base), "candidates")
    every = base.unionAll(discovered(found, confidences(found, occurrences(docs, text))))
    spans = every.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end")))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.select("uid", "doc_id").join(spans, "uid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def private_data_of_documents(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans of every document."""
    rows = scanned(table(spark, directory, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(kind) for kind in range(4)]
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
