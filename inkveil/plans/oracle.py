"""DuckDB spellings of the rules, for checking results only.

DuckDB's patterns know no lookaround, no back-reference and no Unicode word
edge.  Where a rule needs one it is left out here and tested elsewhere.
"""

from __future__ import annotations

from inkveil.rules import DEFAULT_RULES, REST_OF_LINE

PATTERN_TAGS = list({r.tag: 0 for r in DEFAULT_RULES.patterns})
# Rule 28 has lookarounds.
SQL_RULES = [r for r in DEFAULT_RULES.patterns if "(?<!" not in r.pattern]
LETTER = r"[^\p{L}\p{N}_]"
BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pattern(rule) -> str:
    return text(("(?i)" if rule.ignore_case else "") + rule.pattern)


# Rule 28 spelled out: six digits between characters that are no part of a word and no hyphen.
_CODE = r"(^|[^\p{L}\p{N}_-])(\d{6})($|[^\p{L}\p{N}_-])"


def replaced(expression: str, rule) -> str:
    if rule.tag == "<code>":
        for _ in range(2):  # neighbours share what is between them
            expression = f"regexp_replace({expression}, {text(_CODE)}, '\\1<code>\\3', 'g')"
        return expression

    if rule.tag == "<password>":
        # A value holding a tag stays.
        p = f"(?i){rule.pattern.replace('[^\\s]+', '[^\\s<]+')}(\\s|\\z)"
        return f"regexp_replace({expression}, {text(p)}, {text(rule.tag + chr(92) + '1')}, 'g')"
    return f"regexp_replace({expression}, {pattern(rule)}, {text(rule.tag)}, 'g')"


def pattern_phase(expression: str) -> str:
    for rule in DEFAULT_RULES.patterns:
        expression = replaced(expression, rule)
    return expression


def context_phase(expression: str) -> str:
    for rule in DEFAULT_RULES.contexts:
        expression = _context(rule)[2](expression)
    return expression


def _context(rule) -> tuple:
    """Pattern, the group of what is replaced, and the replacement."""
    if rule.target == REST_OF_LINE:
        p = rf"(?i)({rule.trigger}\s*:?\s*)([^\n<]*[^\s<])([^\S\n]*)(\n|\z)"
        new = rf"\1{rule.tag}\3\4"
    else:
        p = rf"(?i)({rule.trigger}[^\d,]*)([\d,]+(?:\.\d{{2}})?)"
        new = rf"\1{rule.tag}"
    return p, 2, lambda expression: f"regexp_replace({expression}, {text(p)}, {text(new)}, 'g')"


def keyword_phase(expression: str, rules=DEFAULT_RULES) -> str:
    """Word edges spelled out; twice, as neighbours share the edge between them."""
    for category, word, redacts in rules.keyword_rows():
        if redacts:
            p = rf"(?i)(^|{LETTER})({word.replace('.', '[.]')})($|{LETTER})"
            for _ in range(2):
                expression = (
                    f"regexp_replace({expression}, {text(p)}, {text(rf'\1<{category[:-1]}>\3')}, 'g')"
                )
    return expression


def merge_phase(expression: str, tags: list[str]) -> str:
    for tag in tags:
        expression = f"regexp_replace({expression}, {text(rf'{tag}\s+{tag}')}, {text(tag)}, 'g')"
    for tag in tags:
        expression = f"regexp_replace({expression}, {text(f'(?:{tag}){{2,}}')}, {text(tag)}, 'g')"
    return expression


def guarded(column: str, redacted: str) -> str:
    """Short texts stay."""
    return f"CASE WHEN length({strip(column)}) < 3 THEN {column} ELSE {redacted} END"


def strip(expression: str) -> str:
    return f"regexp_replace({expression}, {text(rf'\A{BLANK}+|{BLANK}+\z')}, '', 'g')"


def cascade(column: str, context: bool = False, keyword: bool = False) -> str:
    """Patterns and merging, with trigger phrases and keywords on demand."""
    out = context_phase(column) if context else column
    out = pattern_phase(out)
    out = keyword_phase(out) if keyword else out
    tags = DEFAULT_RULES.tags() if context or keyword else PATTERN_TAGS
    return guarded(column, merge_phase(out, tags))


def mask(column: str) -> str:
    """Masked spelling of a one-line text."""
    user, host = f"split_part({column}, '@', 1)", f"split_part({column}, '@', 2)"
    return (
        f"CASE WHEN regexp_matches({column}, '^[^@]+@[^@]+\\.[^@]+')"
        f" THEN left({user}, 1) || '...' || CASE WHEN length({user}) > 2 THEN right({user}, 1)"
        f" ELSE '' END || '@' || left({host}, 1) || '...' || split_part({host}, '.', -1)"
        f" WHEN length({column}) <= 2 THEN repeat('*', length({column}))"
        f" WHEN length({column}) <= 5 THEN left({column}, 1) ||"
        f" repeat('*', length({column}) - 2) || right({column}, 1)"
        f" ELSE left({column}, 2) || '...' || right({column}, 2) END"
    )


def flat(column: str) -> str:
    line = r"(?:\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}])"
    no_tail = f"regexp_replace({column}, {text(line + '$')}, '')"
    return f"regexp_replace({no_tail}, {text(line)}, ' ', 'g')"


def log(source: str, key: str, column: str, *more: str) -> str:
    """Common table expressions ending in ``log``: one row per replacement.

    Columns: the key, ``more``, ord, place (from 1, within rule), original, tag.
    """
    kept = ", ".join([key, *more])
    parts = [f"t0 AS MATERIALIZED (SELECT {kept}, {column} AS t FROM {source})"]
    for n, rule in enumerate(SQL_RULES, start=1):
        new = replaced("t", rule)
        if n == 1:
            new = f"CASE WHEN length({strip('t')}) < 3 THEN t ELSE {new} END"
        parts.append(f"t{n} AS MATERIALIZED (SELECT {kept}, {new} AS t FROM t{n - 1})")
    hits = " UNION ALL ".join(
        f"SELECT {kept}, {rule.ord} AS ord, {text(rule.tag)} AS tag,"
        f" regexp_extract_all(t, {pattern(rule)}) AS hits FROM t{n}"
        for n, rule in enumerate(SQL_RULES)
    )
    parts.append(f"hits AS ({hits})")
    parts.append(
        f"log AS (SELECT {kept}, ord, tag, unnest(hits) AS original,"
        " unnest(range(1, len(hits) + 1)) AS place FROM hits)"
    )
    return "WITH " + ", ".join(parts)


def full_log(source: str, key: str, column: str) -> str:
    """Common table expressions ending in ``log``: a row per replacement of all phases.

    Columns: the key, original, tag, reason.  For texts of three characters and more.
    """
    steps = []  # pattern of the hits, their group, tag, reason, next text
    for rule in DEFAULT_RULES.contexts:
        p, group, new = _context(rule)
        steps.append((p, group, rule.tag, f"Contextual: '{rule.trigger}'", new("t")))
    for rule in DEFAULT_RULES.patterns:
        p, group = ("(?i)" if rule.ignore_case else "") + rule.pattern, 0
        if rule.tag == "<password>":
            p, group = f"(?i)({rule.pattern.replace('[^\\s]+', '[^\\s<]+')})(\\s|\\z)", 1
        elif rule.tag == "<code>":
            p, group = _CODE, 2
        steps.append((p, group, rule.tag, "Regex", replaced("t", rule)))
    for category, word, redacts in DEFAULT_RULES.keyword_rows():
        if redacts:
            p = rf"(?i)(^|{LETTER})({word.replace('.', '[.]')})($|{LETTER})"
            tag = f"<{category[:-1]}>"
            new = f"regexp_replace(t, {text(p)}, {text(rf'\1{tag}\3')}, 'g')"
            steps.append((p, 2, tag, f"Keyword: {category}", new))
    parts = [f"t0 AS MATERIALIZED (SELECT {key}, {column} AS t FROM {source})"]
    hits = []
    for n, (p, group, tag, why, new) in enumerate(steps):
        parts.append(f"t{n + 1} AS MATERIALIZED (SELECT {key}, {new} AS t FROM t{n})")
        found = f"unnest(regexp_extract_all(t, {text(p)}, {group}))"
        hits.append(f"SELECT {key}, {found} AS original, {text(tag)} AS tag, {text(why)} AS reason FROM t{n}")
    parts.append(f"log AS ({' UNION ALL '.join(hits)})")
    return "WITH " + ", ".join(parts)


def words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, {text(BLANK + '+')}), lambda w: w <> '')"


def tokens() -> str:
    """Common table expression ``tokens`` with the different words of all documents."""
    return (
        "WITH tokens AS MATERIALIZED (SELECT DISTINCT token FROM"
        f" (SELECT unnest({words('text')}) AS token FROM documents))"
    )


def bits(column: str) -> str:
    """Entropy of a word over its characters."""
    share = f"((length({column}) - length(replace({column}, c, ''))) / length({column}))"
    return (
        f"list_sum(list_transform(list_distinct(string_split({column}, '')),"
        f" lambda c: -{share} * log2({share})))"
    )


def looks_random(column: str) -> str:
    return (
        f"(length({column}) >= 8 AND {bits(column)} > 3.5 AND ("
        f"regexp_matches({column}, '[\\p{{Nd}}\\-_+/=]') OR (regexp_matches({column}, '\\p{{Lu}}')"
        f" AND regexp_matches({column}, '\\p{{Ll}}'))))"
    )


def whitelisted(column: str) -> str:
    listed = ", ".join(text(w) for w in DEFAULT_RULES.whitelist)
    return f"(lower({column}) IN ({listed}) OR regexp_matches({column}, '^\\p{{Nd}}{{1,3}}$'))"


def reason(column: str) -> str:
    """Reason of a word without context; null if it is not sensitive."""
    hits = [f"WHEN {looks_random(column)} THEN 'high_entropy_string'"]
    for rule in SQL_RULES:
        hits.append(
            f"WHEN regexp_matches({column}, {pattern(rule)}) THEN 'regex_pattern_{rule.tag}'"
        )
    for category, word, _ in DEFAULT_RULES.keyword_rows():
        hits.append(
            f"WHEN contains(lower({column}), {text(word.lower())})"
            f" THEN {text(f'keyword_{category}_{word}')}"
        )
    return f"CASE {' '.join(hits)} END"
