"""Patterns in Python spelling, turned into Java ones with the same meaning.

The two engines part on what is a digit, a blank, a word character and a word
edge.  Java's ``(?U)`` flag comes close but counts combining marks as word
characters, so the classes are spelled out by Unicode category instead.  That
also keeps the result the same on every Java version.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from inkveil.rules.patterns import PatternRule

# Members of the Unicode classes, to be put inside [...].
DIGIT = r"\p{Nd}"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"

# Decimal digits and the signs Python's isdigit adds to them (superscripts,
# circled digits and the like).
ANY_DIGIT = (
    DIGIT
    + r"\x{b2}-\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    + r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}"
    + r"\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}"
    + r"\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
    + r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)

_CLASSES = {"d": DIGIT, "s": SPACE, "w": WORD}

# A word edge: exactly one of the two neighbours is a word character.
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
# The same where the next character is known to be a word character.
EDGE_BEFORE_WORD = f"(?<![{WORD}])"


def to_java(pattern: str, ignore_case: bool = False, starts: str = "") -> str:
    """Translate a Python ``re`` pattern into a ``java.util.regex`` one.

    ``starts`` are the members of a class holding all first characters of a
    match.  It becomes a lookahead that rejects most positions at once.
    """
    head = ""
    if starts:
        head = f"(?=[{_translate(starts, in_class=True)}])"
        if pattern.startswith(r"\b") and _all_word(starts):
            head += EDGE_BEFORE_WORD
            pattern = pattern[2:]
    flags = "(?iu)" if ignore_case else ""
    return head + flags + _translate(pattern)


def starting_with(word: str) -> str:
    """Lookahead for the first letter of a word in any case; empty if there is none."""
    first = word[0].lower()
    if not (first.isascii() and first.isalnum()):
        return ""
    alike = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}.get(first, "")
    return f"(?=[{first}{first.upper()}{alike}])"


def any_word(words: Iterable[str]) -> str:
    """A pattern for any of the words, sorted into branches by first letter."""
    branches: dict[str, list[str]] = {}
    for word in words:
        branches.setdefault(word[0], []).append(quote(word[1:]))
    return "|".join(f"{quote(first)}(?:{'|'.join(rest)})" for first, rest in branches.items())


def rule_pattern(rule: PatternRule) -> str:
    return to_java(rule.linear or rule.pattern, rule.ignore_case, rule.starts)


def quote(text: str) -> str:
    """A pattern matching ``text`` itself, in either engine."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def quote_replacement(text: str) -> str:
    """``text`` as the replacement of ``regexp_replace``, taken literally."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _all_word(members: str) -> bool:
    """No non-word ASCII character is in the class."""
    one = re.compile(f"[{members}]")
    return not any(one.match(chr(c)) and not re.match(r"\w", chr(c)) for c in range(128))


def _translate(pattern: str, in_class: bool = False) -> str:
    out: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "\\":
            nxt = pattern[i]
            i += 1
            if nxt in _CLASSES:
                out.append(_CLASSES[nxt] if in_class else f"[{_CLASSES[nxt]}]")
            elif nxt.lower() in _CLASSES:
                out.append(f"[^{_CLASSES[nxt.lower()]}]")
            elif nxt == "b" and not in_class:
                out.append(EDGE)
            else:
                out.append(ch + nxt)
            continue
        if in_class:
            if ch == "]":
                in_class = False
            elif ch in "[&":  # plain characters in Python, class algebra in Java
                out.append("\\")
        elif ch == "[":
            in_class = True
        out.append(ch)
    return "".join(out)
