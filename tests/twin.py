"""The rules in plain Python, to compare whole texts with.

Works match by match with a callback, so it shares nothing with the engine but
the rule tables.
"""

from __future__ import annotations

import math
import re

from inkveil.rules import DEFAULT_RULES, REST_OF_LINE
from inkveil.rules.words import keyword_tag

BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def entropy(word: str) -> float:
    return -sum(
        n / len(word) * math.log2(n / len(word)) for n in (word.count(c) for c in set(word))
    )


def random_looking(word: str) -> bool:
    return (
        len(word) >= 8
        and entropy(word) > 3.5
        and (
            any(c.isdigit() or c in "-_+/=" for c in word)
            or (any(map(str.isupper, word)) and any(map(str.islower, word)))
        )
    )


def whitelisted(text: str, rules=DEFAULT_RULES) -> bool:
    return text.strip().lower() in rules.whitelist or (text.isdigit() and len(text) <= 3)


def why_sensitive(text: str, rules=DEFAULT_RULES) -> str:
    """Reason without a context; empty if there is none."""
    if not text or whitelisted(text, rules):
        return ""
    if random_looking(text):
        return "high_entropy_string"
    for rule in rules.patterns:
        if compiled(rule).search(text):
            return "regex_pattern_" + rule.tag
    for category, word, _ in rules.keyword_rows():
        if word.lower() in text.lower():
            return f"keyword_{category}_{word}"
    return ""


def compiled(rule):
    return re.compile(rule.pattern, re.IGNORECASE if rule.ignore_case else 0)


def pattern_phase(text: str, rules=DEFAULT_RULES, log=None) -> str:
    for rule in rules.patterns:
        found = []

        def put(match, rule=rule, found=found):
            hit = match.group()
            spared = "<" in hit or whitelisted(hit, rules)
            if rule.tag in ("<hostname>", "<email>", "<url>"):
                spared = spared or not why_sensitive(hit, rules)
            if spared:
                return hit
            found.append((2, rule.ord, rule.tag, hit, "Regex"))
            return rule.tag

        text = compiled(rule).sub(put, text)
        if log is not None:
            log += found
    return text


def context_phase(text: str, rules=DEFAULT_RULES, log=None) -> str:
    """Each trigger takes what follows it; a trigger inside what was taken is gone."""
    for rule in rules.contexts:
        trigger = re.compile(re.escape(rule.trigger) + r"\s*:?\s*", re.IGNORECASE)
        done, rest = "", text
        while match := trigger.search(rest):
            after = rest[match.end():]
            if rule.target == REST_OF_LINE:
                value = after.split("\n")[0].strip()
                start = after.find(value)
                if not value or "<" in value:
                    done, rest = done + rest[: match.end()], after
                    continue
            else:
                number = re.search(r"[\d,]+(?:\.\d{2})?", after)
                if not number:
                    break
                value, start = number.group(), number.start()
            if log is not None:
                log.append((1, rule.ord, rule.tag, value, f"Contextual: '{rule.trigger}'"))
            done += rest[: match.end()] + after[:start] + rule.tag
            rest = after[start + len(value):]
        text = done + rest
    return text


def keyword_phase(text: str, rules=DEFAULT_RULES, log=None) -> str:
    for n, (category, word, redacts) in enumerate(rules.keyword_rows(), start=1):
        if redacts:
            edge = re.compile(rf"\b{re.escape(word)}\b", re.IGNORECASE)
            if log is not None:
                log += [(4, n, keyword_tag(category), hit, f"Keyword: {category}")
                        for hit in edge.findall(text)]
            text = edge.sub(keyword_tag(category), text)
    return text


def merge(text: str) -> str:
    text = re.sub(r"(<\w+>)\s+\1", r"\1", text)
    return re.sub(r"(<\w+>)(\1)+", r"\1", text)


def redact(text, rules=DEFAULT_RULES, phases=("context", "pattern", "keyword", "merge"), log=None):
    if text is None or len(text.strip()) < 3:
        return text
    for phase in phases:
        if phase == "merge":
            text = merge(text)
        else:
            text = globals()[phase + "_phase"](text, rules, log)
    return text


def masked(text: str) -> str:
    text = " ".join(text.splitlines())
    if re.match(r"[^@]+@[^@]+\.[^@]+", text):
        user, host = text.split("@")[:2]
        return (
            user[0] + "..." + (user[-1] if len(user) > 2 else "")
            + "@" + host[0] + "..." + host.split(".")[-1]
        )
    if len(text) <= 2:
        return "*" * len(text)
    if len(text) <= 5:
        return text[0] + "*" * (len(text) - 2) + text[-1]
    return text[:2] + "..." + text[-2:]
