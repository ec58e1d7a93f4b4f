"""The ordered pattern rules: what counts as sensitive by its shape.

Order is meaning: every rule reads the text the rules before it left behind, so
an early rule (twelve digits) hides a later one (card numbers) on purpose.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class PatternRule:
    """One shape to redact.

    ``pattern`` is in Python ``re`` spelling with Unicode classes; the engine
    translates it (``functions.regex.to_java``).

    The other fields save time or settle corner cases:

    * ``starts``: members of a character class that holds every character a
      match can begin with, so other positions are passed over quickly;
    * ``needs``: names of tests (``functions.guards.TESTS``) a text has to pass
      before the rule can match at all; they never change a result;
    * ``crosses_tags``: a match may run over a tag already put in, and then has
      to be left alone;
    * ``recheck``: a match ending in a hyphen is judged again on its own;
    * ``linear``: the same rule in a form whose time and stack do not grow with
      the square or the depth of a match, where the plain form's do;
    * ``ends``: every match ends where this one does, so what follows its last
      match is not searched.
    """

    ord: int
    tag: str
    pattern: str
    ignore_case: bool = False
    starts: str = ""
    needs: tuple[str, ...] = ()
    crosses_tags: bool = True
    recheck: bool = False
    linear: str = ""
    ends: str = ""

    def letterless(self) -> bool:
        """Whether a text without letters, "@", ":" and "₹" can match (true if in doubt)."""
        possible = {"digit", "dot", "hyphen", "hyphen_or_colon"}
        starts = not self.starts or re.search(rf"[{self.starts}]", "0123456789.+-(") is not None
        return starts and set(self.needs) <= possible


# Tag, pattern and case flag of each rule, in rule order.
_FIXED_RULES: list[tuple[str, str, bool]] = [
    ("<aadhaar>", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", False),
    ("<pan>", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", False),
    ("<passport>", r"\b[A-Z][0-9]{7}\b", False),
    ("<driving_license>", r"\b[A-Z]{2}[0-9]{2}[\s-]?[0-9]{11}\b", False),
    ("<account_no>", r"\b\d{9,18}\b", False),
    ("<ifsc_code>", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", False),
    ("<card_number>", r"\b(?:\d[\s-]*?){13,19}\b", False),
    ("<cvv>", r"\b(?:CVV|CVC|CV2|CID)[\s:]*\d{3,4}\b", True),
    ("<api_key>", r"\b(?:api[_-]?key|token|bearer|auth[_-]?key)[\s:=]+[\w\-\.]+\b", True),
    ("<password>", r"(?:password|passwd|pwd|pass|secret|pin|passcode)[\s:=]+[^\s]+", True),
    ("<ssh_key>", r"(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-nistp256)\s+[A-Za-z0-9+/=]+", True),
    ("<private_key>", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----[\s\S]+?-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----", False),
    ("<email>", r"\b[a-zA-Z0-9][a-zA-Z0-9._%+-]{0,63}@(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b", False),
    ("<mobile>", r"(?:\+91[\s-]?|91[\s-]?|0)?[6-9]\d{9}\b", False),
    ("<landline>", r"(?:\+91[\s-]?|0)?(?:[1-9]\d{1,4})[\s-]?\d{6,8}\b", False),
    ("<phone>", r"(?:\+\d{1,3}[\s-]?)?\(?\d{1,4}\)?[\s-]?\d{1,4}[\s-]?\d{4,10}\b", False),
    ("<ipv4>", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", False),
    ("<ipv6>", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", False),
    ("<mac_address>", r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b", True),
    ("<hostname>", r"\b([a-z0-9]+-){1,4}[a-z0-9-]+\b", True),
    ("<url>", r'https?://[^\s<>"{}|\\^`\[\]]+(?:\?[^\s<>"{}|\\^`\[\]]+)?', False),
    ("<hostname>", r"\b[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}\b", False),
    ("<upi_id>", r"\b[a-zA-Z0-9._-]+@[a-zA-Z]{3,}\b", False),
    ("<amount>", r"(?:₹|Rs\.?|INR)[\s]?\d+(?:,\d{3})*(?:\.\d{2})?", True),
    ("<ssn>", r"\b\d{3}-\d{2}-\d{4}\b", False),
    ("<dob>", r"\b(?:DOB|Date of Birth)[\s:]+\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", True),
    ("<id>", r"\b(?:EMP|CUST|ID|REF)[\s-]?\d{4,10}\b", True),
    ("<code>", r"\b(?<![\d-])\d{6}(?![\d-])\b", False),
]

# First characters of a match, and the tests a text must pass, by rule number.
# K, s and i also stand for the Kelvin sign, the long s and the Turkish i forms
# when case is ignored.
_HINTS: dict[int, tuple[str, tuple[str, ...]]] = {
    1: (r"\d", ("digit",)),
    2: ("A-Z", ("digit",)),
    3: ("A-Z", ("digit",)),
    4: ("A-Z", ("digit",)),
    5: (r"\d", ("digit",)),
    6: ("A-Z", ("digit",)),
    7: (r"\d", ("digit",)),
    8: ("cC", ("digit", "cvv_word")),
    9: ("aAtTbB", ("key_word",)),
    10: ("pPsS\u017f", ("secret_word",)),
    11: ("sS\u017feE", ("hyphen", "ssh_word")),
    12: ("-", ("hyphen", "pem_word")),
    13: ("a-zA-Z0-9", ("at",)),
    14: (r"+\d", ("digit",)),
    15: (r"+\d", ("digit",)),
    16: (r"+(\d", ("digit",)),
    17: ("0-9", ("digit", "dot")),
    18: ("0-9a-fA-F", ("colon",)),
    19: ("0-9a-fA-F", ("hyphen_or_colon",)),
    20: ("a-zA-Z0-9\u017f\u212a\u0130\u0131", ("hyphen",)),
    21: ("h", ("scheme",)),
    22: ("a-zA-Z0-9", ("inner_dot",)),
    23: (r"a-zA-Z0-9._\-", ("at",)),
    24: ("₹rRiI\u0130\u0131", ("digit", "currency")),
    25: (r"\d", ("digit", "hyphen")),
    26: ("dD", ("digit", "birth_word")),
    27: ("eEcCiI\u0130\u0131rR", ("digit",)),
    28: (r"\d", ("digit",)),
}

# Only these two can match a "<".
_CROSSING = {10, 12}
# Only this one can match a run whose last character is no word character.
_RECHECKED = {20}

# Names of hosts: labels with dots, the last of which a top-level name (letters
# up to a word edge) can follow.  Java runs a loop over groups by recursion
# unless the loop is possessive; these take label after label without ever
# giving one back: those without a top-level name behind them, then one with.
_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
_TOP = r"[a-zA-Z]{2,}\b"
_LABELS = rf"(?:(?:{_LABEL}\.(?!{_TOP}))*+{_LABEL}\.(?={_TOP}))++{_TOP}"
_LINEAR = {
    13: rf"\b[a-zA-Z0-9][a-zA-Z0-9._%+-]{{0,63}}@{_LABELS}",
    # A start behind a short label and its dot would match from that label on.
    22: rf"\b(?<!(?<![\w-])[a-zA-Z0-9]{{1,63}}\.){_LABELS}",
    # Likewise behind a short word, unless that was taken by the match before.
    23: r"\b(?:\G|(?<!(?<!\w)[a-zA-Z0-9_]{1,64}[.-]?))[a-zA-Z0-9._-]++@[a-zA-Z]{3,}\b",
}
_ENDS = {12: r"-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----"}

PATTERN_RULES: tuple[PatternRule, ...] = tuple(
    PatternRule(
        ord=n,
        tag=tag,
        pattern=pattern,
        ignore_case=ignore_case,
        starts=_HINTS[n][0],
        needs=_HINTS[n][1],
        crosses_tags=n in _CROSSING,
        recheck=n in _RECHECKED,
        linear=_LINEAR.get(n, ""),
        ends=_ENDS.get(n, ""),
    )
    for n, (tag, pattern, ignore_case) in enumerate(_FIXED_RULES, start=1)
)
