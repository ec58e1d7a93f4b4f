"""Trigger phrases: what follows one of them is sensitive by its place."""

from __future__ import annotations

from dataclasses import dataclass

NUMBER = "NUM"
REST_OF_LINE = "TEXT_ON_LINE"


@dataclass(frozen=True)
class ContextRule:
    ord: int
    trigger: str
    target: str
    tag: str


# Trigger phrase, kind of target and tag, in rule order.
_FIXED_RULES: list[tuple[str, str, str]] = [
    ("Source:", REST_OF_LINE, "<source>"),
    ("Destination:", REST_OF_LINE, "<destination>"),
    ("Install On:", REST_OF_LINE, "<install_target>"),
    ("Salary:", NUMBER, "<salary>"),
    ("Account Balance:", NUMBER, "<balance>"),
    ("Transaction ID", NUMBER, "<transaction_id>"),
    ("Invoice No", NUMBER, "<invoice_no>"),
    ("Order ID", NUMBER, "<order_id>"),
    ("Reference No", NUMBER, "<reference_no>"),
    ("Age:", NUMBER, "<age>"),
    ("Employee ID:", NUMBER, "<employee_id>"),
    ("Customer ID:", NUMBER, "<customer_id>"),
    ("Policy No", NUMBER, "<policy_no>"),
    ("PIN:", NUMBER, "<pin>"),
    ("OTP:", NUMBER, "<otp>"),
    ("Verification Code:", NUMBER, "<verification_code>"),
]

CONTEXT_RULES: tuple[ContextRule, ...] = tuple(
    ContextRule(n, trigger, target, tag)
    for n, (trigger, target, tag) in enumerate(_FIXED_RULES, start=1)
)
