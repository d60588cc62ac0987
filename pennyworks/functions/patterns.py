"""Patterns of the search language and of rules, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
_NUMBER = r"[+-]?\d+(?:\.\d+)?"


def wildcard_regex(pattern: str) -> str | None:
    """Anchored pattern for alternatives with `*`; None for the empty pattern, which fits anything."""
    if not pattern:
        return None
    choices = ["".join(".*" if c == "*" else re.escape(c) for c in p.strip()) for p in pattern.split("|")]
    return "(?ius)^(?:" + "|".join(choices) + ")$"


def wildcard(value: Column, pattern: str) -> Column:
    found = wildcard_regex(pattern)
    return F.lit(True) if found is None else F.coalesce(value, F.lit("")).rlike(found)


def compare(value: Column, op: str, number: float, tolerance: float = EPSILON) -> Column:
    if op in ("=", ""):
        return F.abs(value - number) < tolerance
    return {">=": value >= number, "<=": value <= number, ">": value > number, "<": value < number}[op]


def number_condition(value: Column, text: str) -> Column | None:
    """`>= > <= < =` or a bare number; None if the text is neither."""
    m = re.fullmatch(rf"\s*(>=|<=|>|<|=|)\s*({_NUMBER})\s*", text)
    return compare(value, m[1], float(m[2])) if m else None


def rule_amount(value: Column, text: str) -> Column:
    """`lo..hi` or a comparison; a condition that cannot be read, a bare number among them, always holds."""
    if m := re.fullmatch(rf"\s*({_NUMBER})\s*\.\.\s*({_NUMBER})\s*", text):
        return value.between(float(m[1]), float(m[2]))
    if m := re.fullmatch(rf"\s*(>=|<=|>|<|=)\s*({_NUMBER})\s*", text):
        return compare(value, m[1], float(m[2]), 1e-9)
    return F.lit(True)


def meta_segments(meta: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(meta, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def meta_value(meta: Column, key: str) -> Column:
    """Value of the first `key:value` segment, or null."""
    segment = F.get(F.filter(meta_segments(meta), lambda x: x.startswith(f"{key}:")), F.lit(0))
    return F.substring(segment, len(key) + 2, 1 << 30)


def in_scope(account: Column, prefix: str) -> Column:
    return (account == prefix) | account.startswith(prefix + ":")


def allowed(account: Column, exact: list[str], prefixes: list[str]) -> Column:
    """Whether an account is one of some or below one of others; blanks count as none."""
    found = account.isin([x for x in exact if x.strip()]) if any(x.strip() for x in exact) else F.lit(False)
    for p in (x for x in prefixes if x.strip()):
        found = found | in_scope(account, p)
    return found
