"""The search language: `[-]field:pattern` and free-text terms joined by AND (tighter) and OR, to a Column.

There are no parentheses. Operators are upper-case words; a term that begins with `-` is negated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pennyworks.functions.patterns import number_condition

FIELDS = ("payee", "narration", "meta", "date", "account", "commodity", "amount", "fee", "is")


@dataclass(frozen=True)
class Term:
    field: str | None
    pattern: str
    negated: bool = False


def parse(text: str) -> list[list[Term]]:
    """Alternatives of conjunctions; an empty search is one empty conjunction, which everything matches."""
    if not text.strip():
        return [[]]
    parts = [p.strip() for p in re.split(r"\b(AND|OR)\b", text)]
    if any(not p for p in parts):
        raise ValueError("an operator needs a term on either side")
    out: list[list[Term]] = [[_term(parts[0])]]
    for op, part in zip(parts[1::2], parts[2::2], strict=True):
        if op == "AND":
            out[-1].append(_term(part))
        else:
            out.append([_term(part)])
    return out


def _term(text: str) -> Term:
    negated = text.startswith("-")
    text = text[1:] if negated else text
    m = re.match(r"([A-Za-z_]+):(.*)", text, re.S)
    if not m:
        return Term(None, text, negated)
    if m[1] not in FIELDS:
        raise ValueError(f"unknown field {m[1]}")
    if m[1] == "is" and m[2].strip() != "swap":
        raise ValueError(f"unknown label {m[2]}")
    return Term(m[1], m[2].strip(), negated)


def _regex(pattern: str) -> str:
    return "(?iu)" + pattern


def _date(value: Column, pattern: str) -> Column:
    """Dates are compared as text."""
    if ".." in pattern:
        low, high = (x.strip() for x in pattern.split("..", 1))
        return value.between(low, high)
    if m := re.fullmatch(r"(>=|<=|>|<)\s*(.+)", pattern):
        return {">=": value >= m[2], "<=": value <= m[2], ">": value > m[2], "<": value < m[2]}[m[1]]
    return value.rlike(_regex(pattern))


def free_text() -> Column:
    legs = F.array_join(F.transform("postings", lambda p: F.concat_ws(" ", p["account"], p["commodity"], p["amount"].cast("string"))), " ")
    return F.concat_ws(" ", "date", "payee", "narration", "meta", legs)


def _column(term: Term, has: frozenset[str]) -> Column:
    p, text = term.pattern, lambda c: F.coalesce(F.col(c), F.lit(""))
    if term.field == "payee":
        found = text("payee").rlike(_regex(p)) | (text("display_payee").rlike(_regex(p)) if "display_payee" in has else F.lit(False))
    elif term.field in ("narration", "meta"):
        found = text(term.field).rlike(_regex(p))
    elif term.field == "date":
        found = _date(F.col("date"), p)
    elif term.field == "account":
        found = F.exists("postings", lambda x: x["account"].rlike(_regex(p)))
    elif term.field == "commodity":
        glob = "(?iu)^" + ".*".join(re.escape(x) for x in p.split("*")) + "$"
        found = F.exists("postings", lambda x: x["commodity"].rlike(glob))
    elif term.field in ("amount", "fee"):
        value = F.col("postings")[0]["amount"] if term.field == "amount" else fee()
        condition = number_condition(value, p)
        found = value.cast("string").rlike(_regex(p)) if condition is None else condition
    elif term.field == "is":
        found = F.col("is_swap")
    else:
        found = free_text().rlike(_regex(p))
    found = F.coalesce(found, F.lit(False))
    return ~found if term.negated else found


def fee() -> Column:
    """Amount of the last posting if there are three or more and its account is one of fees."""
    last = F.col("postings")[F.size("postings") - 1]
    return F.when((F.size("postings") >= 3) & last["account"].startswith("expenses:fees"), last["amount"])


def condition(text: str, columns: list[str] | None = None) -> Column:
    """Predicate over transactions(date, payee, narration, meta, postings, is_swap for `is:swap`)."""
    has, out = frozenset(columns or ()), None
    for conjunction in parse(text):
        every = F.lit(True)
        for term in conjunction:
            every = every & _column(term, has)
        out = every if out is None else out | every
    return out
