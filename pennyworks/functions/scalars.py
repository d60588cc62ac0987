"""Scalar functions on dates, text, ids and amounts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_datetime(text: Column) -> Column:
    """`date time` for comparison: midnight where there is only a date; what follows `.`, `Z` or `+` goes, a zone with `-` stays."""
    t = F.trim(text)
    with_t = F.concat(F.substring(t, 1, 10), F.lit(" "), F.regexp_extract(t, r"^.{11}([^.Z+]*)", 1))
    return F.when(F.length(t) == 10, F.concat(t, F.lit(" 00:00:00"))).when(F.substring(t, 11, 1) == "T", with_t).when(F.length(t) > 19, F.substring(t, 1, 19)).otherwise(t)


def iso_date(text: Column) -> Column:
    """YYYY-MM-DD of text that begins so or with YYYYMMDD; digits only, not held against a calendar; else null."""
    dashed, plain = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(text, r"^(\d{8})", 1)
    cut = F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2))
    return F.when(dashed != "", dashed).when(plain != "", cut)


def minus_months(date: Column, months: int) -> Column:
    """The same day so many months before, or that month's last."""
    return F.date_format(F.add_months(F.to_date(date), -months), "yyyy-MM-dd")


def ledger_days(text: Column) -> Column:
    """A day number of a date and time as text in which years have 365 days and months 30."""
    part = lambda at, n: F.substring(text, at, n).cast("long")
    return part(1, 4) * 365 + part(6, 2) * 30 + part(9, 2)


def within_seconds(a: Column, b: Column, seconds: int) -> Column:
    """Whether two times `YYYY-MM-DD HH:MM:SS` are so near, by ledger_days."""
    part = lambda c, at: F.coalesce(F.substring(c, at, 2).try_cast("long"), F.lit(0))
    second = lambda c: ledger_days(c) * 86_400 + part(c, 12) * 3_600 + part(c, 15) * 60 + part(c, 18)
    return F.abs(second(a) - second(b)) <= seconds


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def sanitised_commodity(text: Column) -> Column:
    """Upper-case letters and digits, others as one underscore; `X` before a digit at the start."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain.rlike("^[0-9]"), F.concat(F.lit("X"), plain)).otherwise(plain)


def sign(value: Column) -> Column:
    """-1 or 1; that of 0 is 1."""
    return F.when(value < 0, -1).otherwise(1)


def from_base_units(units: Column, decimals: int) -> Column:
    """Whole units, as text of any length, as a decimal number in text: no digit is lost, however large."""
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(decimals + 1) - F.length(units), F.lit(0))), units)
    cut = F.length(padded) - decimals
    whole = F.regexp_replace(F.substr(padded, F.lit(1), cut), "^0+(?=.)", "")
    return F.concat(whole, F.lit("."), F.substr(padded, cut + 1, F.lit(decimals)))


def short_address(text: Column, head: int = 6, tail: int = 4) -> Column:
    return F.when(F.length(text) > head + tail + 1, F.concat(F.substring(text, 1, head), F.lit("…"), F.substring(text, -tail, tail))).otherwise(text)


def folder_account(folder: Column, root: str = "assets") -> Column:
    """The account of a folder path, and of its set, the first segment."""
    return F.concat(F.lit(root + ":"), F.regexp_replace(F.lower(folder), "/+", ":"))


def meta_append(meta: Column, segment: Column) -> Column:
    """meta with one more comma-separated segment, unless it has that already."""
    segments = F.filter(F.transform(F.split(F.coalesce(meta, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_union(segments, F.array(segment)), ", ")


def meta_remove(meta: Column, key: str) -> Column:
    """meta without the segments of a key."""
    segments = F.filter(F.transform(F.split(F.coalesce(meta, F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith(f"{key}:"))
    return F.array_join(segments, ", ")
