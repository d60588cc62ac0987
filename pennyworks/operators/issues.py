"""What is wrong with a ledger, as rows (kind, account, detail, n), and warnings by their first words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennyworks.functions.formats import fixed
from pennyworks.operators import prices


def warning_groups(warnings: DataFrame, text: str = "warning") -> DataFrame:
    """Number of warnings by what stands before their first colon; `Other` without one."""
    kind = F.when(F.instr(text, ":") > 0, F.substring_index(text, ":", 1)).otherwise("Other")
    return warnings.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def unverified(balances: DataFrame, declared: DataFrame) -> DataFrame:
    """Assets accounts for which no opening balance is declared."""
    held = balances.where(F.col("account").startswith("assets:")).select("account").distinct()
    return held.join(declared.select("account").distinct(), "account", "left_anti")


def collect(kinds: dict[str, DataFrame]) -> DataFrame:
    """One table of all issues; each table has account and n."""
    rows = [found.select(F.lit(kind).alias("kind"), "account", F.col("n").cast("long").alias("n")) for kind, found in kinds.items()]
    return reduce(DataFrame.unionByName, rows)


def badges(issues: DataFrame) -> DataFrame:
    """Issues by account, and how many kinds they are of."""
    return issues.groupBy("account").agg(F.sum("n").alias("n"), F.countDistinct("kind").alias("kinds"))


# Messages: (label, severity, account, message); account is null where an issue is of no single one.


def _messages(rows: DataFrame, label: Column | str, severity: str, message: Column, account: Column | None = None) -> DataFrame:
    label = F.lit(label) if isinstance(label, str) else label
    account = F.lit(None).cast("string") if account is None else account
    return rows.select(label.alias("label"), F.lit(severity).alias("severity"), account.alias("account"), message.alias("message"))


def parse_messages(diagnostics: DataFrame) -> DataFrame:
    """diagnostics(file, chunk, n, problem) of ledger_text; a file is named by the last part of its path, a line by its split and place there."""
    place = F.concat(F.lit("line "), F.concat_ws(".", "chunk", "n"), F.lit(" — "), F.col("problem"))
    return _messages(diagnostics, "Parse Errors", "error", F.concat(place, F.lit(" ("), F.substring_index("file", "/", -1), F.lit(")")))


def uncategorised_messages(txns: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """How many of txns(date, payee, narration) there are, the first by `order`, and how many more; none if there are none."""
    n = txns.agg(F.count("*").alias("n")).where("n > 0")
    head = F.concat(F.col("n").cast("string"), F.lit(" uncategorised transaction"), F.when(F.col("n") == 1, "").otherwise("s"))
    more = n.where(F.col("n") > most)
    first = txns.orderBy(*order).limit(most)
    text = F.concat(F.col("date"), F.lit(" "), F.coalesce("payee", F.lit("")), F.lit(" — "), F.coalesce("narration", F.lit("")))
    rows = (n.select(head.alias("m")), first.select(text.alias("m")), more.select(F.concat(F.lit("...and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("m")))
    return _messages(reduce(DataFrame.unionByName, rows), "Uncategorised", "warning", F.col("m"))


def warning_messages(warnings: DataFrame, text: str = "warning") -> DataFrame:
    """What stands after a warning's first colon, under the account that stands before it; `Other` without one."""
    apart = F.instr(text, ":") > 0
    label = F.when(apart, F.trim(F.substring_index(text, ":", 1))).otherwise("Other")
    message = F.when(apart, F.trim(F.substr(F.col(text), F.instr(text, ":") + 1))).otherwise(F.col(text))
    return _messages(warnings, label, "warning", message, label)


def gap_messages(gaps: DataFrame) -> DataFrame:
    """gaps(account, month), a message an account."""
    months = gaps.groupBy("account").agg(F.array_join(F.sort_array(F.collect_set("month")), ", ").alias("months"))
    return _messages(months, F.col("account"), "info", F.concat(F.lit("Missing data for: "), "months"), F.col("account"))


def unverified_messages(balances: DataFrame, declared: DataFrame) -> DataFrame:
    return _messages(unverified(balances, declared), "Unverified Balance", "info", F.concat("account", F.lit(" — no opening balance")))


def unpriced_messages(postings: DataFrame, quotes: DataFrame, base: str) -> DataFrame:
    """Commodities with postings(date, account, commodity) that no price of their day leads to base: how many, from when to when, and of which accounts.

    Postings are counted by commodity, account and day before prices are looked up, so a conversion is one row of these.
    """
    days = postings.where(F.coalesce(F.col("commodity") != "", F.lit(False)) & (F.col("commodity") != base)).groupBy("commodity", "account", "date").agg(F.count("*").alias("n"))
    asks = days.select("commodity", "date").distinct().withColumn("amount", F.lit(1.0))
    lost = prices.convert(asks, quotes, base).where("value is null").select("commodity", "date")
    found = days.join(lost, ["commodity", "date"], "left_semi").groupBy("commodity").agg(
        F.sum("n").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.array_join(F.sort_array(F.collect_set("account")), ", ").alias("accounts")
    )
    text = F.concat(F.col("commodity"), F.lit(" — "), F.col("n").cast("string"), F.lit(" postings, "), F.col("first"), F.lit(" → "), F.col("last"), F.lit(" ("), F.col("accounts"), F.lit(")"))
    return _messages(found, "Unpriced", "warning", text)


def suggestion_messages(pairs: DataFrame, legs: DataFrame) -> DataFrame:
    """Pairs (sell, buy) of ids as what was given for what, from legs(id, at, commodity, amount); ids are unique."""
    size = F.regexp_replace(fixed(F.abs("amount"), 6), r"\.?0+$", "")
    shown = F.concat_ws(" ", size, "commodity")
    sells = legs.select(F.col("id").alias("sell"), F.concat_ws(" ", F.substring("at", 1, 10), shown).alias("given"))
    buys = legs.select(F.col("id").alias("buy"), shown.alias("got"))
    found = pairs.join(sells, "sell").join(buys, "buy")
    return _messages(found, "Suggested Trades", "info", F.concat_ws(" → ", "given", "got"))


def all_messages(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)
