"""Ordered rules over transactions, swap labels, leg numbers and display groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennyworks.functions.patterns import meta_segments, rule_amount, wildcard


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str = ""
    field: str = "payee"
    account: str | None = None
    amount: str | None = None
    meta: str | None = None
    fee_account: str | None = None
    display_payee: str | None = None

    def condition(self) -> Column:
        first = F.col("postings")[0]
        value = {"commodity": first["commodity"], "account": first["account"]}.get(self.field)
        found = wildcard(F.col(self.field) if value is None else value, self.pattern)
        if self.amount:
            found = found & rule_amount(first["amount"], self.amount)
        if self.meta:
            found = found & F.array_contains(F.transform(meta_segments(F.col("meta")), lambda x: F.lower(x)), self.meta.lower())
        return F.coalesce(found, F.lit(False))


def first_match(txns: DataFrame, rules: list[Rule], default: str = "expenses:unknown") -> DataFrame:
    """txns with `rule_id` and `contra` of the first rule that holds. Each rule's condition stands once, in one array of outcomes."""
    held = [F.when(r.condition(), F.struct(F.lit(r.id).alias("id"), F.lit(r.account or default).alias("contra"))) for r in rules]
    first = F.coalesce(*held) if held else F.lit(None).cast("struct<id: string, contra: string>")
    found = txns.withColumn("_rule", first)
    return found.withColumn("rule_id", F.col("_rule.id")).withColumn("contra", F.coalesce("_rule.contra", F.lit(default))).drop("_rule")


def specificity(rule: Rule) -> tuple[int, int]:
    """Order of a rule among others: first its kind, then, among rules on meta, one leg before one transaction before the rest.

    Fixed values: 0 meta, 1 payee and narration, 2 payee, 3 narration, 4 any other field, 5 none.
    """
    payee, narration = (rule.field == f and rule.pattern not in ("", "*") for f in ("payee", "narration"))
    rank = 2
    if rule.field == "meta" or rule.meta:
        anchor = (rule.pattern if rule.field == "meta" else rule.meta or "").lower()
        rank = 0 if anchor.startswith("leg:") else 1 if anchor.startswith("txn:") else 2
        return 0, rank
    if payee or narration:
        return (1 if payee and narration else 2 if payee else 3), rank
    return (4 if rule.field not in ("payee", "narration") or rule.amount else 5), rank


def by_specificity(rules: list[Rule]) -> list[Rule]:
    """The most specific first; equals keep their order."""
    return sorted(rules, key=specificity)


def is_noop(rule: Rule, default: str = "expenses:unknown") -> bool:
    """Whether all that a rule does is to set the default account."""
    return (rule.account or default) == default and not rule.display_payee and not rule.fee_account


def shadowed(txns: DataFrame, draft: Rule, earlier: list[Rule]) -> DataFrame:
    """txns that a draft rule fits, with `shadowed_by`: the first of the earlier rules that fits too, or null."""
    by = [F.when(r.condition(), F.lit(r.id)) for r in earlier]
    return txns.where(draft.condition()).withColumn("shadowed_by", F.coalesce(*by, F.lit(None).cast("string")))


def apply(txns: DataFrame, rules: list[Rule], default: str = "expenses:unknown") -> DataFrame:
    """txns as the first rule that fits changes them.

    It may set the payee to show, the account of the second posting and of the third; an `ignore` account also replaces that of the
    first. A second posting of 0 goes where three are there and a rule sets the account. The rule's id is added to meta.
    """
    held = [
        F.when(r.condition(), F.struct(F.lit(r.id).alias("id"), F.lit(r.account).alias("account"), F.lit(r.fee_account).alias("fee"), F.lit(r.display_payee).alias("payee")))
        for r in rules
    ]
    kind = "struct<id: string, account: string, fee: string, payee: string>"
    r = F.col("_r")
    ignored = (r["account"] == "ignore") | r["account"].startswith("ignore:")

    def account(p: Column, i: Column) -> Column:
        own = F.when(i == 0, F.when(ignored, r["account"])).when(i == 1, F.coalesce(r["account"], F.lit(default))).when(i == 2, r["fee"])
        return p.withField("account", F.coalesce(own, p["account"]))

    found = txns.withColumn("_r", F.coalesce(*[h.cast(kind) for h in held], F.lit(None).cast(kind)))
    gone = r["account"].isNotNull() & (F.size("postings") >= 3)
    changed = F.filter(F.transform("postings", account), lambda p, i: ~F.coalesce(gone & (i == 1) & (p["amount"] == 0), F.lit(False)))
    mark = F.concat_ws(", ", "meta", F.concat(F.lit("rule:"), r["id"]))
    return found.withColumn("postings", changed).withColumn("meta", mark).withColumn("display_payee", r["payee"]).drop("_r")


def with_swap_label(txns: DataFrame) -> DataFrame:
    """`is_swap`: the id's valid first legs and their commodities number two and two, or three and three."""
    leg = F.col("postings")[0]
    valid = leg["amount"].isNotNull() & ~F.isnan(leg["amount"]) & (F.abs(leg["amount"]) >= 1e-9)
    counted = txns.where(valid).groupBy("oid").agg(F.count("*").alias("legs"), F.countDistinct(leg["commodity"]).alias("kinds"))
    swaps = counted.where("legs = kinds and legs in (2, 3)").select("oid", F.lit(True).alias("is_swap"))
    return txns.join(swaps, "oid", "left").withColumn("is_swap", F.coalesce("is_swap", F.lit(False)))


def leg_ids(legs: DataFrame) -> DataFrame:
    """`leg`: running number within id, commodity and amount, for ids with two or more legs; else null."""
    same = Window.partitionBy("oid", "commodity", "amount").orderBy("l_linenumber")
    return legs.withColumn("leg", F.when(F.count("*").over(Window.partitionBy("oid")) >= 2, F.row_number().over(same) - 1))


def display_groups(rows: DataFrame) -> DataFrame:
    """Per account, runs of rows in order with the same date and commodity: their number, and what went in and out.

    A run ends with its day, so rows are ordered by account and day, and only the days' numbers of runs by account.
    """
    w = Window.partitionBy("account", "date").orderBy("l_orderkey", "l_linenumber", "commodity", "amount")
    new = F.coalesce(F.lag("commodity").over(w) != F.col("commodity"), F.lit(True)).cast("int")
    in_day = rows.withColumn("new", new).withColumn("in_day", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = in_day.groupBy("account", "date").agg(F.sum("new").alias("runs"))
    days = days.select("account", "date", F.coalesce(F.sum("runs").over(before), F.lit(0)).alias("earlier"))
    runs = in_day.join(days, ["account", "date"]).withColumn("run", F.col("earlier") + F.col("in_day"))
    money = lambda c: F.sum(c.cast("decimal(24,6)")).cast("double")
    a = F.col("amount")
    return runs.groupBy("account", "run").agg(
        F.min("date").alias("date"), F.min("commodity").alias("commodity"), F.count("*").alias("n"),
        money(F.greatest(a, F.lit(0.0))).alias("total_in"), money(F.least(a, F.lit(0.0))).alias("total_out"), money(a).alias("net"),
    )
