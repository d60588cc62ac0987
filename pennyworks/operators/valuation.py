"""What postings cost or brought, from annotations, from the other postings of a transaction, or from prices; transfers between own accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennyworks.operators.lots import EPSILON


def annotation_value(annotation: Column, quantity: Column) -> Column:
    """The whole amount of a cost or price annotation(is_total, amount, commodity), or its unit amount times the quantity."""
    return F.when(annotation["is_total"], annotation["amount"]).otherwise(annotation["amount"] * F.abs(quantity))


def in_base(value: Column, commodity: Column, base: str, rate: Column | None = None) -> Column:
    """value as it is in base, else by a rate; unconverted where there is none."""
    return F.when(commodity == base, value).otherwise(F.coalesce(value * rate, value) if rate is not None else value)


def _other(base: str, sign: int) -> Column:
    """Amount of the first posting in base, after the first posting, whose sign is `sign`."""
    rest = F.slice("postings", 2, 1 << 30)
    amount = F.get(F.filter(rest, lambda p: (p["commodity"] == base) & (p["amount"] * sign > 0)), F.lit(0))["amount"]
    return F.abs(amount)


def acquisition_cost(txns: DataFrame, base: str, converted: Column, rate: Column | None = None) -> DataFrame:
    """txns(postings, cost, price) with the `value` of what their first posting acquired, and where it is from.

    The first that there is: the cost annotation, the price annotation, what was paid in base, the own conversion, or 0.
    """
    quantity = F.col("postings")[0]["amount"]
    found = [
        ("cost", in_base(annotation_value(F.col("cost"), quantity), F.col("cost.commodity"), base, rate)),
        ("price", in_base(annotation_value(F.col("price"), quantity), F.col("price.commodity"), base, rate)),
        ("paid", _other(base, -1)),
        ("converted", F.abs(converted)),
    ]
    return _first_of(txns, found)


def sale_proceeds(txns: DataFrame, base: str, converted: Column, rate: Column | None = None) -> DataFrame:
    """As acquisition_cost, for disposals: the price annotation, what was received in base, the own conversion, or 0. A cost annotation says nothing of a sale."""
    quantity = F.col("postings")[0]["amount"]
    found = [
        ("price", in_base(annotation_value(F.col("price"), quantity), F.col("price.commodity"), base, rate)),
        ("received", _other(base, 1)),
        ("converted", F.abs(converted)),
    ]
    return _first_of(txns, found)


def _first_of(txns: DataFrame, found: list[tuple[str, Column]]) -> DataFrame:
    pick = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(k).alias("origin"))) for k, v in found], F.struct(F.lit(0.0).alias("value"), F.lit("none").alias("origin")))
    return txns.withColumn("_v", pick).withColumn("value", F.col("_v.value")).withColumn("origin", F.col("_v.origin")).drop("_v")


def posting_value(amount: Column, commodity: Column, cost: Column, price: Column, other: Column, converted: Column, base: str) -> Column:
    """Value in base of an income or expense posting with the sign of its amount (that of 0 is positive); null if nothing tells."""
    sign = F.when(amount < 0, -1.0).otherwise(1.0)
    own = F.when(commodity == base, F.abs(amount))
    return sign * F.coalesce(own, annotation_value(cost, amount), annotation_value(price, amount), F.abs(other), F.abs(converted))


def transfers(postings: DataFrame, key: list[str]) -> DataFrame:
    """Keys and commodities of which two or more assets postings cancel out: moved between own accounts, so neither bought nor sold."""
    assets = postings.where(F.col("account").startswith("assets:"))
    total = F.sum(F.col("amount").cast("decimal(24,6)")).cast("double")
    return assets.groupBy(*key, "commodity").agg(F.count("*").alias("n"), total.alias("total")).where((F.col("n") >= 2) & (F.abs("total") < EPSILON)).drop("total")


def rebased(points: DataFrame, value: str = "value", cap: float = 10_000.0) -> DataFrame:
    """points(date, value) with `pct`, the change since the first value that is not 0; the points are one row a snapshot."""
    from pyspark.sql import Window

    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.first(F.when(F.abs(value) >= EPSILON, F.col(value)), ignorenulls=True).over(w)
    pct = (F.col(value) - F.col("anchor")) / F.abs("anchor") * 100
    return points.withColumn("anchor", anchor).withColumn("pct", F.least(F.lit(cap), F.greatest(F.lit(-cap), pct))).drop("anchor")


def offset_losses(short: Column, long: Column, losses: Column, discount: float) -> tuple[Column, Column, Column]:
    """(taxable, carried forward, offset) of gains short and long, losses first against short gains, then long ones, then the discount on the rest."""
    to_short = F.least(short, losses)
    to_long = F.least(long, losses - to_short)
    left = losses - to_short - to_long
    return (short - to_short) + (long - to_long) * (1 - discount), left, to_short + to_long


def loss_carry(years: DataFrame, discount: float) -> DataFrame:
    """years(key, fy, short, long, losses) with `taxable`, `used` and `carried`, when losses that are left go on to the next years of their key.

    Losses, those carried first among them, go against short gains, then long ones, then the discount holds. A key's years are one small array
    that is folded in order, so there is one shuffle and no recursion; years without rows carry on what there is.
    """
    zero = F.lit(0.0)

    def step(state: Column, y: Column) -> Column:
        taxable, left, used = offset_losses(y["short"], y["long"], y["losses"] + state["carried"], discount)
        now = F.struct(y["fy"].alias("fy"), taxable.cast("double").alias("taxable"), used.cast("double").alias("used"), left.cast("double").alias("carried"))
        return F.struct(left.cast("double").alias("carried"), F.concat(state["done"], F.array(now)).alias("done"))

    start = F.struct(zero.alias("carried"), F.array().cast("array<struct<fy: int, taxable: double, used: double, carried: double>>").alias("done"))
    year = F.struct(F.col("fy").cast("int").alias("fy"), *(F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in ("short", "long", "losses")))
    folded = years.groupBy("key").agg(F.aggregate(F.sort_array(F.collect_list(year)), start, step).alias("s"))
    return folded.select("key", F.explode("s.done").alias("y")).select("key", "y.*")


def harvest(parcels: DataFrame, short: Column, long: Column, losses: Column, discount: float, rate: float) -> DataFrame:
    """What the losses of parcels(left, cost, value) would save: offset now against the gains that realised losses leave, carried forward, and tax.

    One row; short, long and losses are columns of it, such as literals or those of a one-row table joined to the parcels.
    """
    whole = parcels.agg(F.coalesce(F.sum(F.greatest(F.col("cost") - F.col("value"), F.lit(0.0))), F.lit(0.0)).alias("realisable"), F.count("*").alias("parcels"))
    free_short = F.greatest(short - losses, F.lit(0.0))
    free_long = F.greatest(long - F.greatest(losses - short, F.lit(0.0)), F.lit(0.0))
    on_short = F.least("realisable", free_short)
    on_long = F.least(F.col("realisable") - on_short, free_long)
    return whole.select("parcels", "realisable", (on_short + on_long).alias("offset"), (F.col("realisable") - on_short - on_long).alias("carried"), ((on_short + (1 - discount) * on_long) * rate).alias("saved"))
