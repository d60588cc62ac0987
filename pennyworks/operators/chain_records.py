"""Records of a chain mended by what its transactions say: phantom receipts, token accounts, doubles and missing fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINGERPRINT = ["tx", "asset", "value", "direction"]


def without_closes(records: DataFrame, closes: DataFrame, held: DataFrame, coin: str, wrapped: str) -> DataFrame:
    """records(tx, wallet, asset, contract, sender, receiver) less receipts of the coin from a wrapped account that the wallet closed to itself in the transaction.

    closes(tx, account, owner, destination) and held(tx, account, mint), what accounts held before it. What the account held was credited before.
    """
    own = closes.where("owner = destination").join(held.where(F.col("mint") == wrapped), ["tx", "account"], "left_semi")
    own = own.select("tx", F.col("account").alias("sender"), F.col("owner").alias("wallet"), F.lit(coin).alias("asset")).distinct()
    phantom = own.withColumn("receiver", F.col("wallet")).withColumn("_bare", F.lit(True))
    marked = records.withColumn("_bare", F.coalesce("contract", F.lit("")) == "")
    return marked.join(phantom, ["tx", "sender", "wallet", "asset", "receiver", "_bare"], "left_anti").select(*records.columns)


def account_state(before: DataFrame, after: DataFrame) -> DataFrame:
    """tx, account, mint, owner, decimals, pre and post of entries(tx, account, mint, owner, decimals, amount); what a later entry tells, an earlier one need not."""
    both = before.withColumn("phase", F.lit(0)).unionByName(after.withColumn("phase", F.lit(1)))
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("phase"))).alias(c) for c in ("mint", "owner", "decimals")]
    amount = lambda k: F.coalesce(F.sum(F.when(F.col("phase") == k, F.col("amount").cast("decimal(38,0)"))), F.lit(0).cast("decimal(38,0)"))
    return both.groupBy("tx", "account").agg(*latest, amount(0).alias("pre"), amount(1).alias("post"))


def _counted(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*FINGERPRINT).orderBy(*order)))


def merged(base: DataFrame, extra: DataFrame, order: list[str]) -> DataFrame:
    """base and those of extra that it lacks: the k-th of a fingerprint is a double if base has k of it, so that equal transfers stay as many as there were."""
    new = _counted(extra, order).join(_counted(base, order).select(*FINGERPRINT, "_k"), [*FINGERPRINT, "_k"], "left_anti")
    return base.unionByName(new.select(*base.columns))


def enriched(base: DataFrame, extra: DataFrame, fields: list[str]) -> DataFrame:
    """base with null fields from extra, where one record only has the fingerprint on either side."""
    only = extra.groupBy(*FINGERPRINT).agg(F.count("*").alias("_n"), *(F.first(c).alias(f"_{c}") for c in fields)).where("_n = 1").drop("_n")
    alone = base.groupBy(*FINGERPRINT).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    met = base.join(only.join(alone, FINGERPRINT, "left_semi"), FINGERPRINT, "left")
    return met.select(*(F.coalesce(c, f"_{c}").alias(c) if c in fields else c for c in base.columns))
