"""CSV rows to transactions, by a mapping of fields to SQL expressions over a row's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennyworks.sources.ledger_text import NUMBER

# The accounts and the currency that stand where a row names none.
CONTRA, FEES, CURRENCY = "expenses:unknown", "income:trading:fees", "USD"
FIELDS = ("date", "amount", "commodity", "payee", "narration", "contra", "fee", "id", "skip")


def _number(text: Column) -> Column:
    plain = F.regexp_replace(text.cast("string"), r"[$,\s]", "")
    return F.when(plain.rlike(NUMBER), plain.cast("double"))


def transactions(rows: DataFrame, mapping: dict[str, str], account: str, path: str = "file", row: str = "row") -> DataFrame:
    """Transactions (date, payee, narration, meta, postings) of rows, with `mapping` from FIELDS to expressions; date and amount are needed.

    Rows without a date or a number as amount, and those that `skip` holds for, are left out. A fee, `1.5` or `1.5 EUR`, is a leg of its own and, if
    it is in the commodity of the row, comes off the account's leg. The id is the row's own, else a hash of its file and number.
    """
    unknown = sorted(set(mapping) - set(FIELDS))
    if unknown or not {"date", "amount"} <= set(mapping):
        raise ValueError(f"a mapping needs date and amount and knows {FIELDS}, not {unknown}")
    field = lambda name, other=None: F.coalesce(F.nullif(F.trim(F.expr(mapping[name]).cast("string")), F.lit("")), F.lit(other)) if name in mapping else F.lit(other).cast("string")
    made = F.concat(F.lit("csv-"), F.substring(F.sha2(F.concat_ws(":", F.col(path), F.col(row).cast("string")), 256), 1, 12))
    kept = rows.where(~F.coalesce(F.expr(mapping["skip"]), F.lit(False))) if "skip" in mapping else rows
    fee = F.split(field("fee"), r"\s+")
    read = kept.select(
        field("date").alias("date"), field("payee").alias("payee"), field("narration").alias("narration"), F.concat(F.lit("txn:"), F.coalesce(field("id"), made)).alias("meta"),
        _number(F.expr(mapping["amount"])).alias("amount"), field("commodity", CURRENCY).alias("commodity"), field("contra", CONTRA).alias("contra"),
        F.coalesce(_number(fee[0]), F.lit(0.0)).alias("fee"), F.get(fee, F.lit(1)).alias("fee_in"),
    )
    read = read.where("date is not null and amount is not null").withColumn("fee_in", F.coalesce("fee_in", "commodity"))
    charged = F.abs("fee") > 1e-9
    own = F.col("amount") - F.when(charged & (F.col("fee_in") == F.col("commodity")), F.col("fee")).otherwise(0.0)
    leg = lambda a, x, c: F.struct(a.alias("account"), x.alias("amount"), F.col(c).alias("commodity"))
    legs = F.array(leg(F.lit(account), own, "commodity"), leg(F.col("contra"), -F.col("amount"), "commodity"), F.when(charged, leg(F.lit(FEES), F.col("fee"), "fee_in")))
    return read.select("date", "payee", "narration", "meta", F.filter(legs, lambda p: p.isNotNull()).alias("postings"))
