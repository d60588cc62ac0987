"""Bank statements in the tagged text form of OFX, parsed with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCK = r"(?is)<STMTTRN>.*?(?=</STMTTRN>|<STMTTRN>|\z)"


def _tag(text: Column, name: str) -> Column:
    """A tag's value up to the next tag or line end; null if there is none."""
    value = F.trim(F.regexp_extract(text, rf"(?i)<{name}>([^<\r\n]*)", 1))
    return F.when(value != "", value)


def statements(files: DataFrame) -> DataFrame:
    """file, pos, currency, type, date, amount, fitid, memo of every statement line of files(file, value).

    A line without a FITID gets one made of its date, amount and memo, numbered if the file repeats them. An
    amount that is no number is null.
    """
    blocks = files.select("file", F.coalesce(_tag(F.col("value"), "CURDEF"), F.lit("USD")).alias("currency"), F.posexplode(F.regexp_extract_all("value", F.lit(_BLOCK), 0)).alias("pos", "block"))
    block = F.col("block")
    day = F.regexp_extract(F.coalesce(_tag(block, "DTPOSTED"), F.lit("")), r"^(\d{4})(\d{2})(\d{2})", 0)
    date = F.when(day != "", F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))
    amount = F.regexp_replace(_tag(block, "TRNAMT"), ",", "")
    rows = blocks.select(
        "file", "pos", "currency", _tag(block, "TRNTYPE").alias("type"), date.alias("date"), amount.alias("amount_text"), amount.try_cast("double").alias("amount"),
        _tag(block, "FITID").alias("fitid"), F.coalesce(_tag(block, "MEMO"), _tag(block, "NAME")).alias("memo"),
    )
    same = Window.partitionBy("file", "date", "amount_text", "memo", F.col("fitid").isNull()).orderBy("pos")
    n = F.row_number().over(same) - 1
    text = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("date", "amount_text", "memo")))
    made = F.concat(F.lit("syn-"), F.substring(F.sha2(F.concat(text, F.when(n > 0, F.concat(F.lit("#"), n.cast("string"))).otherwise("")), 256), 1, 12))
    return rows.withColumn("fitid", F.coalesce("fitid", made)).drop("amount_text")


def transactions(lines: DataFrame, account: str, contra: str = "expenses:unknown") -> DataFrame:
    """Two legs a statement line; the id is a digest of its file and FITID."""
    leg = lambda a, x: F.struct(F.lit(a).alias("account"), x.alias("amount"), F.col("currency").alias("commodity"))
    txn = F.concat(F.lit("txn:ofx-"), F.substring(F.sha2(F.concat_ws(":", "file", "fitid"), 256), 1, 12))
    amount = F.coalesce("amount", F.lit(0.0))
    return lines.select("file", "date", F.lit("*").alias("status"), F.col("memo").alias("payee"), F.col("memo").alias("narration"), txn.alias("meta"), F.array(leg(account, amount), leg(contra, -amount)).alias("postings"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return statements(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))
