"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.

In every stage texts are read whole, however long, an empty table gives an empty one, other columns stay whatever they are called,
and repeated rows are treated alike. Nulls and ties are stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennyworks.llm import ngram_jaccard, packing, pii, pu_quality, weak_quality
from pennyworks.llm.common import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. A null text is scored as an empty one; a score at the threshold keeps; a null doc_id is like any other."""
    return pu_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules do not reject. A null text has too few words and goes; a posterior of one half keeps."""
    return weak_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies. Null and blank texts and rows without a doc_id link with nothing and stay."""
    return ngram_jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars, where there is such a column, is counted anew, and is null with the text.

    Where spans overlap, the first one's kind stands for all that they cover. A text without personal data, an empty or a null one stays as it is."""
    found = pii.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place there. A null text is one piece of the separator; ties in length keep a fixed order."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
