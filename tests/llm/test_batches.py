"""What a task holds at once does not grow with its rows."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pennyworks.llm import common, ngram_jaccard, packing, pii, pu_quality

MODEL = pu_quality.Model(np.zeros((len(pu_quality.FEATURES), 1)), np.zeros((len(pu_quality.FEATURES), 2)), 0.0, 0.5)
STEPS = {
    "score": lambda docs: pu_quality.score(docs, MODEL),
    "profiles": lambda docs: ngram_jaccard._profiles(docs, np.empty(0, np.uint64)),
    "redact": pii.redact,
    "spans": pii.spans,
    "pieces": packing.piece_table,
}


@pytest.fixture
def limit(spark):
    key = common._MAX_BATCH
    before = spark.conf.getAll.get(key)
    spark.conf.unset(key)
    yield SimpleNamespace(key=key)
    spark.conf.set(key, before) if before else spark.conf.unset(key)


@pytest.mark.parametrize("step", STEPS)
def test_steps_of_the_pipeline_give_a_large_batch_back_in_parts(spark, monkeypatch, step):
    docs, taken = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.append(run))
    STEPS[step](docs)
    rows = 3 * common.ROWS_AT_ONCE + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array([f"text {k} of many" for k in range(rows)])], names=["doc_id", "text"])
    back = list(taken[0](iter([batch])))
    assert max(b.num_rows for b in back) <= common.ROWS_AT_ONCE
    assert [x for b in back for x in b.column(0).to_pylist()] == list(range(rows))


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["rows", "size"])


def test_long_rows_are_sent_by_bytes(spark, limit):
    docs = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4_000).alias("text"))
    pii.redact(docs)
    found = docs.mapInArrow(_sizes, "rows long, size long").collect()
    assert sum(r.rows for r in found) == 2_000
    assert max(r.size for r in found) <= 1.5 * common.BATCH_BYTES


def test_a_limit_that_the_user_set_stays(spark, limit):
    spark.conf.set(limit.key, "123456")
    common.small_batches(spark.range(1))
    assert spark.conf.get(limit.key) == "123456"
