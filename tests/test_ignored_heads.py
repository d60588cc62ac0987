"""Ids meet only stretches that begin as they do, and few ids meet them without a shuffle of these."""

import pytest

from pennyworks.sources import manual


@pytest.mark.parametrize("heads", [1, 500])
def test_ignored_by_beginning(spark, monkeypatch, heads):
    monkeypatch.setattr(manual, "HEADS", heads)
    metas = ["txn:o12, src:1", "txn:o1", "x", "", "ends o9", "é😀z", None, "o", "ab"]
    ids = ["o12", "x", "o9", "😀z", "", "abc", "o12"]
    txns = spark.createDataFrame([(k, m) for k, m in enumerate(metas)], "k int, meta string")
    found = manual.without_ignored(txns, spark.createDataFrame([(i,) for i in ids], "id string"))
    due = {k for k, m in enumerate(metas) if m is None or not any(i and i in m for i in ids)}
    assert {r.k for r in found.collect()} == due
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
