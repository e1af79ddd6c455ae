"""Intermediate tables live in the shared folder and can be cleared."""

import pytest
from pyspark.sql import functions as F

from terncove.llm import store


def test_tables_are_reread_and_cleared(spark):
    kept = store.materialize(spark.range(5), "numbers")
    assert store.own_dir(spark).startswith(store.shared_dir(spark)) and kept.count() == 5
    store.clear(spark)
    with pytest.raises(Exception):
        kept.count()


def test_decisions_by_id_and_text(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, None), (2, None)], "doc_id long, text string").withColumn("_id", F.lit("own"))
    gone = docs.select(*store.row_key()).where("_id = 1 and _fp = xxhash64('a') or _id is null")
    left = store.decide(docs, gone, "left_anti")
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "b"), (2, None)]


def test_what_a_filter_rules_out_is_no_key(spark, monkeypatch):
    """Also where the filter is so full that most rows pass: results are the same."""
    docs = spark.createDataFrame([(i, f"t{i % 50}", "x") for i in range(400)], "doc_id long, text string, _key_id string")
    gone = store.materialize(docs.where("doc_id % 3 = 0").select(*store.row_key()), "gone")
    want = [i for i in range(400) if i % 3]
    for words in (1 << 20, 4):
        monkeypatch.setattr(store, "WORDS", words)
        left = store.decide(docs, gone, "left_anti")
        assert left.columns == docs.columns and sorted(x.doc_id for x in left.collect()) == want
        found = store.decide(docs, gone, "inner")
        assert found.columns == docs.columns and sorted(x.doc_id for x in found.collect()) == [i for i in range(400) if i % 3 == 0]


def test_tables_between_are_deleted(spark):
    mark = store.written(spark)
    store.materialize(spark.range(3), "between")
    last = store.materialize(spark.range(4), "last")
    store.drop_since(spark, mark)
    assert last.count() == 4 and store.written(spark) == mark + 1


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    sc = spark.sparkContext
    monkeypatch.setattr(sc, "master", "yarn")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(sc, "getConf", dict)  # a session without any setting
    monkeypatch.setattr(sc, "getCheckpointDir", lambda: None)
    with pytest.raises(ValueError):
        store.shared_dir(spark)
    monkeypatch.setattr(sc, "getCheckpointDir", lambda: "hdfs:///shared/")  # SparkContext.setCheckpointDir names it as well
    assert store.shared_dir(spark) == "hdfs:///shared"
