import zlib

import numpy as np
from pyspark.sql import functions as F

from carequeue.llm import toxicity
from tests.conftest import SMALL

SCHEMA = "doc_id bigint, text string"


def test_held_out_documents_are_told_apart(spark):
    folder = SMALL.replace("0.001", "0.1")
    found = toxicity.op7_toxicity(spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    told = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    toxic = np.array([r.score for r in told if r.toxic == 1])
    other = np.array([r.score for r in told if r.toxic == 0])
    assert min(len(toxic), len(other)) > 50
    # These small tables have toxic labels on texts without any sign of it.
    assert np.mean(toxic >= 0.3) >= 0.9 and np.mean(other >= 0.3) <= 0.05
    assert np.mean(toxic[:, None] > other[None, :]) >= 0.9


def test_risk_estimator_finds_the_feature_of_the_positives():
    draw = np.random.default_rng(0)
    toxic = [np.unique(np.append(draw.integers(100, 400, 20), 7)).astype(np.int32) for _ in range(300)]
    other = [np.unique(draw.integers(100, 400, 20)).astype(np.int32) for _ in range(1800)]
    model = toxicity.fit(toxic[:100], other + toxic[100:], 0.1)
    assert model.weights[7] > 3
    assert 1 / (1 + np.exp(-model.bias)) < 0.1 < 0.7 < 1 / (1 + np.exp(-model.bias - model.weights[7]))


def test_held_out_rows_and_odd_rows(spark):
    rows = [(i, "awful nasty words here" if i % 5 == 0 else "kind friendly words here") for i in range(400)]
    odd = [(1000, None), (1001, ""), (None, "awful nasty"), (None, "awful nasty"), (1002, "nasty " * 100_000)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumn("toxic", F.lit(5)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame(
        [(i, 1 if i % 5 == 0 else 0) for i in range(400)] + [(None, 1), (5, None), (9999, 1)], "doc_id bigint, toxic int"
    )
    found = toxicity.score_toxicity(docs, labels).collect()
    assert len(found) == len(rows) + len(odd)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[1000] == by[1001] and by[1000][0] < 0.3
    assert len(by[None]) == 2 and min(by[None] + by[1002] + by[0]) >= 0.3 > by[1][0]
    # Labels of held-out rows change nothing.
    kept = labels.where(~toxicity.held_out())
    assert sorted(r.score for r in toxicity.score_toxicity(docs, kept).collect()) == sorted(r.score for r in found)


def test_without_examples(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.score_toxicity(docs, labels).collect()] == [0, 0]
    assert toxicity.score_toxicity(docs.limit(0), labels).collect() == []
