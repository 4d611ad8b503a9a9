import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality as Q

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_query_on_held_out_labels(spark):
    rows = Q.query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    y = np.array([label[r.doc_id] for r in held])
    score = np.array([r.score for r in held])
    print("held-out AUC", auc(score, y), "good kept", (score[y == 1] >= 0.3).mean(),
          "bad dropped", (score[y == 0] < 0.3).mean())
    assert auc(score, y) > 0.95
    assert (score[y == 1] >= 0.3).mean() > 0.98


def test_columns_equal_arrays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = Q.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = Q.with_statistics(docs).withColumn("score", model.score("stats")).collect()
    want = model.predict(np.array([r.stats for r in rows]))
    assert np.allclose([r.score for r in rows], want)
    assert all(np.allclose(r.stats, Q.statistics(r.text)) for r in rows)
    assert model.describe() and 0 < len(model.rules)


def test_rules_recover_a_planted_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(Q.FEATURES)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.4)).astype(float)
    model = Q.fit_arrays(x[:3000], y[:3000])
    assert ((model.predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_edge_rows(spark):
    rows = [(1, None, 5.0), (2, "", 5.0), (3, "x " * 200_000, 5.0), (4, "Fine text here.", 5.0),
            (4, "Fine text here.", 5.0), (None, "no id", 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_stats double")
    labels = spark.createDataFrame([(4, 1), (4, 1), (3, 0), (1, None), (None, 1), (99, 0)],
                                   "doc_id long, quality int")
    model = Q.fit(docs, labels)
    kept = Q.keep_good(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    empty = Q.fit(docs, labels.limit(0))
    assert {r.s for r in Q.with_statistics(docs).select(empty.score("stats").alias("s")).collect()} == {0.5}
    one = Q.fit(docs, labels.where("quality = 1"))
    assert Q.with_statistics(docs).select(one.score("stats").alias("s")).where("s > 0.5").count() == 6
    assert Q.keep_good(docs.limit(0), model).count() == 0
    assert docs.select(Q.is_held_out(F.col("doc_id")).alias("h")).where("h is null").count() == 0
