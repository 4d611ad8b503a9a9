"""Physical-plan properties the operators are designed for."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF
from larkspur.operators import fetch, knn
from larkspur.sources import tables as T


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_knn_has_partial_topk_and_no_cross_product(spark):
    e = T.scan_vectors(spark, SF)
    p = _plan(knn.knn_exact(e.withColumnRenamed("vec_id", "query_id"), e, k=10))
    assert "WindowGroupLimit" in p          # partial top-k before the shuffle
    assert "MapInArrow" in p and "Coalesce" not in p    # corpus streamed, not shuffled, by any number of tasks
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_bounded_id_side_is_broadcast(spark):
    docs = T.scan_documents(spark, SF)
    ids = spark.createDataFrame([("r", 1, 3)], "request_id string, pos int, doc_id long")
    p = _plan(fetch.fetch_rows(ids, docs, 512, small_id_side=True))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_scans_are_pruned_and_filters_pushed(spark):
    p = _plan(E.queries()["scan_documents"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    p = _plan(E.queries()["validate_requests"](spark, SF))
    assert "EqualTo(role,user)" in p


def test_aggregates_combine_map_side(spark):
    p = _plan(E.queries()["histogram_buckets"](spark, SF))
    assert p.count("HashAggregate") >= 2    # partial + final


def test_embedding_needs_no_shuffle(spark):
    assert "Exchange" not in _plan(E.queries()["embed_text"](spark, SF))


def test_unprobed_cells_are_not_shuffled(spark):
    e = T.scan_vectors(spark, SF).select("vec_id", "embedding")
    assigned = e.withColumn("cell", F.pmod("vec_id", F.lit(16)).cast("int"))
    centroids = assigned.where("vec_id < 16").select("cell", F.col("embedding").cast("array<double>").alias("center"))
    q = e.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    p = _plan(knn.knn_ivf(q, assigned, centroids, nprobe=2, k=5))
    assert "LeftSemi" in p
