import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF
from larkspur import catalog
from larkspur.functions.bloom import BloomFilter
from larkspur.operators import fetch
from larkspur.sources import sinks, tables as T


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bloom_filter_lets_every_id_and_few_others_through(spark):
    ids = spark.range(0, 40_000, 2).select(F.when(F.col("id") % 1000 != 0, F.col("id")).alias("id"))
    chance = BloomFilter(ids, "id")
    got = spark.range(0, 200_000).where(chance.might_contain(F.col("id")))
    mine = {r.id for r in got.collect()}
    real = {r.id for r in ids.collect() if r.id is not None}
    assert real <= mine and len(mine - real) < 0.03 * 180_000
    assert not spark.createDataFrame([(None,)], "id long").where(chance.might_contain(F.col("id"))).count()
    assert BloomFilter(ids.limit(0), "id").flags == bytes(4096)


def test_unmatched_documents_stay_out_of_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(0, 50_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("content"))
        ids = spark.range(0, 50_000, 100).select(F.col("id").alias("doc_id"))
        out = fetch.docs_in_large_id_set(docs, ids)
        assert out.count() == 500
        plan = _plan(fetch.docs_in_large_id_set(docs, ids))
        left = plan[plan.index("SortMergeJoin" if "SortMergeJoin" in plan else "ShuffledHashJoin"):]
        # the filter stands between the shuffle and the scan of the documents
        assert left.index("Exchange") < left.index("getbit") < left.index("Range (0, 50000")
        chance = BloomFilter(ids, "doc_id")
        assert docs.where(chance.might_contain(F.col("doc_id"))).count() < 2500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_documents_are_not_shuffled(spark, tmp_path):
    table = "docs_" + tmp_path.name.replace("-", "_")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = sinks.write_documents_bucketed(T.scan_documents(spark, SF), str(tmp_path / "t"), table, 8)
        again = sinks.write_documents_bucketed(T.scan_documents(spark, SF).limit(1), str(tmp_path / "t"), table, 8)
        assert again.count() == docs.count() == T.scan_documents(spark, SF).count()
        rows = fetch.explode_ids(catalog._id_requests(spark, SF))
        plan = _plan(fetch.fetch_rows(rows, docs.hint("merge")))
        assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 8 out of 8" in plan
        got = catalog._fetched(fetch.fetch_bucketed(catalog._id_requests(spark, SF), docs))
        want = E.queries()["fetch_documents"](spark, SF)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_side_of_a_stage_decides_what_it_reads(spark):
    """Sentiment at the gateway reads what the generation side has masked."""
    from larkspur.constants import TOXIC_MASK
    from larkspur.operators import label_models as L
    from larkspur.plans import answer, plan as P
    lab = spark.createDataFrame([(k, t, q, x) for k, (t, q, x) in enumerate(
        [("vile awful", 1, 1), ("content filtered due", 0, 0), ("kind words", 0, 0)] * 40)],
        "doc_id long, text string, quality int, toxic int")
    models = answer.AnswerModels(None, None, L.fit_labels(lab, ("quality", "toxic")))
    ans = spark.createDataFrame([("a", "vile awful", None, None), ("b", "kind words", None, None),
                                 ("c", "vile awful", "given", "false")],
                                "request_id string, generated_response string, sentiment string, is_toxic string")
    out = {}
    for name, kw in {"late": {"sentiment_at": "gateway"}, "same": {}, "both": {"sentiment_at": "gateway",
                                                                              "toxicity_at": "gateway"}}.items():
        plan = P.AnswerPlan(**kw).validate()
        df = ans
        for side in P.SIDES:
            if plan.judged_at(side):
                df = answer.judge(df, plan.judged_at(side), models, plan)
        out[name] = {r.request_id: (r.generated_response, r.sentiment, r.is_toxic) for r in df.collect()}
    assert out["same"]["a"] == (TOXIC_MASK, "very positive", "true") == out["both"]["a"]
    assert out["late"]["a"] == (TOXIC_MASK, "very negative", "true")
    assert all(o["b"] == ("kind words", "very negative", "false") for o in out.values())
    assert all(o["c"] == ("vile awful", "given", "false") for o in out.values())       # judged already


def test_rerank_passes_keep_what_they_name():
    from larkspur.plans.plan import AnswerPlan
    assert AnswerPlan(rerank_passes=3, rerank_top_n=2).kept_per_pass() == (None, None, 2)
    assert AnswerPlan(rerank_passes=2, rerank_top_n=(7, 5)).validate().kept_per_pass() == (7, 5)
    assert AnswerPlan(rerank_passes=0).kept_per_pass() == ()
    for bad in ({"rerank_passes": 2, "rerank_top_n": (7,)}, {"sentiment_at": "nowhere"}):
        with pytest.raises(ValueError):
            AnswerPlan(**bad).validate()
