import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import payload, scorers
from larkspur.plans.plan import AnswerPlan


def test_embedding_unit_norm_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "!!! ..."), (3, "")],
                               "id long, t string")
    dense = scorers.embed_dense(df, "id", "t", 32).collect()
    assert [r["id"] for r in dense] == [1]  # no tokens -> no vector
    v = dense[0]["embedding"]
    assert len(v) == 32 and math.isclose(sum(x * x for x in v), 1.0, rel_tol=1e-12)


def test_overlap_scores_and_stable_rerank(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "blue sky"), (3, "red apple pie")],
                                 "doc_id long, content string")
    idf = scorers.idf_table(docs, "doc_id", "content")
    req = spark.createDataFrame([("r", "Red apple?")], "request_id string, query string")
    qw = scorers.query_token_weights(req, idf)
    cands = spark.createDataFrame([("r", 1, 3, "red apple pie"), ("r", 2, 2, "blue sky"),
                                   ("r", 3, 1, "red apple pie")],
                                  "request_id string, pos int, doc_id long, content string")
    ranked = scorers.rerank_topn(scorers.overlap_scores(cands, qw), None).orderBy("rank").collect()
    assert [r["doc_id"] for r in ranked] == [3, 1, 2]  # tie keeps input order
    assert ranked[0]["score"] == pytest.approx(1 / (1 + math.exp(-4.0)))
    assert 0 < ranked[2]["score"] < 0.5
    top1 = scorers.rerank_topn(scorers.overlap_scores(cands, qw), 1).count()
    assert top1 == 1


def test_extractive_answer(spark):
    ctx = spark.createDataFrame([("r", 1, "Nothing here. The red apple fell!"),
                                 ("r", 2, "Red apple and red apple.")],
                                "request_id string, rank int, content string")
    q = spark.createDataFrame([("r", "red apple")], "request_id string, query string")
    qt = scorers.distinct_tokens(q, ["request_id"], "query")
    a = scorers.extractive_answer(ctx, qt).first()
    assert a["generated_response"] == "The red apple fell!"


def test_sentiment_and_toxicity_models(spark):
    lex = spark.createDataFrame([("good", 1), ("bad", -1)], "w string, polarity int")
    df = spark.createDataFrame([("a", "good good good"), ("b", "bad"), ("c", "meh"), ("d", "")],
                               "id string, t string")
    got = {r["id"]: r["label"] for r in scorers.sentiment_label(df, "id", "t", lex).collect()}
    assert got == {"a": "5 stars", "b": "1 star", "c": "3 stars", "d": "3 stars"}
    lab = spark.createDataFrame([(1, "you idiot fool", 1), (2, "kind words", 0),
                                 (3, "idiot", 1), (4, "nice kind", 0)],
                                "doc_id long, text string, toxic int")
    m = scorers.train_token_logodds(lab)
    s = {r["id"]: r["toxicity"] for r in scorers.toxicity_scores(
        spark.createDataFrame([("x", "idiot"), ("y", "kind")], "id string, t string"),
        "id", "t", m).collect()}
    assert s["x"] > 0.5 > s["y"]


def test_scorer_registry(spark):
    def factory():
        return lambda pdf: pd.DataFrame({"id": pdf["id"], "n": pdf["t"].str.len()})

    scorers.register_scorer("length_test", factory, "id long, n long", aliases=("len_test",))
    try:
        with pytest.raises(ValueError):
            scorers.register_scorer("length_test", factory, "id long, n long")
        with pytest.raises(ValueError):
            scorers.register_scorer("other", factory, "id long, n long", aliases=("len_test",))
        with pytest.raises(KeyError):
            scorers.resolve_scorer("nope")
        df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, t string")
        got = {r["id"]: r["n"] for r in scorers.score_batches(df, "len_test").collect()}
        assert got == {1: 2, 2: 4}
    finally:
        scorers.unregister_scorer("length_test")


def test_pack_unpack_roundtrip_and_corrupt(spark):
    df = spark.createDataFrame(
        [("r", [(1, "t", "c", None, 0.5)], None)],
        "request_id string, docs array<struct<doc_id:long,title:string,content:string,"
        "category:string,score:double>>, compressed_docs string")
    packed = payload.apply_payload_mode(df.drop("compressed_docs"), "compressed")
    assert packed.first()["docs"] == [] and packed.first()["compressed_docs"]
    back = payload.restore_payload(packed).first()
    assert [(d["doc_id"], d["title"], d["content"], d["category"]) for d in back["docs"]] == [
        (1, "t", "c", None)]
    assert back["payload_error"] is False
    bad = df.withColumn("compressed_docs", F.lit("not-base64-zlib"))
    b = payload.restore_payload(bad).first()
    assert b["payload_error"] is True and b["docs"][0]["doc_id"] == 1
    ids = payload.apply_payload_mode(df.drop("compressed_docs"), "id_only").first()
    assert ids["docs"][0]["title"] == "" and ids["docs"][0]["content"] == ""
    s = df.select(payload.strip_missing_scores(F.col("docs")).alias("d")).first()["d"]
    assert s[0]["score"] == 1.0


def test_compression_stats(spark):
    df = spark.createDataFrame([("a", "xxxx", "xx"), ("a", "yy", "")], "k string, o string, c string")
    r = payload.compression_stats(df, "o", "c", ["k"]).first()
    assert (r["original_bytes"], r["compressed_bytes"], r["ratio"]) == (6, 2, 3.0)


def test_plan_validation():
    AnswerPlan().validate()
    with pytest.raises(ValueError):
        AnswerPlan(payload_mode="id_only", has_document_table=False).validate()
    with pytest.raises(ValueError):
        AnswerPlan(stages=("validate", "teleport")).validate()
    with pytest.raises(ValueError):
        AnswerPlan(stages=("validate", "validate")).validate()
    with pytest.raises(ValueError):
        AnswerPlan(rerank_passes=4).validate()
    assert not AnswerPlan(rerank_passes=0).runs("rerank")


def test_worker_finds_the_tokens_of_the_jvm(spark, tmp_path):
    """Every code point, between letters and between blanks."""
    import pandas as pd
    from larkspur.functions.text import tokens
    path = str(tmp_path / "chars.parquet")
    pd.DataFrame({"c": [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k <= 0xDFFF]}).to_parquet(
        path, row_group_size=100_000)
    x = F.concat(F.lit("A"), "c", F.lit("1 "), "c")
    rows = spark.read.parquet(path).select(tokens(x).alias("t"), scorers._shipped_column(x).alias("x"))

    def differ(batches):
        import pyarrow as pa
        for b in batches:
            t, x = (c.to_pylist() for c in b.columns)
            yield pa.record_batch([pa.array([w for w, y in zip(t, x)
                                             if [v.encode() for v in w] != scorers.shipped_tokens(y)],
                                            pa.list_(pa.string()))], names=["t"])
    assert rows.mapInArrow(differ, "t array<string>").collect() == []


def test_small_scan_is_dealt_to_all_cores(spark):
    from larkspur.sources import tables as T
    rows = spark.range(100, numPartitions=1)
    cores = spark.sparkContext.defaultParallelism
    assert T.spread(rows).rdd.getNumPartitions() == max(1, cores)
    assert T.spread(rows).count() == 100
    wide = spark.range(100, numPartitions=cores + 1)
    assert T.spread(wide) is wide


def test_packing_holds_one_text_at_a_time():
    """Of a batch of 200 texts of 1 MB only the packed ones are held at once."""
    import tracemalloc

    import pyarrow as pa
    from larkspur.operators import payload
    texts = pa.array(["x" * 1_000_000, None] * 200)
    tracemalloc.start()
    packed = payload._zlib_compress.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000 and packed.null_count == 200
    assert payload._zlib_decompress.func(packed.slice(0, 4)).equals(texts.slice(0, 4))
    assert payload._zlib_decompress.func(pa.array([b"no", None])).to_pylist() == [None, None]
