from larkspur.functions.text import (normalise_query, text_fingerprint, token_sort_key,
                                     tokens, truncate_text)
from larkspur.operators import postprocess, validate


def test_normalise_and_keys(spark):
    df = spark.createDataFrame([("  Hello\tWORLD \n again ",), ("",), (None,)], "q string")
    rows = df.select(normalise_query("q").alias("n"),
                     token_sort_key(normalise_query("q")).alias("k"),
                     text_fingerprint("q").alias("h")).collect()
    assert rows[0]["n"] == "hello world again"
    assert rows[0]["k"] == "again hello world"
    import hashlib
    assert rows[0]["h"] == hashlib.sha256("Hello\tWORLD \n again".encode()).hexdigest()
    assert rows[1]["n"] == ""
    assert rows[2]["n"] is None


def test_truncate_counts_characters(spark):
    df = spark.createDataFrame([("é" * 600,), (None,), ("abc",)], "t string")
    out = [r[0] for r in df.select(truncate_text("t", 512)).collect()]
    assert out == ["é" * 512, "", "abc"]


def test_tokens_letters_digits(spark):
    df = spark.createDataFrame([("Héllo, Wörld 42-x!",)], "t string")
    assert df.select(tokens("t")).first()[0] == ["héllo", "wörld", "42", "x"]


def test_validate_requests(spark):
    df = spark.createDataFrame([("a", "q"), ("", "q"), ("b", ""), ("c", "   "), (None, "q"),
                                ("d", None)], "request_id string, query string")
    out = {(r["request_id"], r["ok"], r["reason"])
           for r in validate.validate_requests(df).collect()}
    assert ("a", True, None) in out
    assert ("", False, "empty request_id") in out
    assert ("b", False, "empty query") in out
    assert ("c", True, None) in out  # whitespace-only passes a min-length rule
    assert (None, False, "empty request_id") in out
    assert ("d", False, "missing query") in out


def test_validate_vectors(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, None), (3, [0.1])], "id int, embedding array<float>")
    got = {r["id"]: r["vector_error"] for r in validate.validate_vectors(df, 2).collect()}
    assert got[1] is None and got[2] == "Missing embedding in batch"
    assert got[3].startswith("Embedding dimension mismatch")


def test_non_empty_batch(spark):
    df = spark.createDataFrame([(1, [("r", "q")]), (2, [])],
                               "batch_id long, items array<struct<request_id:string,query:string>>")
    ok, bad = validate.non_empty_batch(df)
    assert [r[0] for r in ok.collect()] == [1] and [r[0] for r in bad.collect()] == [2]


def test_sentiment_toxicity_postprocess(spark):
    df = spark.createDataFrame([("1 star", 0.3), ("2 stars", 0.8), ("5 stars", 0.5),
                                ("bogus", None)], "label string, score double")
    rows = df.select(postprocess.map_sentiment("label").alias("s"),
                     postprocess.flag_toxic("score").alias("t")).collect()
    assert [r["s"] for r in rows] == ["very negative", "negative", "very positive", "neutral"]
    assert [r["t"] for r in rows] == ["false", "true", "false", None]
    d = spark.createDataFrame([("x", "", None), ("y", "positive", "true")],
                              "generated_response string, sentiment string, is_toxic string")
    d = postprocess.default_answer(d.withColumn("generated_response", postprocess.mask_toxic(
        "generated_response", "is_toxic")))
    got = {r[0]: (r[1], r[2]) for r in d.collect()}
    assert got["x"] == ("neutral", "false")
    assert got["[Content Filtered due to toxicity]"] == ("positive", "true")


def test_build_prompt(spark):
    df = spark.createDataFrame([("why?", [("T1", "c" * 300), ("T2", "d"), ("T3", "e"), ("T4", "f")])],
                               "query string, docs array<struct<title:string,content:string>>")
    p = df.select(postprocess.build_prompt("query", "docs").alias("p")).first()["p"]
    assert p[0]["role"] == "system" and p[1]["role"] == "user"
    assert p[1]["content"] == ("Context:\n- T1: " + "c" * 200 + "\n- T2: d\n- T3: e"
                               "\n\nQuestion: why?\n\nAnswer:")
