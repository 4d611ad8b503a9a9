import __spark_entry__ as E
from conftest import SF


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"request_id", "generated_response", "sentiment", "is_toxic"}
    n = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert len(rows) == n
    assert {r["is_toxic"] for r in rows} <= {"true", "false"}
    assert {r["sentiment"] for r in rows} <= {"very negative", "negative", "neutral", "positive",
                                              "very positive"}


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    numbered = {k for k in q if k.startswith("op") and k[2:3].isdigit()}
    assert numbered == (set(E.llm.registry()[0]) if E.llm else set())


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stream_twins_equal_batch(spark):
    q = E.queries()
    cols = ["user_id", "event_type", "event_id", "hit"]
    assert _rows(q["stream_reuse_within_ttl"](spark, SF), cols) == \
        _rows(q["reuse_within_ttl"](spark, SF), cols)
    cols = ["user_id", "event_id", "avg_depth", "delay"]
    assert _rows(q["stream_adaptive_delay"](spark, SF), cols) == \
        _rows(q["adaptive_delay"](spark, SF), cols)
    batch = {r["event_id"]: (r["batch_no"], r["pos"], r["reason"])
             for r in q["assign_batches"](spark, SF).collect()}
    stream = {r["event_id"]: (r["batch_no"], r["pos"], r["reason"])
              for r in q["stream_batches"](spark, SF).collect()}
    # every emitted row equals the batch twin except that a timer flush of the
    # last batch is "timeout" where the table flushes it as "shutdown"
    for k, v in stream.items():
        b = batch[k]
        assert v[:2] == b[:2] and (v[2] == b[2] or (v[2], b[2]) == ("timeout", "shutdown"))


def test_stream_answer_equals_batch(spark):
    q = E.queries()
    cols = ["request_id", "generated_response", "sentiment", "is_toxic"]
    assert _rows(q["stream_answer"](spark, SF), cols) == _rows(q["answer_requests"](spark, SF), cols)


def test_payload_modes_give_same_answers(spark):
    from larkspur import catalog
    from larkspur.plans.answer import answer_requests
    from larkspur.plans.plan import AnswerPlan
    from larkspur.sources import tables as T
    docs, models = catalog._answer_models(spark, SF, AnswerPlan())
    req = T.requests_from_benchmark(spark, SF)
    cols = ["request_id", "generated_response", "sentiment", "is_toxic"]
    res = {}
    for mode in ("full", "compressed", "id_only"):
        a, _ = answer_requests(req, docs, models, AnswerPlan(payload_mode=mode))
        res[mode] = _rows(a, cols)
    assert res["full"] == res["compressed"] == res["id_only"]


def test_saved_models_answer_the_same(spark):
    from larkspur import catalog
    from larkspur.plans.answer import answer_requests, load_models, save_models
    from larkspur.plans.plan import AnswerPlan
    from larkspur.session import shared_dir
    from larkspur.sources import tables as T
    docs, models = catalog._answer_models(spark, SF, AnswerPlan())
    path = shared_dir(spark, "models")
    save_models(models, path)
    req = T.requests_from_benchmark(spark, SF)
    cols = ["request_id", "generated_response", "sentiment", "is_toxic"]
    a, _ = answer_requests(req, docs, models)
    b, _ = answer_requests(req, docs, load_models(spark, path))
    assert _rows(a, cols) == _rows(b, cols)


def test_ivf_plan_with_full_probe_answers_like_exact(spark):
    from larkspur import catalog
    from larkspur.plans.answer import answer_requests, fit_models
    from larkspur.plans.plan import AnswerPlan
    from larkspur.sources import tables as T
    docs, models = catalog._answer_models(spark, SF, AnswerPlan())
    labelled = catalog._labelled(spark, SF)
    ivf_plan = AnswerPlan(search="ivf", nlist=4, nprobe=4)
    ivf_models = fit_models(docs, labelled, ivf_plan)
    req = T.requests_from_benchmark(spark, SF)
    cols = ["request_id", "generated_response", "sentiment", "is_toxic"]
    a, _ = answer_requests(req, docs, models)
    b, _ = answer_requests(req, docs, ivf_models, ivf_plan)
    assert _rows(a, cols) == _rows(b, cols)


def test_queries_run_from_another_directory():
    """Workers import larkspur from the shipped zip, not from the working dir."""
    import os
    import subprocess
    import sys
    import tempfile
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false')"
        ".getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', E.queries()['knn_exact'](s, %r).count())\n" % (repo, SF))
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="larkspur-"),
                         capture_output=True, text=True, timeout=600)
    rows = [int(x.split()[1]) for x in out.stdout.splitlines() if x.startswith("ROWS ")]
    assert rows and rows[0] > 0, out.stderr[-2000:]
    assert "ModuleNotFoundError" not in out.stderr
