import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from larkspur.operators import telemetry
from larkspur.sources import files, generators, sinks


def test_histogram_cumulative(spark):
    df = spark.createDataFrame([("a", v) for v in [0.005, 0.05, 0.2, 3.0, 100.0]], "k string, v double")
    rows = {r["le"]: r["cumulative_count"] for r in
            telemetry.histogram_buckets(df, ["k"], "v", [0.01, 0.1, 1.0]).collect()}
    assert rows == {"0.01": 1, "0.1": 2, "1.0": 3, "+Inf": 5}


def test_counters_gauges_rates(spark):
    df = spark.createDataFrame([("a", 1, 1, 2.0), ("a", 2, 2, 5.0), ("a", 2, 3, 7.0), ("b", 1, 4, 1.0)],
                               "k string, t long, id long, v double")
    g = {r["k"]: r["last_value"] for r in telemetry.latest_gauge(df, ["k"], "v", ["t", "id"]).collect()}
    assert g == {"a": 7.0, "b": 1.0}
    c = {r["k"]: (r["total"], r["amount_total"]) for r in
         telemetry.labelled_counters(df, ["k"], "v").collect()}
    assert c == {"a": (3, 14.0), "b": (1, 1.0)}
    samples = spark.createDataFrame(
        [("s", 0, 10.0), ("s", 10, 15.0), ("s", 20, 3.0), ("s", 25, 8.0)],
        "k string, sec long, v double").withColumn("ts", F.timestamp_seconds("sec"))
    r = {x["window_start"]: x["rate"] for x in telemetry.counter_rate(
        samples, ["k"], "ts", "v", "30 seconds", "30 seconds", 30, ["sec"]).collect()}
    # deltas: 5 (10->15), reset -> 3, 5 (3->8); first sample of the window adds nothing
    assert r[0] == pytest.approx(13 / 30)


def test_sample_profiles(spark):
    df = spark.range(2000).withColumnRenamed("id", "request_id")
    assert telemetry.sample_profiles(df, 0.0).count() == 0
    assert telemetry.sample_profiles(df, 5.0).count() == 2000
    n = telemetry.sample_profiles(df, 0.25).count()
    assert 350 < n < 650
    assert telemetry.sample_profiles(df, 0.25).count() == n  # reproducible


def test_stage_profile_summary(spark):
    df = spark.createDataFrame([("r", "embed", 1, 10.0, 1.0, 5.0), ("r", "search", 2, 5.0, -2.0, 7.0)],
                               "request_id string, stage_name string, seq int, duration_ms double, "
                               "memory_delta_mb double, peak_memory_mb double")
    r = telemetry.stage_profile_summary(df, with_stages=True, order="seq").first()
    assert (r["total_duration_ms"], r["peak_memory_mb"], r["total_memory_delta_mb"],
            r["stage_count"]) == (15.0, 7.0, -1.0, 2)
    assert [s["stage_name"] for s in r["stages"]] == ["embed", "search"]
    reqs = spark.createDataFrame([("r",), ("idle",)], "request_id string")
    got = {x["request_id"]: x for x in telemetry.stage_profile_summary(
        df, with_stages=True, order="seq", requests=reqs).collect()}
    e = got["idle"]
    assert (e["total_duration_ms"], e["peak_memory_mb"], e["total_memory_delta_mb"],
            e["stage_count"], e["stages"]) == (0.0, 0.0, 0.0, 0, [])


def test_flatten_metric_matrix(spark):
    d = tempfile.mkdtemp(prefix="larkspur-test-")
    path = os.path.join(d, "m.json")
    with open(path, "w") as f:
        f.write(json.dumps({"metric": {"__name__": "requests_total", "node": "0"},
                            "values": [[1700000000.5, "3"], [1700000005, "4"]]}) + "\n")
        f.write(json.dumps({"metric": {"__name__": "requests_total", "service": "gw"},
                            "values": [[1700000000, "1"]]}) + "\n")
    m = files.read_metric_matrix(spark, path)
    rows = files.flatten_metric_matrix(m, "run1", "service").orderBy("_ts", "node").collect()
    assert [(r["node"], r["service"], r["stage"], r["value"]) for r in rows] == [
        ("unknown", "gw", "", 1.0), ("0", "unknown", "", 3.0), ("0", "unknown", "", 4.0)]
    assert rows[1]["timestamp"] == "2023-11-14T22:13:20.500000"
    out = os.path.join(d, "metrics_csv")
    sinks.write_metrics_csv(files.flatten_metric_matrix(m, "run1", "stage"), out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == sinks.METRIC_COLUMNS and back.count() == 3


def test_run_summaries_and_process_stats(spark):
    d = tempfile.mkdtemp(prefix="larkspur-test-")
    for run in ("runA", "runB"):
        os.makedirs(os.path.join(d, run, "profile_data"))
    with open(os.path.join(d, "runA", "profile_data", "summary.csv"), "w") as f:
        f.write("total_requests,successful,failed,success_rate,throughput_req_per_min,"
                "latency_avg_ms,latency_p50_ms,latency_p95_ms,latency_p99_ms,latency_min_ms,"
                "latency_max_ms,batch_size\n10,9,1,90.0,5.0,1,1,2,3,0.5,4,8\n")
    s = files.read_run_summaries(spark, f"{d}/*/profile_data/summary.csv")
    assert [(r["full_run_id"], r["batch_size"]) for r in s.collect()] == [("runA", 8)]  # runB skipped
    with open(os.path.join(d, "runA", "process_stats.json"), "w") as f:
        json.dump([{"pid": 1, "name": "a", "cmdline": ["x"], "cpu_percent": 1.0,
                    "memory_info": {"rss": 1048576, "vms": 1}},
                   {"pid": 2, "name": "b", "cmdline": [], "cpu_percent": 0.0,
                    "memory_info": {"rss": 2097152, "vms": 1}}], f)
    p = files.read_process_stats(spark, os.path.join(d, "runA", "process_stats.json"))
    assert sorted(r["rss"] for r in p.collect()) == [1048576, 2097152]
    empty = spark.createDataFrame([], "a int")
    assert sinks.write_summary_csv(empty, os.path.join(d, "none")) is False
    assert not os.path.exists(os.path.join(d, "none"))


def test_envelope_roundtrip(spark):
    env = spark.createDataFrame([(7, [("r1", "q1"), ("r2", "q2")])], files.ENVELOPE)
    items = files.explode_batch_envelope(env)
    assert [(r["pos"], r["request_id"]) for r in items.collect()] == [(0, "r1"), (1, "r2")]
    back = files.collect_batch_envelope(items, ["request_id", "query"]).first()
    assert back["batch_id"] == 7 and [i["request_id"] for i in back["items"]] == ["r1", "r2"]


def test_generators(spark):
    c = generators.generate_corpus(spark, 5).orderBy("doc_id").collect()
    assert c[1]["title"] == "Document 1" and c[1]["category"] == "billing"
    assert c[1]["content"] == ("This is the content of document 1. It contains information "
                               "about customer support issue 1.")
    v1 = generators.vectors_from_ids(spark.range(3).withColumnRenamed("id", "doc_id"), 16)
    v2 = generators.vectors_from_ids(spark.range(3).withColumnRenamed("id", "doc_id").repartition(3), 16)
    a = {r[0]: r[1] for r in v1.collect()}
    b = {r[0]: r[1] for r in v2.collect()}
    assert a == b and len(a[0]) == 16
    arrivals = spark.range(5)
    qs = generators.number_list(spark.createDataFrame([(1, "x"), (2, "y")], "item_id int, query string"),
                                "item_id")
    got = sorted((r["id"], r["query"]) for r in generators.generate_requests(arrivals, qs).collect())
    assert got == [(0, "x"), (1, "y"), (2, "x"), (3, "y"), (4, "x")]


def test_request_readers(spark):
    from larkspur.operators import validate
    d = tempfile.mkdtemp(prefix="larkspur-test-")
    with open(os.path.join(d, "r.json"), "w") as f:
        f.write('{"request_id": "a", "query": "hi"}\n{"request_id": "b", "query": ""}\n'
                '{"query": "no id"}\n')
    got = {(r["request_id"], r["ok"]) for r in
           validate.validate_requests(files.read_requests(spark, d)).collect()}
    assert got == {("a", True), ("b", False), (None, False)}
    s = files.request_stream(spark, d)
    q = s.writeStream.format("memory").queryName("req_probe").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT count(*) FROM req_probe").first()[0] == 3


def test_lag_scan_hot_key(spark):
    from larkspur.operators.sequence import lag_scan
    rows = [("hot", i, float(i * 3 % 17)) for i in range(1200)] + [("c", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(r["k"], r["t"]): r["prev"] for r in lag_scan(df, ["k"], ["t"], "v", partitions=12).collect()}
    for k, t, v in rows:
        exp = None if t == 0 else next(x for kk, tt, x in rows if kk == k and tt == t - 1)
        assert got[(k, t)] == exp


def test_rate_from_increments_equals_rate_of_running_sum(spark):
    from pyspark.sql import Window
    rows = [("a", s, i, float((i * 7) % 5 + 1)) for i, s in enumerate(range(0, 600, 13))] + \
           [("b", s, 1000 + i, 2.0) for i, s in enumerate(range(5, 400, 29))]
    df = (spark.createDataFrame(rows, "k string, sec long, id long, inc double")
          .withColumn("ts", F.timestamp_seconds("sec")))
    w = Window.partitionBy("k").orderBy("sec", "id").rowsBetween(Window.unboundedPreceding, 0)
    readings = df.withColumn("v", F.sum("inc").over(w))
    a = {(r["k"], r["window_start"]): round(r["rate"], 9) for r in
         telemetry.counter_rate_from_increments(df, ["k"], "ts", "inc", ["sec", "id"],
                                                "120 seconds", "60 seconds", 120).collect()}
    b = {(r["k"], r["window_start"]): round(r["rate"], 9) for r in
         telemetry.counter_rate(readings, ["k"], "ts", "v", "120 seconds", "60 seconds", 120,
                                ["sec", "id"]).collect()}
    assert a == b and len(a) > 5
