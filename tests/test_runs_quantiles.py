import random
import statistics

import pytest

from larkspur.functions.quantiles import rank_select
from larkspur.operators import runs


def _py_summary(rows):
    ok = [r for r in rows if r[2]]
    ts = [r[1] for r in rows]
    if not ok:
        return dict(total_requests=len(rows), successful=0, failed=len(rows), success_rate=0.0,
                    throughput_req_per_min=0.0, latency_avg_ms=0.0, latency_p50_ms=0.0,
                    latency_p95_ms=0.0, latency_p99_ms=0.0, latency_min_ms=0.0,
                    latency_max_ms=0.0)
    lat = [r[3] for r in ok]
    span = (max(ts) - min(ts)) / 60.0 if max(ts) > min(ts) else 1.0 / 60.0
    return dict(total_requests=len(rows), successful=len(ok), failed=len(rows) - len(ok),
                success_rate=len(ok) / len(rows) * 100, throughput_req_per_min=len(ok) / span,
                latency_avg_ms=statistics.mean(lat), latency_p50_ms=statistics.median(lat),
                latency_p95_ms=statistics.quantiles(lat, n=20)[18],
                latency_p99_ms=statistics.quantiles(lat, n=100)[98],
                latency_min_ms=min(lat), latency_max_ms=max(lat))


def test_latency_summary_matches_python(spark):
    rnd = random.Random(5)
    rows = []
    sizes = {"big": 400, "one": 1, "two": 2, "five": 5, "fail": 4, "same_ts": 3}
    for run, n in sizes.items():
        for i in range(n):
            ok = run != "fail" and rnd.random() > 0.1 or (run in ("one", "two", "five", "same_ts"))
            ts = 1000.0 if run == "same_ts" else 1000.0 + rnd.random() * 500
            rows.append((run, ts, ok, round(rnd.random() * 100, 2)))
    df = spark.createDataFrame(rows, "run string, timestamp double, success boolean, latency_ms double")
    got = {r["run"]: r.asDict() for r in runs.latency_summary(df, ["run"]).collect()}
    for run in sizes:
        exp = _py_summary([r for r in rows if r[0] == run])
        for k, v in exp.items():
            assert got[run][k] == pytest.approx(v, rel=1e-9, abs=1e-9), (run, k)


def test_exclusive_quantile_known_values(spark):
    df = spark.createDataFrame([("g", 1000.0, True, float(v)) for v in [3, 1, 10, 7, 2]],
                               "run string, timestamp double, success boolean, latency_ms double")
    r = runs.latency_summary(df, ["run"]).first()
    assert r["latency_p95_ms"] == pytest.approx(12.1)
    assert r["latency_p99_ms"] == pytest.approx(12.82)


def test_rank_select_hot_group_spans_partitions(spark):
    rows = [("hot", float(i)) for i in range(3000)] + [("cold", float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = spark.createDataFrame([("hot", 1), ("hot", 1500), ("hot", 3000), ("cold", 4)],
                                   "g string, r long")
    got = {(r["g"], r["r"]): r["v"] for r in rank_select(df, ["g"], "v", wanted, 16).collect()}
    assert got == {("hot", 1): 0.0, ("hot", 1500): 1499.0, ("hot", 3000): 2999.0,
                   ("cold", 4): 3.0}


def test_consolidate_sort_unpivot(spark):
    s = spark.createDataFrame([("r1", 10.0, 1.0, 2.0, 100.0), ("r2", 30.0, 3.0, 4.0, 90.0),
                               ("r3", 20.0, 5.0, 6.0, 80.0)],
                              "full_run_id string, throughput_req_per_min double, "
                              "latency_p50_ms double, latency_p95_ms double, success_rate double")
    m = spark.createDataFrame([("r1", None, "n", 4), ("r2", "exp2", "n", 8)],
                              "full_run_id string, run_id string, notes string, batch_size int")
    rss = spark.createDataFrame([("r2", 1048576)], "full_run_id string, rss long")
    c = runs.consolidate_runs(s, m, runs.total_rss_mb(rss))
    got = {r["run_id"]: r["total_rss_mb"] for r in c.collect()}
    assert got == {"r1": None, "exp2": 1.0}  # r3 has no manifest
    assert [r["run_id"] for r in runs.top_throughput(c, 1).collect()] == ["exp2"]
    u = runs.unpivot_percentiles(c, ["run_id"]).collect()
    assert sorted((r["run_id"], r["percentile"], r["latency"]) for r in u) == [
        ("exp2", "P50", 3.0), ("exp2", "P95", 4.0), ("r1", "P50", 1.0), ("r1", "P95", 2.0)]
    both = runs.append_runs(c.select("run_id"), c.select("run_id", "notes"))
    assert both.count() == 4 and "notes" in both.columns


def test_client_summary(spark):
    sent = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 2.0)], "request_id string, ts double")
    res = spark.createDataFrame([("a", True, 5.0), ("b", False, 6.0)],
                                "request_id string, success boolean, finished_ts double")
    r = runs.client_summary(sent, res).first()
    assert (r["sent"], r["successful"], r["failed"], r["pending"], r["elapsed_s"]) == (3, 1, 1, 1, 6.0)


def test_shared_value_is_one_row_per_partition(spark):
    """Nine rows in ten share a value: it is counted, not moved row by row."""
    n = 20_000
    df = spark.range(n).selectExpr("'run' AS run", "CASE WHEN id % 10 < 9 THEN 30000.0 ELSE id * 1.0 END AS v")
    values = sorted(r.v for r in df.collect())
    ranks = [1, 500, 1500, 10_000, n]
    wanted = spark.createDataFrame([("run", r) for r in ranks], "run string, r long")
    got = {r.r: r.v for r in rank_select(df, ["run"], "v", wanted, partitions=8).collect()}
    assert got == {r: values[r - 1] for r in ranks}


def test_ranks_near_shares_of_large_and_small_groups(spark):
    """A hot group beyond SMALL_GROUP (bounds from the sketch), ties, and small groups."""
    import numpy as np
    from pyspark.sql import functions as F
    from larkspur.functions import quantiles as Q
    rng = np.random.default_rng(4)
    hot = np.round(rng.lognormal(3, 2, 160_000), 2)
    hot[:30_000] = 7.25                                  # one value is a fifth of the group
    groups = {"hot": hot, "flat": np.full(70_000, 3.0), "few": rng.random(9), "one": np.array([5.0])}
    df = None
    for name, values in groups.items():
        part = spark.createDataFrame(__import__("pandas").DataFrame({"v": values})).withColumn("run", F.lit(name))
        df = part if df is None else df.unionByName(part)
    ranks = {name: sorted({min(len(x), max(1, int(p * (len(x) + 1)) + d)) for p in (0.5, 0.95, 0.99) for d in (0, 1)})
             for name, x in groups.items()}
    wanted = spark.createDataFrame(list(ranks.items()), "run string, ranks array<long>")
    out = Q.ranks_near(df, ["run"], "v", wanted, (0.5, 0.95, 0.99))
    got = {(r.run, r.r): r.v for r in out.collect()}
    assert got == {(name, r): float(np.sort(x)[r - 1]) for name, x in groups.items() for r in ranks[name]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and "RDDScan" not in plan      # no range shuffle, no checkpoint
    far = spark.createDataFrame([("hot", [40_000])], "run string, ranks array<long>")
    with pytest.raises(Exception, match="outside the bounds"):
        Q.ranks_near(df, ["run"], "v", far, (0.5, 0.95, 0.99)).collect()
