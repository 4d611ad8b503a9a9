"""Request-log and run analytics.

All runs are summarised in one job (no per-run loop).  Plain statistics are
partial/final hash aggregates; the percentiles use ``ranks_near``, which counts
a run's values with map-side combine and moves only those near the wanted ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.quantiles import exclusive_quantile_ranks, ranks_near

SUMMARY_COLUMNS = [
    "total_requests", "successful", "failed", "success_rate", "throughput_req_per_min",
    "latency_avg_ms", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms",
    "latency_min_ms", "latency_max_ms",
]


def latency_summary(log: DataFrame, keys: list[str] | tuple[str, ...] = ("run",),
                    success: str = "success", latency: str = "latency_ms",
                    timestamp: str = "timestamp") -> DataFrame:
    """A1-A3 per group of a request log.

    Latency statistics cover successful rows only and are all 0.0 when none
    succeeded; p50 is the median, p95/p99 are exclusive-method cut points 19
    of 20 and 99 of 100.  Throughput = successful / minutes between the first
    and last *submit* timestamp of all rows (1/60 min when they coincide).
    """
    keys = list(keys)
    ok = F.col(success)
    lat = F.when(ok, F.col(latency))
    g = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(ok).alias("successful"),
        F.min(timestamp).alias("_t0"), F.max(timestamp).alias("_t1"),
        F.avg(lat).alias("_avg"), F.min(lat).alias("_min"), F.max(lat).alias("_max"),
    )
    L = F.col("successful")
    j95, d95 = exclusive_quantile_ranks(L, 20, 19)
    j99, d99 = exclusive_quantile_ranks(L, 100, 99)
    g = g.select(
        "*",
        F.floor((L + 1) / 2).cast("long").alias("_m1"),
        (F.floor(L / 2) + 1).cast("long").alias("_m2"),
        j95.alias("_j95"), d95.alias("_d95"), j99.alias("_j99"), d99.alias("_d99"),
    )
    rank_cols = ["_m1", "_m2", "_j95", "_j99"]
    wanted = g.where(L > 0).select(*keys, F.array_distinct(F.array(
        *[F.least(F.col(c), L) for c in rank_cols],
        *[F.least(F.col(c) + 1, L) for c in ("_j95", "_j99")])).alias("ranks"))
    vals = ranks_near(log.where(ok), keys, latency, wanted, (0.5, 0.95, 0.99))
    vmap = vals.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "v")))
                                   .alias("_x"))

    def x(r):
        return F.element_at(F.col("_x"), F.least(r, L))

    def interp(j, d, n):
        return F.when(L == 1, x(F.lit(1))).otherwise(
            (x(F.col(j)) * (F.lit(n) - F.col(d)) + x(F.col(j) + 1) * F.col(d)) / F.lit(n))

    span = F.col("_t1") - F.col("_t0")
    minutes = F.when(span > 0, span / 60.0).otherwise(F.lit(1.0 / 60.0))
    none = L == 0

    def z(c):
        return F.when(none, F.lit(0.0)).otherwise(c)

    return g.join(vmap, keys, "left").select(
        *keys,
        "total_requests", "successful",
        (F.col("total_requests") - L).alias("failed"),
        z(L / F.col("total_requests") * 100.0).alias("success_rate"),
        z(L / minutes).alias("throughput_req_per_min"),
        z(F.col("_avg")).alias("latency_avg_ms"),
        z((x(F.col("_m1")) + x(F.col("_m2"))) / 2.0).alias("latency_p50_ms"),
        z(interp("_j95", "_d95", 20)).alias("latency_p95_ms"),
        z(interp("_j99", "_d99", 100)).alias("latency_p99_ms"),
        z(F.col("_min")).alias("latency_min_ms"),
        z(F.col("_max")).alias("latency_max_ms"),
    )


def total_rss_mb(process_stats: DataFrame, key: str = "full_run_id",
                 rss: str = "rss") -> DataFrame:
    """A4: sum of resident set sizes per run, in MiB."""
    return process_stats.groupBy(key).agg((F.sum(rss) / F.lit(1024.0 * 1024.0))
                                          .alias("total_rss_mb"))


def consolidate_runs(summaries: DataFrame, manifests: DataFrame,
                     rss: DataFrame | None = None, key: str = "full_run_id") -> DataFrame:
    """Summary x manifest (inner: a run lacking either is skipped) x rss
    (left: missing -> null); run_id falls back to the directory name."""
    m = manifests.select(key, F.col("run_id").alias("_rid"), "notes", "batch_size")
    out = summaries.join(m, key, "inner")
    if rss is not None:
        out = out.join(rss.select(key, "total_rss_mb"), key, "left")
    else:
        out = out.withColumn("total_rss_mb", F.lit(None).cast("double"))
    return out.select(
        F.coalesce(F.col("_rid"), F.col(key)).alias("run_id"), key, "notes", "batch_size",
        F.col("throughput_req_per_min").alias("throughput"),
        F.col("latency_p50_ms").alias("latency_p50"),
        F.col("latency_p95_ms").alias("latency_p95"),
        "success_rate", "total_rss_mb")


def sort_by_throughput(runs: DataFrame) -> DataFrame:
    """Runs by throughput, descending (run_id breaks ties)."""
    return runs.orderBy(F.col("throughput").desc(), F.col("full_run_id"))


def top_throughput(runs: DataFrame, n: int = 3) -> DataFrame:
    """The n highest-throughput runs (planned as TakeOrderedAndProject)."""
    return sort_by_throughput(runs).limit(n)


def metrics_by_time(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Long metric rows ordered by time."""
    return rows.orderBy(ts)


def append_runs(*frames: DataFrame) -> DataFrame:
    """Concatenate per-run rows; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unpivot_percentiles(runs: DataFrame, ids: list[str],
                        p50: str = "latency_p50", p95: str = "latency_p95") -> DataFrame:
    """p50/p95 columns -> (percentile, latency) rows labelled P50/P95."""
    long = runs.unpivot(ids, [p50, p95], "percentile", "latency")
    label = F.when(F.col("percentile") == p50, F.lit("P50")).otherwise(F.lit("P95"))
    return long.withColumn("percentile", label)


def client_summary(sent: DataFrame, results: DataFrame, keys: list[str] | None = None,
                   key: str = "request_id") -> DataFrame:
    """Sent / successful / failed / pending / elapsed of a client run.

    sent(key, ts[, keys]) left-joined with results(key, success, finished_ts);
    a request with no result row is pending.
    """
    keys = keys or []
    r = results.select(key, "success", "finished_ts")
    j = sent.join(r, key, "left")
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("success").isNull()).alias("pending"),
        (F.max("finished_ts") - F.min("ts")).alias("elapsed_s"),
    )
