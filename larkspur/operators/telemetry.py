"""Metric series computed from event rows.

Labels come from the data (no registry).  Every operator here is a single
partial/final aggregate - histogram buckets are conditional counts inside
one aggregate, counter rates are sliding-window aggregates - so a hot label
set is combined map-side and never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.timeutil import epoch_micros


def bucket_label(b: float) -> str:
    return str(b)


def histogram_buckets(df: DataFrame, labels: list[str], value: str,
                      bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts -> (labels..., le, cumulative_count, sum, count).

    ``le`` is the text of the upper bound, with a final "+Inf" bucket.  One
    aggregate computes all cumulative counts (count of v <= bound).
    """
    v = F.col(value)
    aggs = [F.count_if(v <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)]
    g = df.groupBy(*labels).agg(*aggs, F.count(v).alias("count"), F.sum(v).alias("sum"))
    entries = [F.struct(F.lit(bucket_label(b)).alias("le"), F.col(f"_b{i}").alias("c"))
               for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("c")))
    return g.select(*labels, F.explode(F.array(*entries)).alias("_e"), "sum", "count").select(
        *labels, F.col("_e.le").alias("le"), F.col("_e.c").alias("cumulative_count"),
        "sum", "count")


def labelled_counters(df: DataFrame, labels: list[str], amount: str | None = None) -> DataFrame:
    """Additive totals per label set (count of rows, and sum of amount)."""
    aggs = [F.count(F.lit(1)).alias("total")]
    if amount is not None:
        aggs.append(F.sum(amount).alias("amount_total"))
    return df.groupBy(*labels).agg(*aggs)


def latest_gauge(df: DataFrame, labels: list[str], value: str,
                 order: list[str]) -> DataFrame:
    """Last value set per label set; ``order`` is a total order (ts, id)."""
    return df.groupBy(*labels).agg(
        F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias("last_value"))


def counter_rate_from_increments(df: DataFrame, labels: list[str], ts: str, inc: str,
                                 order: list[str], width: str, slide: str,
                                 width_seconds: float) -> DataFrame:
    """W8 for a counter given as its increments (no resets).

    The counter read at each event is the running sum; within a window the
    sum of positive deltas between consecutive samples is the sum of the
    increments of every sample but the first.  rate = that / width.
    ``ts`` must be a timestamp (instant) column.
    """
    first = F.min_by(F.col(inc), F.struct(*[F.col(c) for c in order]))
    g = (df.groupBy(*labels, F.window(ts, width, slide).alias("w"))
         .agg(F.sum(inc).alias("_s"), first.alias("_f"), F.count(F.lit(1)).alias("samples")))
    return g.select(*labels, F.unix_seconds(F.col("w.start")).alias("window_start"),
                    ((F.col("_s") - F.col("_f")) / F.lit(float(width_seconds))).alias("rate"),
                    "samples")


def counter_deltas(samples: DataFrame, labels: list[str], ts: str, value: str,
                   order: list[str] | None = None) -> DataFrame:
    """Positive deltas of a counter series; a drop is a reset (delta = new value).

    The previous reading comes from a range-partitioned lag (``sequence.
    lag_scan``), so a label set with most of the samples is still split."""
    from larkspur.operators.sequence import lag_scan
    s = lag_scan(samples, labels, order or [ts], value, "_prev")
    prev = F.col("_prev")
    d = F.when(prev.isNull(), F.lit(0.0)).when(F.col(value) >= prev, F.col(value) - prev) \
        .otherwise(F.col(value))
    return s.withColumn("delta", d).drop("_prev")


def counter_rate(samples: DataFrame, labels: list[str], ts: str, value: str,
                 width: str, slide: str, width_seconds: float,
                 order: list[str] | None = None) -> DataFrame:
    """W8 over raw counter readings: sum of positive deltas inside the window
    (the window's first sample contributes none) / width, per label set."""
    order = order or [ts]
    d = counter_deltas(samples, labels, ts, value, order)
    first = F.min_by(F.col("delta"), F.struct(*[F.col(c) for c in order]))
    g = (d.groupBy(*labels, F.window(ts, width, slide).alias("w"))
         .agg(F.sum("delta").alias("_s"), first.alias("_f")))
    return g.select(*labels, F.unix_seconds(F.col("w.start")).alias("window_start"),
                    ((F.col("_s") - F.col("_f")) / F.lit(float(width_seconds))).alias("rate"))


def stage_profile_summary(stages: DataFrame, key: str = "request_id",
                          with_stages: bool = False, order: str | None = None,
                          requests: DataFrame | None = None) -> DataFrame:
    """A5: per request total duration, max peak memory, total delta, count.

    ``with_stages`` adds the ordered per-stage array; only use it where the
    number of stages per request is bounded (it is a handful in a plan).
    With ``requests`` every request gets a row: one without stages has zero
    totals, zero count and an empty stage list.
    """
    aggs = [F.sum("duration_ms").alias("total_duration_ms"),
            F.max("peak_memory_mb").alias("peak_memory_mb"),
            F.sum("memory_delta_mb").alias("total_memory_delta_mb"),
            F.count(F.lit(1)).alias("stage_count")]
    if with_stages:
        o = order or "stage_name"
        aggs.append(F.sort_array(F.collect_list(F.struct(o, "stage_name", "duration_ms")))
                    .alias("stages"))
    out = stages.groupBy(key).agg(*aggs)
    if requests is not None:
        out = requests.select(key).join(out, key, "left").fillna(
            {"peak_memory_mb": 0.0, "stage_count": 0})
        if with_stages:
            out = out.withColumn("stages", F.coalesce(
                "stages", F.array().cast(out.schema["stages"].dataType)))
    return out.fillna({"total_duration_ms": 0.0, "total_memory_delta_mb": 0.0})


def hash_unit(key) -> Column:
    """Deterministic value in [0, 1) from the first 32 bits of md5(key)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(
        4294967296.0)


def sample_profiles(df: DataFrame, rate: float, key: str = "request_id") -> DataFrame:
    """Keep a row when its key's hash unit is below the rate.

    The rate is clamped to [0, 1]; a rate <= 0 keeps nothing.  Hash-based, so
    the choice is reproducible and identical across retries.
    """
    r = min(max(float(rate), 0.0), 1.0)
    if r <= 0.0:
        return df.where(F.lit(False))
    return df.where(hash_unit(key) < F.lit(r))


def window_start_micros(ts_ntz: str, slide_us: int) -> Column:
    return F.floor(epoch_micros(ts_ntz) / F.lit(slide_us)) * F.lit(slide_us)
