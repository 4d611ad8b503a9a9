"""Batching rules applied to ordered arrivals per key.

* W4/W5 are window expressions.  The EWMA of W5 is a linear recurrence, so
  it is evaluated as a fold over the last ``EWMA_TERMS`` targets of a
  bounded window frame: older terms weigh less than 0.7**121 ~ 2e-19 of
  the current value, i.e. below double precision.
* W7 (and R2 in ``reuse``) are state machines.  They run as a *streaming
  fold*: rows are hash-partitioned by key and sorted inside partitions
  (spillable sort), then ``mapInPandas`` walks the Arrow batches carrying
  the per-key state across batches.  Memory per task is one batch plus
  one open batch of at most B rows - a group is never materialised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.constants import ADAPTIVE_HISTORY, ADAPTIVE_KEEP, NUM_CHUNKS

EWMA_TERMS = 121


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str,
                 n: int = ADAPTIVE_HISTORY, out: str = "avg_depth") -> DataFrame:
    """Mean of the last n values (current included) per key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.avg(F.col(value).cast("double")).over(w))


def adaptive_delay(df: DataFrame, keys: list[str], order: list[str], depth: str,
                   batch_size: int, min_delay: float, max_delay: float,
                   out: str = "delay") -> DataFrame:
    """Delay recommended after each queue-depth observation.

    target = max when avg10 >= B, else min + avg10/B * (max - min);
    d_t = 0.7 d_{t-1} + 0.3 target_t with d_0 = min; output clamp(d_t, min, max).
    """
    d = rolling_mean(df, keys, order, depth, ADAPTIVE_HISTORY, "avg_depth")
    avg = F.col("avg_depth")
    target = F.when(avg >= F.lit(float(batch_size)), F.lit(float(max_delay))).otherwise(
        F.lit(float(min_delay)) + avg / F.lit(float(batch_size)) *
        F.lit(float(max_delay - min_delay)))
    d = d.withColumn("_target", target)
    base = Window.partitionBy(*keys).orderBy(*order)
    frame = base.rowsBetween(-(EWMA_TERMS - 1), 0)
    d = (d.withColumn("_hist", F.collect_list("_target").over(frame))
         .withColumn("_rn", F.row_number().over(base)))
    keep = ADAPTIVE_KEEP
    start = F.when(F.col("_rn") <= EWMA_TERMS, F.lit(float(min_delay))).otherwise(F.lit(0.0))
    ewma = F.aggregate("_hist", start,
                       lambda acc, x: F.lit(keep) * acc + F.lit(1.0 - keep) * x)
    clamped = F.greatest(F.lit(float(min_delay)), F.least(ewma, F.lit(float(max_delay))))
    return d.withColumn(out, clamped).drop("_target", "_hist", "_rn")


def chunk_size(batch_size: int, num_chunks: int = NUM_CHUNKS) -> int:
    return max(1, batch_size // num_chunks)


def chunk_batches(df: DataFrame, batch_keys: list[str], order: list[str],
                  configured_batch_size: int, num_chunks: int = NUM_CHUNKS) -> DataFrame:
    """Consecutive chunks of max(1, B // num_chunks) inside each batch.

    Batches are bounded by B, so the window groups are bounded.
    """
    size = chunk_size(configured_batch_size, num_chunks)
    w = Window.partitionBy(*batch_keys).orderBy(*order)
    return df.withColumn("chunk_index",
                         F.floor((F.row_number().over(w) - 1) / F.lit(size)).cast("int"))


def sorted_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Hash-partition by key and sort inside partitions (the input of a fold)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def assign_batches(df: DataFrame, keys: list[str], order: list[str], ts_micros: str,
                   batch_size: int, delay_micros: int, id_col: str) -> DataFrame:
    """W7 -> (keys..., id_col, batch_no, pos, reason).

    Per key, in arrival order: the first arrival opens batch 1 at t0; a batch
    closes when it holds B rows ("full") or when an arrival comes at or
    after t0 + delay ("timeout", the arrival opens the next batch); the last
    open batch of a key is flushed as "shutdown".  Batch numbers count from 1.
    """
    src = sorted_by_key(df.select(*keys, *[c for c in order if c not in keys],
                                  F.col(ts_micros).alias("_t"),
                                  *([id_col] if id_col not in order else [])),
                        keys, order)
    key_types = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    id_type = key_types[id_col]
    schema = ", ".join([f"{k} {key_types[k]}" for k in keys] +
                       [f"{id_col} {id_type}", "batch_no long", "pos int", "reason string"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key = None
        batch_no = cnt = 0
        t0 = 0
        open_rows: list[tuple] = []
        out: list[tuple] = []

        def close(reason):
            nonlocal open_rows
            for r in open_rows:
                out.append(r + (reason,))
            open_rows = []

        for pdf in batches:
            kv = list(zip(*[pdf[k].tolist() for k in keys])) if keys else [()] * len(pdf)
            ts = pdf["_t"].to_numpy(np.int64)
            ids = pdf[id_col].tolist()
            for i in range(len(pdf)):
                k = kv[i]
                if k != cur_key:
                    if open_rows:
                        close("shutdown")
                    cur_key, batch_no, cnt = k, 0, 0
                t = int(ts[i])
                if cnt > 0 and t >= t0 + delay_micros:
                    close("timeout")
                    cnt = 0
                if cnt == 0:
                    batch_no += 1
                    t0 = t
                cnt += 1
                open_rows.append(k + (ids[i], batch_no, cnt))
                if cnt >= batch_size:
                    close("full")
                    cnt = 0
            if out:
                yield _frame(out, keys, id_col)
                out = []
        if open_rows:
            close("shutdown")
        if out:
            yield _frame(out, keys, id_col)

    return src.mapInPandas(fold, schema)


def _frame(rows: list[tuple], keys: list[str], id_col: str) -> pd.DataFrame:
    cols = list(keys) + [id_col, "batch_no", "pos", "reason"]
    return pd.DataFrame(rows, columns=cols)


def batch_stats(assigned: DataFrame, keys: list[str], ts_micros: str) -> DataFrame:
    """Per batch size, span (ms) between first and last member, and
    average ms per item (0 for an empty span)."""
    g = assigned.groupBy(*keys, "batch_no").agg(
        F.count(F.lit(1)).alias("size"),
        ((F.max(ts_micros) - F.min(ts_micros)) / F.lit(1000.0)).alias("span_ms"),
        F.first("reason").alias("reason"))
    return g.withColumn("avg_ms_per_item",
                        F.coalesce(F.try_divide(F.col("span_ms"), F.col("size")), F.lit(0.0)))
