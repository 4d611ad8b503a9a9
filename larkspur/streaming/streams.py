"""Structured Streaming twins of the batch operators.

* R1 ``stream_answer``: requests arrive as a stream; each micro-batch runs
  the answer plan in ``foreachBatch`` and is written under its batch id
  (overwrite of that one directory, so a replayed batch is idempotent).
* R2 ``stream_reuse_within_ttl``, R3 ``stream_batches``, R4
  ``stream_adaptive_delay``: keyed state machines with
  ``applyInPandasWithState`` (state per key is small: a timestamp, an open
  batch of at most B ids, or the last 9 depths and the current delay; for R2
  and R3 the keys of a bucket are folded by one call).
  Event-time timeouts drop expired reuse entries and flush timed-out batches.
* R5 ``stream_metric_windows``: watermarked tumbling/sliding window
  aggregates in append mode; rows later than the watermark are dropped.
* R6: every stream writes through a checkpointed file sink in append mode.

Checkpoints and sinks live under ``spark.checkpoint.dir`` (shared storage).
The state store provider is RocksDB (set in ``session.get_spark``; in another
session ``run_to_sink`` sets it for the streams that run with no other).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.constants import ADAPTIVE_HISTORY, ADAPTIVE_KEEP
from larkspur.operators.telemetry import bucket_label
from larkspur.session import rocksdb_state, shared_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table read as a file stream (new files = new rows)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # a glob keeps the base path a directory while matching exactly one table
    return r.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def finish(query, timeout_s: int | None) -> None:
    """Waits for the end of a bounded run; never lets a partial one pass."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream not finished after {timeout_s} s; its output is incomplete")
    if query.exception() is not None:
        raise query.exception()


def run_to_sink(df: DataFrame, name: str, output_mode: str = "append",
                timeout_s: int | None = None, rocksdb: bool = False) -> str:
    """Write a stream to a parquet file sink with a checkpoint, process
    everything available now, and return the sink path.  A run that passes
    ``timeout_s`` (none by default) is stopped and raises.  ``rocksdb`` says
    that the stream needs RocksDB state, whatever the session has."""
    spark = df.sparkSession
    base = shared_dir(spark, "streams", name)
    with rocksdb_state(spark) if rocksdb else nullcontext():    # a stream copies the settings as it starts
        q = (df.writeStream.format("parquet").outputMode(output_mode)
             .option("checkpointLocation", f"{base}/_checkpoint")
             .option("path", f"{base}/data")
             .trigger(availableNow=True).start())
    finish(q, timeout_s)
    return f"{base}/data"


def _one_frame(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """The group's rows of this micro-batch as one frame (no copy when the
    group arrived in a single Arrow batch)."""
    parts = [p for p in pdfs if len(p)]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


# --- R5 ----------------------------------------------------------------------

def stream_metric_windows(events: DataFrame, labels: list[str], ts: str, value: str,
                          window: str, watermark: str, slide: str | None = None) -> DataFrame:
    """Per window and label set: samples, value sum, value max."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (events.withWatermark(ts, watermark)
            .groupBy(*labels, w.alias("w"))
            .agg(F.count(F.lit(1)).alias("samples"), F.sum(value).alias("value_sum"),
                 F.max(value).alias("value_max"))
            .select(*labels, F.unix_seconds("w.start").alias("window_start"),
                    F.unix_seconds("w.end").alias("window_end"),
                    "samples", "value_sum", "value_max"))


def stream_metric_histograms(events: DataFrame, labels: list[str], ts: str, value: str,
                             bounds: list[float], id_col: str, window: str, window_seconds: float,
                             watermark: str) -> DataFrame:
    """A6 counts and the W8 rate of the increments ``value`` per window.

    One aggregate per window and label set, combined before the shuffle; a
    window is emitted once the watermark has passed its end."""
    first = F.min_by(F.col(value), F.struct(ts, id_col))
    counts = [F.struct(F.lit(bucket_label(b)).alias("le"), F.col(f"_b{i}").alias("c"))
              for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("c"))]
    g = (events.withWatermark(ts, watermark).groupBy(*labels, F.window(ts, window).alias("w"))
         .agg(*[F.count_if(F.col(value) <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)],
              F.count(F.lit(1)).alias("count"), F.sum(value).alias("_s"), first.alias("_f")))
    return g.select(*labels, F.unix_seconds("w.start").alias("window_start"), F.explode(F.array(*counts)).alias("e"),
                    "count", ((F.col("_s") - F.col("_f")) / F.lit(float(window_seconds))).alias("rate")) \
        .select(*labels, "window_start", F.col("e.le").alias("le"), F.col("e.c").alias("cumulative_count"),
                "count", "rate")


# --- R2 and R3: many keys a call ----------------------------------------------

#: A call of a state function costs milliseconds, whatever it does.  Keys are
#: therefore dealt to this many buckets, and a bucket is the unit of state.
KEY_BUCKETS = 2048
_NO_TIME = -(1 << 63)                                    # stands for a null time
_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
_NAN = float("nan")


def _by_bucket(events: DataFrame, keys: list[str], ts: str, ts_micros: str, id_col: str, watermark: str,
               buckets: int | None = None):
    """Rows (bucket, ts, _t, keys.., id) grouped by bucket; ``_n{i}`` says that
    the i-th of the keys and the id is null, as a null makes numbers inexact in pandas."""
    cols = [*keys, id_col]
    sent = [F.coalesce(c, F.lit(0)).cast(events.schema[c].dataType).alias(c)
            if events.schema[c].dataType.simpleString() in _NUMBERS else F.col(c) for c in cols]
    return events.withWatermark(ts, watermark).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets or KEY_BUCKETS)).cast("int").alias("_bucket"), ts,
        F.coalesce(F.col(ts_micros), F.lit(_NO_TIME)).alias("_t"), *sent,
        *[F.col(c).isNull().alias(f"_n{i}") for i, c in enumerate(cols)]).groupBy("_bucket")


def _with_nulls(values: list, null: np.ndarray) -> list:
    out = [None if n else v for v, n in zip(values, null.tolist())] if null.any() else values
    return [_NAN if v != v else v for v in out]          # one object, so that it equals itself


def _in_order(pdf: pd.DataFrame, keys: list[str], id_col: str,
              no_time_last: bool = False) -> tuple[np.ndarray, list, list]:
    """Times, keys (tuples) and ids of a bucket's rows by time and id; rows
    without a time come first, or last."""
    t, null_id = pdf["_t"].to_numpy(np.int64), pdf[f"_n{len(keys)}"].to_numpy(bool)
    o = np.lexsort((pdf[id_col].to_numpy(), null_id, t, no_time_last & (t == _NO_TIME)))
    pdf = pdf.iloc[o]
    names = list(zip(*[_with_nulls(pdf[k].tolist(), pdf[f"_n{i}"].to_numpy(bool)) for i, k in enumerate(keys)]))
    return t[o], names, _with_nulls(pdf[id_col].tolist(), null_id[o])


def _rows_out(keys: list[str], names: list[tuple], id_col: str, ids: list, types: dict, **more) -> pd.DataFrame:
    """The rows given back, nulls as flags beside a zero (see ``_restored``)."""
    out = {}
    for i, (c, values) in enumerate(zip([*keys, id_col], [*(zip(*names) if names else [[] for _ in keys]), ids])):
        null = [v is None for v in values]
        out[c] = [0 if n else v for v, n in zip(values, null)] if types[c] in _NUMBERS else list(values)
        out[f"_n{i}"] = null
    return pd.DataFrame(out | more)


def _out_schema(cols: list[str], types: dict, more: str) -> str:
    return ", ".join(f"`{c}` {types[c]}, _n{i} boolean" for i, c in enumerate(cols)) + ", " + more


def _restored(df: DataFrame, cols: list[str], *more: str) -> DataFrame:
    return df.select(*[F.when(~F.col(f"_n{i}"), F.col(c)).alias(c) for i, c in enumerate(cols)], *more)


# --- R2 ----------------------------------------------------------------------

def stream_reuse_within_ttl(events: DataFrame, keys: list[str], ts: str, ts_micros: str,
                            id_col: str, ttl_micros: int, watermark: str) -> DataFrame:
    """R2 on a stream -> (keys..., id_col, hit); same rule as the batch fold.

    State of a bucket of keys: each key's last miss time.  Entries that can no
    longer produce a hit are removed by an event-time timeout at the first
    last_miss + ttl, and whenever the bucket gets rows.
    """
    cols = [*keys, id_col]
    types = {c: events.schema[c].dataType.simpleString() for c in cols}

    def due(micros: int) -> int:
        return micros // 1000 + ttl_micros // 1000 + 1

    def fn(bucket, pdfs: Iterator[pd.DataFrame], state: GroupState):
        from larkspur.streaming.ordered import judge
        now = state.getCurrentWatermarkMs()
        last = {}
        if state.exists:
            *names, times = state.get
            last = dict(zip(zip(*[_with_nulls(list(v), np.zeros(0, bool)) for v in names]), times))
        pdf = None if state.hasTimedOut else _one_frame(pdfs)
        last = {k: m for k, m in last.items() if due(m) >= now}
        if pdf is not None:
            t, names, ids = _in_order(pdf, keys, id_col)
            places = {}
            for at, name in enumerate(names):
                places.setdefault(name, []).append(at)
            hit = np.ones(len(t), dtype=bool)
            for name, at in places.items():
                hit[at], last[name] = judge(t[at], last.get(name), ttl_micros)
            yield _rows_out(keys, names, id_col, ids, types, hit=hit)
        if not last:
            state.remove()
            return
        state.update((*[list(v) for v in zip(*last)], list(last.values())))
        state.setTimeoutTimestamp(max(due(min(last.values())), now + 1))

    state_schema = ", ".join(f"_k{i} array<{types[k]}>" for i, k in enumerate(keys)) + ", last_miss array<long>"
    out = _by_bucket(events, keys, ts, ts_micros, id_col, watermark).applyInPandasWithState(
        fn, _out_schema(cols, types, "hit boolean"), state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    return _restored(out, cols, "hit")


# --- R3 ----------------------------------------------------------------------

def stream_batches(events: DataFrame, keys: list[str], ts: str, ts_micros: str, id_col: str,
                   batch_size: int, delay_micros: int, watermark: str) -> DataFrame:
    """W7 on a stream -> (keys..., id_col, batch_no, pos, reason).

    A batch is emitted when full, when a later arrival reaches its deadline,
    or when the watermark passes t0 + delay (timer).  A batch still open
    when the stream stops stays in state (no shutdown flush on a stream).
    State of a bucket of keys: each key's batch number, start and open ids.
    """
    cols = [*keys, id_col]
    types = {c: events.schema[c].dataType.simpleString() for c in cols}

    def fn(bucket, pdfs: Iterator[pd.DataFrame], state: GroupState):
        now = state.getCurrentWatermarkMs()
        held = {}                                        # key -> [batch_no, t0, ids]
        if state.exists:
            *names, number, start, open_ids = state.get
            names = zip(*[_with_nulls(list(v), np.zeros(0, bool)) for v in names])
            held = {k: [n, t, list(i)] for k, n, t, i in zip(names, number, start, open_ids)}
        out = [], [], [], [], []                         # key, id, batch_no, pos, reason

        def emit(name, entry, reason):
            n = len(entry[2])
            for c, values in zip(out, ([name] * n, entry[2], [entry[0]] * n, range(1, n + 1), [reason] * n)):
                c.extend(values)
            entry[2] = []

        pdf = None if state.hasTimedOut else _one_frame(pdfs)
        seen = set()
        if pdf is not None:
            times, names, ids = _in_order(pdf, keys, id_col, no_time_last=True)
            for t, name, i in zip(times.tolist(), names, ids):
                entry = held.setdefault(name, [0, 0, []])
                if entry[2] and t >= entry[1] + delay_micros:
                    emit(name, entry, "timeout")
                if not entry[2]:
                    entry[0] += 1
                    entry[1] = t
                entry[2].append(i)
                if len(entry[2]) >= batch_size:
                    emit(name, entry, "full")
            seen.update(names)
        wake = None
        for name, entry in held.items():
            if not entry[2]:
                continue
            deadline = (entry[1] + delay_micros) // 1000
            if deadline < now and name not in seen:      # the bucket's other keys got rows
                emit(name, entry, "timeout")
                continue
            wake = min(max(deadline, now + 1), wake or max(deadline, now + 1))
        state.update((*[list(v) for v in zip(*held)], *[list(v) for v in zip(*held.values())]))
        if wake is not None:
            state.setTimeoutTimestamp(wake)
        if out[0]:
            yield _rows_out(keys, out[0], id_col, out[1], types, batch_no=out[2], pos=out[3], reason=out[4])

    state_schema = ", ".join(f"_k{i} array<{types[k]}>" for i, k in enumerate(keys)) + \
        f", batch_no array<long>, t0 array<long>, ids array<array<{types[id_col]}>>"
    out = _by_bucket(events, keys, ts, ts_micros, id_col, watermark).applyInPandasWithState(
        fn, _out_schema(cols, types, "batch_no long, pos int, reason string"), state_schema, "append",
        GroupStateTimeout.EventTimeTimeout)
    return _restored(out, cols, "batch_no", "pos", "reason")


# --- R4 ----------------------------------------------------------------------

def stream_adaptive_delay(events: DataFrame, keys: list[str], ts_micros: str, id_col: str,
                          depth: str, batch_size: int, min_delay: float,
                          max_delay: float) -> DataFrame:
    """W5 on a stream -> (keys..., id_col, avg_depth, delay); exact
    recurrence with the last 9 depths and the unclamped delay in state."""
    ktypes = [f"{k} {events.schema[k].dataType.simpleString()}" for k in keys]
    id_type = events.schema[id_col].dataType.simpleString()
    out_schema = ", ".join(ktypes + [f"{id_col} {id_type}", "avg_depth double",
                                     "delay double"])
    keep = ADAPTIVE_KEEP
    hist_n = ADAPTIVE_HISTORY

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        from larkspur.operators.sequence import _ewma, _targets
        hist, d = (list(state.get[0]), state.get[1]) if state.exists else ([], min_delay)
        pdf = _one_frame(pdfs)
        if pdf is None:
            return
        o = np.lexsort((pdf[id_col].to_numpy(), pdf["_t"].to_numpy(np.int64)))
        dep = pdf[depth].to_numpy(np.float64)[o]
        avg, tgt = _targets(dep, hist, float(batch_size), float(min_delay), float(max_delay))
        dd = _ewma(tgt, d, keep)
        state.update(((list(hist) + dep.tolist())[-(hist_n - 1):], float(dd[-1])))
        out = {k: np.repeat(np.asarray([v]), len(dep)) for k, v in zip(keys, key)}
        out[id_col] = pdf[id_col].to_numpy()[o]
        out["avg_depth"] = avg
        out["delay"] = np.clip(dd, min_delay, max_delay)
        yield pd.DataFrame(out)

    src = events.withColumn("_t", F.col(ts_micros))
    return src.groupBy(*keys).applyInPandasWithState(
        fn, out_schema, "hist array<double>, d double", "append", GroupStateTimeout.NoTimeout)


# --- R1 ----------------------------------------------------------------------

def stream_answer(requests: DataFrame, answer_batch, name: str = "answers",
                  timeout_s: int | None = None) -> str:
    """Run ``answer_batch(micro_batch_df) -> (answers, rejects)`` per
    micro-batch; answers and rejects are written under batch_id=N (overwrite
    of that directory makes a replay idempotent).  Returns the output base."""
    spark = requests.sparkSession
    base = shared_dir(spark, "streams", name)

    def each(batch: DataFrame, batch_id: int) -> None:
        answers, rejects = answer_batch(batch)
        answers.write.mode("overwrite").parquet(f"{base}/answers/batch_id={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{base}/rejects/batch_id={batch_id}")

    q = (requests.writeStream.foreachBatch(each)
         .option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    finish(q, timeout_s)
    return base
