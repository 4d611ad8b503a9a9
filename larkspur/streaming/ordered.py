"""R2 and J9 on streams whose rows come out of order.

* ``stream_reuse_in_order`` (R2): rows wait in state until the watermark has
  passed them and are then judged in the order (time, id), so the result is that
  of the batch fold however rows are spread over micro-batches.  A call to the
  state takes part of a millisecond, so keys are dealt to ``ORDERED_BUCKETS``
  buckets, and a bucket is the unit of state.  Its waiting rows are kept by time
  slot, in the parts in which they came; one slot is all that is held at a time,
  also for a key with a third of all rows.  Event-time timers wake a bucket when
  its oldest waiting row is due, and remove the entries that can give no more
  hits.  Rows without a time or later than the watermark are dropped; rows the
  final watermark has not passed stay in state.
* ``stream_compute_once`` (J9): repeats of a key within the watermark never
  reach the scorer (``dropDuplicatesWithinWatermark``); of the others only keys
  without a written answer do.  Each micro-batch writes its answers under its
  batch id, so a replayed batch changes nothing.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.session import shared_dir
from larkspur.streaming.streams import _by_bucket, _out_schema, _restored, finish

# Spark loads a state processor once in a process beside the driver, which has
# neither its search path nor the files given by ``addPyFile``
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Units of state, and rows of one that are put into it or handed on at once.
ORDERED_BUCKETS = 256
_STATE_ROWS = 50_000


def judge(t: np.ndarray, last_miss: int | None, ttl_micros: int) -> tuple[np.ndarray, int | None]:
    """Hit flags of ordered times after a last miss, and the new last miss."""
    hit = np.ones(len(t), dtype=bool)
    i = 0 if last_miss is None else int(np.searchsorted(t, last_miss + ttl_micros, side="right"))
    after = np.searchsorted(t, t + ttl_micros, side="right")
    while i < len(t):                                    # walk the misses only
        hit[i] = False
        last_miss = int(t[i])
        i = int(after[i])
    return hit, last_miss


def judge_in_turn(t: list[int], names: list, last: dict, ttl_micros: int) -> list[bool]:
    """Hit flags of rows in order of time, of many keys; ``last`` is each key's
    last miss and is brought up to date."""
    hit = []
    for at, name in zip(t, names):
        miss = last.get(name)
        hit.append(miss is not None and at - miss <= ttl_micros)
        if not hit[-1]:
            last[name] = at
    return hit


def _by_time(t: list[int], names: list, ids: list) -> tuple[list, list, list]:
    """Rows by (time, id), null ids last."""
    order = sorted(range(len(t)), key=lambda i: (t[i], ids[i] is None, 0 if ids[i] is None else ids[i]))
    return [t[i] for i in order], [names[i] for i in order], [ids[i] for i in order]


class _OrderedReuse(StatefulProcessor):
    """State of a bucket of keys: each key's last miss, and the rows the watermark
    has not passed, by (slot, part); ``slots`` has the parts and the first time of each."""

    def __init__(self, keys: list[str], id_col: str, types: dict[str, str], ttl_micros: int, slot_micros: int):
        self.keys, self.id_col, self.types = keys, id_col, types
        self.ttl, self.slot = ttl_micros, slot_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = ", ".join(f"k{i} array<{self.types[k]}>" for i, k in enumerate(self.keys))
        self.handle = handle
        self.last = handle.getValueState("last_miss", f"{names}, t array<long>")
        self.slots = handle.getValueState("slots", "slot array<long>, parts array<int>, first array<long>")
        # pickled columns: Spark would take every value of an array by itself
        self.waiting = handle.getMapState("waiting", "slot long, part int", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, some, n, earliest = self._held(), [], 0, []
        for pdf in rows:
            some.append(pdf)
            n += len(pdf)
            if n >= _STATE_ROWS:
                earliest.append(self._wait(pd.concat(some, ignore_index=True), held))
                some, n = [], 0
        if n:
            earliest.append(self._wait(pd.concat(some, ignore_index=True), held))
        if earliest:
            self._keep(held)
            self._wake(min(earliest))
        return iter([])

    def _held(self) -> dict[int, list[int]]:
        """slot -> [parts, first time]"""
        slots = self.slots.get()
        return {s: [p, f] for s, p, f in zip(*slots)} if slots is not None else {}

    def _keep(self, held: dict[int, list[int]]) -> None:
        if held:
            self.slots.update((list(held), [p for p, _ in held.values()], [f for _, f in held.values()]))
        else:
            self.slots.clear()

    def _put(self, slot: int, held: dict[int, list[int]], t: list[int], names: list, ids: list) -> None:
        entry = held.setdefault(slot, [0, t[0]])
        self.waiting.updateValue((slot, entry[0]), (pickle.dumps((list(zip(*names)), ids, t)),))
        held[slot] = [entry[0] + 1, min(entry[1], t[0])]

    def _wait(self, pdf: pd.DataFrame, held: dict[int, list[int]]) -> int:
        """Adds a part to every slot that ``pdf`` has rows of; the first time of its rows."""
        from larkspur.streaming.streams import _with_nulls
        n = len(self.keys) + 1                           # by place: Spark renames columns that begin with _
        columns = [_with_nulls(pdf.iloc[:, 3 + i].tolist(), pdf.iloc[:, 3 + n + i].to_numpy(bool)) for i in range(n)]
        t, names, ids = _by_time(pdf.iloc[:, 2].tolist(), list(zip(*columns[:-1])), columns[-1])
        of = np.asarray(t, np.int64) // self.slot
        starts = np.flatnonzero(np.insert(of[1:] != of[:-1], 0, True)).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(t)]):
            self._put(int(of[lo]), held, t[lo:hi], names[lo:hi], ids[lo:hi])
        return t[0]

    def _take(self, slot: int, parts: int) -> tuple[list, list, list]:
        """The rows of a slot in order, removed from state."""
        from larkspur.streaming.streams import _with_nulls
        t, names, ids = [], [], []
        for p in range(parts):
            columns, more_ids, more_t = pickle.loads(self.waiting.getValue((slot, p))[0])
            t += more_t
            names += zip(*[_with_nulls(list(c), np.zeros(0, bool)) for c in columns])
            ids += more_ids
            self.waiting.removeKey((slot, p))
        return _by_time(t, names, ids) if parts > 1 else (t, names, ids)

    def _wake(self, micros: int) -> None:
        """A timer that is due as soon as the watermark has reached ``micros``
        (Spark's are due once it is beyond them)."""
        self.handle.registerTimer(-(-micros // 1000) - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        from larkspur.streaming.streams import _rows_out, _with_nulls
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held, last, stored = self._held(), {}, self.last.get()
        if stored is not None:
            *names, times = stored
            last = dict(zip(zip(*[_with_nulls(list(v), np.zeros(0, bool)) for v in names]), times))
        due = sorted(s for s, (_, first) in held.items() if first <= passed)
        if not due and all(m + self.ttl >= passed for m in last.values()):
            return                                       # another timer of this batch has done it
        kept, out_names, out_ids, out_hit = len(last), [], [], []
        for s in due:
            t, names, ids = self._take(s, held.pop(s)[0])
            n = int(np.searchsorted(np.asarray(t, np.int64), passed, side="right"))
            out_hit += judge_in_turn(t[:n], names[:n], last, self.ttl)
            out_names += names[:n]
            out_ids += ids[:n]
            if n < len(t):
                self._put(s, held, t[n:], names[n:], ids[n:])
            if len(last) > 2 * kept + _STATE_ROWS:       # keys that later rows cannot hit
                last = {k: m for k, m in last.items() if m + self.ttl >= t[n - 1]}
                kept = len(last)
            if len(out_ids) >= _STATE_ROWS:
                yield _rows_out(self.keys, out_names, self.id_col, out_ids, self.types, hit=out_hit)
                out_names, out_ids, out_hit = [], [], []
        if out_ids:
            yield _rows_out(self.keys, out_names, self.id_col, out_ids, self.types, hit=out_hit)
        if due:
            self._keep(held)
        if held:
            self._wake(min(first for _, first in held.values()))
        last = {k: m for k, m in last.items() if m + self.ttl >= passed}
        if last:
            self.last.update((*[list(c) for c in zip(*last)], list(last.values())))
            self._wake(max(last.values()) + self.ttl + 1)
        else:
            self.last.clear()

    def close(self) -> None:
        pass


def stream_reuse_in_order(events: DataFrame, keys: list[str], ts: str, ts_micros: str, id_col: str,
                          ttl_micros: int, watermark: str, slot_micros: int = 3_600_000_000) -> DataFrame:
    """R2 -> (keys..., id_col, hit) of the rows the watermark has passed.  Its state
    needs RocksDB: in a session not of ``get_spark``, start it by ``run_to_sink(..., rocksdb=True)``."""
    cols = [*keys, id_col]
    types = {c: events.schema[c].dataType.simpleString() for c in cols}
    timed = events.where(F.col(ts).isNotNull() & F.col(ts_micros).isNotNull())
    out = _by_bucket(timed, keys, ts, ts_micros, id_col, watermark, ORDERED_BUCKETS).transformWithStateInPandas(
        _OrderedReuse(keys, id_col, types, ttl_micros, slot_micros), _out_schema(cols, types, "hit boolean"),
        "Append", "EventTime")
    return _restored(out, cols, "hit")


def stream_compute_once(requests: DataFrame, key: str, ts: str, watermark: str,
                        compute: Callable[[DataFrame], DataFrame], value_cols: list[str],
                        name: str = "answers_once", timeout_s: int | None = None) -> str:
    """Answers every key of a stream once; returns the path of the answers
    (key, value columns).  ``compute`` gets rows of distinct, unanswered keys."""
    spark = requests.sparkSession
    base = shared_dir(spark, "streams", name)
    schema = compute(spark.createDataFrame([], requests.schema)).select(key, *value_cols).schema
    fresh = requests.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])

    def each(batch: DataFrame, batch_id: int) -> None:
        # a folder per batch; this batch's own, if it is a replay, does not count
        done = spark.read.schema(f"{schema.toDDL()}, batch_id long").option("basePath", f"{base}/answers") \
            .parquet(f"{base}/answers").where(F.col("batch_id") < batch_id) if batch_id else None
        rows = batch.dropDuplicates([key])
        if done is not None:
            rows = rows.join(done.select(key), key, "left_anti")
        compute(rows).select(key, *value_cols).write.mode("overwrite").parquet(f"{base}/answers/batch_id={batch_id}")

    q = (fresh.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    finish(q, timeout_s)
    return f"{base}/answers"
