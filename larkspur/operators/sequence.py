"""Exact ordered scans per key that do not put a hot key in one task.

Rows are range-partitioned on (key, order) - so a key holding a third of
all rows is cut into many contiguous partitions - sorted inside partitions
and checkpointed (both passes below then read the same partitions).

1. Each partition streams its Arrow batches and summarises, per key run,
   the effect of that run on the scan state (constant size).  Only the first
   and last run of a partition can continue across a boundary, so at most
   two summaries per partition are kept.
2. The driver folds these summaries in partition order (their number is
   bounded by the partition count, not by the data) into the state each
   partition starts with, and broadcasts that small map.
3. A second ``mapInPandas`` pass evaluates the scan exactly from the
   carried-in state, batch by batch, vectorised with numpy.

Used for the adaptive batching delay (W4 + W5): the state is the last 9
queue depths and the unclamped delay.  The EWMA part of a run is linear in
the incoming delay and only the first 9 rows depend on the incoming depths,
which is what makes the summary constant-size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.constants import ADAPTIVE_HISTORY, ADAPTIVE_KEEP
from larkspur.session import cut_lineage

_CHUNK = 256
_HN = ADAPTIVE_HISTORY - 1


def range_sorted(df: DataFrame, keys: list[str], order: list[str],
                 partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(p, *keys, *order).sortWithinPartitions(*keys, *order)
    return cut_lineage(s)


def _targets(depths: np.ndarray, hist: list[float], b: float, lo: float, hi: float):
    """avg of the last 10 depths (history included) and the delay target per row."""
    allv = np.concatenate([np.asarray(hist, dtype=np.float64), depths.astype(np.float64)])
    c = np.concatenate([[0.0], np.cumsum(allv)])
    j = np.arange(len(hist), len(allv))
    s = np.maximum(0, j - _HN)
    avg = (c[j + 1] - c[s]) / (j + 1 - s)
    tgt = np.where(avg >= b, hi, lo + avg / b * (hi - lo))
    return avg, tgt


def _ewma(tgt: np.ndarray, d_in: float, keep: float) -> np.ndarray:
    """d_j = keep d_{j-1} + (1-keep) t_j in closed form over chunks."""
    out = np.empty(len(tgt))
    d = d_in
    for s in range(0, len(tgt), _CHUNK):
        t = tgt[s:s + _CHUNK]
        pw = keep ** np.arange(1, len(t) + 1)
        seg = pw * (d + np.cumsum((1.0 - keep) * t / pw))
        out[s:s + len(t)] = seg
        d = seg[-1]
    return out


def _runs(pdf: pd.DataFrame, keys: list[str]):
    """Contiguous runs of equal keys in a sorted batch (vectorised boundaries)."""
    if len(pdf) == 0:
        return
    kdf = pdf[keys]
    change = (kdf != kdf.shift()).any(axis=1).to_numpy()
    change[0] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(pdf))
    for a, e in zip(starts.tolist(), ends.tolist()):
        yield repr(tuple(kdf.iloc[a].tolist())), pdf.iloc[a:e]


class _Summary:
    """Constant-size effect of one key run: n, first 9 and last 9 depths, and
    the EWMA contribution of rows whose 10-wide window lies inside the run."""

    def __init__(self, key: str):
        self.key, self.n, self.first, self.last, self.tail = key, 0, [], [], 0.0

    def add(self, d: np.ndarray, b, lo, hi, keep):
        m = len(d)
        _, tgt = _targets(d, self.last, b, lo, hi)
        idx = self.n + np.arange(m)
        w = (1.0 - keep) * keep ** np.arange(m - 1, -1, -1, dtype=np.float64)
        self.tail = self.tail * keep ** m + float((w * tgt)[idx >= _HN].sum())
        self.first = (self.first + d.tolist())[:_HN] if len(self.first) < _HN else self.first
        self.last = (self.last + d.tolist())[-_HN:]
        self.n += m


def adaptive_delay_scan(df: DataFrame, keys: list[str], order: list[str], depth: str,
                        batch_size: int, min_delay: float, max_delay: float,
                        id_col: str, partitions: int | None = None) -> DataFrame:
    """W4 + W5 -> (keys..., id_col, avg_depth, delay), exact, hot keys split."""
    cols = list(dict.fromkeys([*keys, *order, id_col, depth]))
    s = range_sorted(df.select(*cols), keys, order, partitions)
    keep = ADAPTIVE_KEEP
    b, lo, hi = float(batch_size), float(min_delay), float(max_delay)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        first_run = cur = None
        for pdf in batches:
            for key, g in _runs(pdf, keys):
                if cur is None or cur.key != key:
                    if cur is not None and first_run is None:
                        first_run = cur
                    cur = _Summary(key)
                cur.add(g[depth].to_numpy(np.float64), b, lo, hi, keep)
        out = [r for r in (first_run, cur) if r is not None]
        yield pd.DataFrame([(pid, i, r.key, r.n, r.first, r.last, r.tail)
                            for i, r in enumerate(out)],
                           columns=["pid", "i", "key", "n", "first", "last", "tail"])

    summ = s.mapInPandas(summarise, "pid int, i int, key string, n long, "
                                    "first array<double>, last array<double>, tail double")
    # at most two constant-size rows per partition
    rows = summ.orderBy("pid", "i").collect()
    carry: dict[tuple[int, str], tuple[list[float], float]] = {}
    state: dict[str, tuple[list[float], float]] = {}
    for r in rows:
        pid, key, n = r["pid"], r["key"], r["n"]
        if key in state:
            carry[(pid, key)] = state[key]
        hist, d_in = state.get(key, ([], lo))
        k9 = min(_HN, n)
        _, tgt = _targets(np.asarray(r["first"][:k9], dtype=np.float64), hist, b, lo, hi)
        w = (1.0 - keep) * keep ** np.arange(n - 1, n - 1 - k9, -1, dtype=np.float64)
        d_out = keep ** n * d_in + float((w * tgt).sum()) + r["tail"]
        new_hist = (list(hist) + list(r["first"]))[-_HN:] if n < _HN else list(r["last"])
        state[key] = (new_hist, d_out)
    bc = s.sparkSession.sparkContext.broadcast(carry)

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        cmap = bc.value
        cur_key, hist, d_prev = None, [], lo
        for pdf in batches:
            outs = []
            for key, g in _runs(pdf, keys):
                if key != cur_key:
                    cur_key = key
                    hist, d_prev = cmap.get((pid, key), ([], lo))
                dep = g[depth].to_numpy(np.float64)
                avg, tgt = _targets(dep, hist, b, lo, hi)
                d = _ewma(tgt, d_prev, keep)
                hist = (list(hist) + dep.tolist())[-_HN:]
                d_prev = float(d[-1])
                o = g[[*keys, id_col]].copy()
                o["avg_depth"] = avg
                o["delay"] = np.clip(d, lo, hi)
                outs.append(o)
            if outs:
                yield pd.concat(outs)

    types = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] +
                       [f"{id_col} {types[id_col]}", "avg_depth double", "delay double"])
    return s.mapInPandas(evaluate, schema)


# ---------------------------------------------------------------------------
# Batch assignment with hot keys split
# ---------------------------------------------------------------------------
#
# A run of a key inside a partition behaves, for any incoming open batch,
# like "the incoming batch takes rows [0, r) and a fresh batch starts at row
# r", with r <= B.  So a run is summarised by its first B timestamps and, for
# each r in [0, min(B, n)], the batches it starts and its end state.  Runs
# simulated from different r usually merge after a few batches (same batch
# start row), after which they share the tail of the row-0 simulation.

def _w7_sim(ts: np.ndarray, start: int, b: int, delay: int,
            merge: dict[int, int] | None = None):
    """Fresh batch at row ``start``; returns (starts, cnt_end, t0_end, merged_at).

    With ``merge`` (batch-start rows of another simulation) it stops at the
    first batch start the two share: from there on they are identical."""
    starts: list[int] = []
    cnt, t0 = 0, 0
    for i in range(start, len(ts)):
        t = int(ts[i])
        if cnt > 0 and t >= t0 + delay:
            cnt = 0
        if cnt == 0:
            if merge is not None and i in merge:
                return starts, None, None, i
            starts.append(i)
            t0 = t
        cnt += 1
        if cnt >= b:
            cnt = 0
    return starts, cnt, t0, None


def _w7_table(ts: np.ndarray, b: int, delay: int):
    """For r in [0, min(b, n)]: (batches started, cnt_end, t0_end)."""
    s0, c0, t00, _ = _w7_sim(ts, 0, b, delay)
    idx0 = {s: k for k, s in enumerate(s0)}
    table = []
    for r in range(0, min(b, len(ts)) + 1):
        if r == len(ts):
            table.append((0, 0, 0))
            continue
        if r in idx0:
            table.append((len(s0) - idx0[r], c0, t00))
            continue
        st, c, t0, m = _w7_sim(ts, r, b, delay, idx0)
        if m is None:
            table.append((len(st), c, t0))
        else:
            table.append((len(st) + len(s0) - idx0[m], c0, t00))
    return table


def assign_batches_scan(df: DataFrame, keys: list[str], order: list[str], ts_micros: str,
                        batch_size: int, delay_micros: int, id_col: str,
                        partitions: int | None = None) -> DataFrame:
    """W7 -> (keys..., id_col, batch_no, pos, reason); exact, hot keys split.

    Same rule as ``batching.assign_batches``: full at B rows, timeout when an
    arrival reaches t0 + delay, the last open batch of a key is "shutdown".
    """
    b, dl = int(batch_size), int(delay_micros)
    cols = list(dict.fromkeys([*keys, *order, id_col, ts_micros]))
    s = range_sorted(df.select(*cols).withColumn("_t", F.col(ts_micros)), keys, order,
                     partitions)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        first = cur = None      # (key, int64 chunks) of the first and the current run
        for pdf in batches:
            for key, g in _runs(pdf, keys):
                t = g["_t"].to_numpy(np.int64)
                if cur is not None and cur[0] == key:
                    cur[1].append(t)
                    continue
                if cur is not None and first is None:
                    first = cur
                cur = (key, [t])   # a middle run is dropped when the next begins
        out = [(k, np.concatenate(c)) for k, c in (r for r in (first, cur) if r is not None)]
        rows = []
        for i, (key, arr) in enumerate(out):
            ts = arr
            if i == 0:
                tab = _w7_table(arr, b, dl)
            else:  # the last run of a partition always starts fresh
                s0, c0, t00, _ = _w7_sim(arr, 0, b, dl)
                tab = [(len(s0), c0, t00)]
            rows.append((pid, i, key, len(ts), ts[:b].tolist(), [x[0] for x in tab],
                         [x[1] for x in tab], [x[2] for x in tab]))
        yield pd.DataFrame(rows, columns=["pid", "i", "key", "n", "head", "nb", "cend", "tend"])

    summ = s.mapInPandas(summarise, "pid int, i int, key string, n long, head array<long>, "
                                    "nb array<long>, cend array<long>, tend array<long>")
    rows = summ.orderBy("pid", "i").collect()   # at most two rows per partition
    state: dict[str, tuple[int, int, int]] = {}  # key -> (batch_no, cnt, t0)
    carry: dict[tuple[int, str], tuple[int, int, int]] = {}
    reasons: dict[tuple[str, int], str] = {}
    last_key = None
    for r in rows:
        pid, key, n = r["pid"], r["key"], r["n"]
        if last_key is not None and last_key != key:
            bn, cnt, _t0 = state[last_key]      # that key has ended: flush
            if cnt > 0:
                reasons[(last_key, bn)] = "shutdown"
        bno, cnt, t0 = state.get(key, (0, 0, 0)) if r["i"] == 0 else (0, 0, 0)
        if r["i"] == 0 and key in state:
            carry[(pid, key)] = (bno, cnt, t0)
        head = list(r["head"])
        if cnt == 0:
            rr = 0
        else:
            rr = min(b - cnt, n)
            for j in range(min(b - cnt, n)):
                if head[j] >= t0 + dl:
                    rr = j
                    break
            if rr < n or cnt + rr == b:
                reasons[(key, bno)] = "full" if cnt + rr == b else "timeout"
        if cnt > 0 and rr == n and cnt + n < b:
            state[key] = (bno, cnt + n, t0)
        else:
            nb, ce, te = r["nb"][rr], r["cend"][rr], r["tend"][rr]
            state[key] = (bno + nb, ce, te)
        last_key = key
    if last_key is not None:
        bn, cnt, _t0 = state[last_key]
        if cnt > 0:
            reasons[(last_key, bn)] = "shutdown"
    bc = s.sparkSession.sparkContext.broadcast((carry, reasons))

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        cmap, rmap = bc.value
        out: list[tuple] = []
        open_rows: list[tuple] = []
        cur_key = None
        bno = cnt = t0 = 0
        kcols = None

        def close(reason):
            nonlocal open_rows
            out.extend(r + (reason,) for r in open_rows)
            open_rows = []

        for pdf in batches:
            for key, g in _runs(pdf, keys):
                if key != cur_key:
                    if open_rows:
                        close(rmap.get((cur_key, bno), "shutdown"))
                    cur_key = key
                    bno, cnt, t0 = cmap.get((pid, key), (0, 0, 0))
                kv = tuple(g[keys].iloc[0].tolist())
                kcols = keys
                for t, i in zip(g["_t"].to_numpy(np.int64).tolist(), g[id_col].tolist()):
                    if cnt > 0 and t >= t0 + dl:
                        close(rmap.get((cur_key, bno), "timeout"))
                        cnt = 0
                    if cnt == 0:
                        bno += 1
                        t0 = t
                    cnt += 1
                    open_rows.append(kv + (i, bno, cnt))
                    if cnt >= b:
                        close("full")
                        cnt = 0
            if out:
                yield pd.DataFrame(out, columns=[*keys, id_col, "batch_no", "pos", "reason"])
                out = []
        if open_rows:
            close(rmap.get((cur_key, bno), "shutdown"))
        if out:
            yield pd.DataFrame(out, columns=[*(kcols or keys), id_col, "batch_no", "pos",
                                             "reason"])

    types = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] +
                       [f"{id_col} {types[id_col]}", "batch_no long", "pos int",
                        "reason string"])
    return s.mapInPandas(evaluate, schema)


# ---------------------------------------------------------------------------
# R2: reuse within TTL with hot keys split
# ---------------------------------------------------------------------------
#
# State = time of the key's last miss L.  Given L, the leading rows with
# t <= L + ttl are hits and the row after them starts a deterministic chain
# of misses (each miss -> first row later than miss + ttl).  A run's effect
# is therefore the function "number of leading hits r -> last miss of the
# chain from r", needed only for r within one ttl of the run's first row.

def _r2_chain(t: np.ndarray, ttl: int):
    """nxt[i] = first row later than t[i] + ttl; end[i] = last miss of the
    chain starting with a miss at i (pointer jumping, O(log n) passes)."""
    n = len(t)
    nxt = np.searchsorted(t, t + ttl, side="right")
    e = np.where(nxt < n, nxt, np.arange(n))
    while True:
        e2 = e[e]
        if np.array_equal(e2, e):
            return nxt, e
        e = e2


def reuse_within_ttl_scan(df: DataFrame, keys: list[str], order: list[str], ts_micros: str,
                          ttl_micros: int, id_col: str,
                          partitions: int | None = None) -> DataFrame:
    """R2 -> (keys..., id_col, hit); exact, hot keys split across tasks."""
    ttl = int(ttl_micros)
    cols = list(dict.fromkeys([*keys, *order, id_col, ts_micros]))
    s = range_sorted(df.select(*cols).withColumn("_t", F.col(ts_micros)), keys, order,
                     partitions)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        first = cur = None      # (key, int64 chunks) of the first and the current run
        for pdf in batches:
            for key, g in _runs(pdf, keys):
                t = g["_t"].to_numpy(np.int64)
                if cur is not None and cur[0] == key:
                    cur[1].append(t)
                    continue
                if cur is not None and first is None:
                    first = cur
                cur = (key, [t])
        out = [(k, np.concatenate(c)) for k, c in (r for r in (first, cur) if r is not None)]
        rows = []
        for i, (key, t) in enumerate(out):
            n = len(t)
            _, e = _r2_chain(t, ttl)
            m = int(np.searchsorted(t, t[0] + ttl, side="right")) if i == 0 else 1
            r_hi = min(m, n - 1)
            ends = t[e[:r_hi + 1]]
            # runs of equal chain ends over r; threshold of run starting at a is t[a-1]
            starts = [0] + [a for a in range(1, r_hi + 1) if ends[a] != ends[a - 1]]
            thr = [None if a == 0 else int(t[a - 1]) for a in starts]
            rows.append((pid, i, key, n, int(t[-1]), m == n, thr,
                         [int(ends[a]) for a in starts]))
        yield pd.DataFrame(rows, columns=["pid", "i", "key", "n", "tlast", "all_within",
                                          "thr", "end"])

    summ = s.mapInPandas(summarise, "pid int, i int, key string, n long, tlast long, "
                                    "all_within boolean, thr array<long>, end array<long>")
    rows = summ.orderBy("pid", "i").collect()   # at most two rows per partition
    state: dict[str, int | None] = {}
    carry: dict[tuple[int, str], int] = {}
    for r in rows:
        pid, key = r["pid"], r["key"]
        last = state.get(key) if r["i"] == 0 else None
        if r["i"] == 0 and last is not None:
            carry[(pid, key)] = last
        if last is None:
            state[key] = r["end"][0]
            continue
        x = last + ttl
        if r["all_within"] and r["tlast"] <= x:
            state[key] = last            # every row of the run is a hit
            continue
        k = 0
        for j, th in enumerate(r["thr"]):
            if th is None or th <= x:
                k = j
        state[key] = r["end"][k]
    bc = s.sparkSession.sparkContext.broadcast(carry)

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        cmap = bc.value
        cur_key, last = None, None
        for pdf in batches:
            outs = []
            for key, g in _runs(pdf, keys):
                if key != cur_key:
                    cur_key, last = key, cmap.get((pid, key))
                t = g["_t"].to_numpy(np.int64)
                hit = np.ones(len(t), dtype=bool)
                i = 0 if last is None else int(np.searchsorted(t, last + ttl, side="right"))
                nxt = np.searchsorted(t, t + ttl, side="right")
                while i < len(t):      # walk the misses only
                    hit[i] = False
                    last = int(t[i])
                    i = int(nxt[i])
                o = g[[*keys, id_col]].copy()
                o["hit"] = hit
                outs.append(o)
            if outs:
                yield pd.concat(outs)

    types = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] +
                       [f"{id_col} {types[id_col]}", "hit boolean"])
    return s.mapInPandas(evaluate, schema)


# ---------------------------------------------------------------------------
# lag over a hot key (counter deltas)
# ---------------------------------------------------------------------------

def lag_scan(df: DataFrame, keys: list[str], order: list[str], value: str,
             out: str = "prev", partitions: int | None = None) -> DataFrame:
    """Previous ``value`` of the same key in ``order`` (null for the first
    row), without a window partitioned by key: the carry is the key's last
    value in the previous partition."""
    s = range_sorted(df, keys, order, partitions)
    vtype = s.schema[value].dataType.simpleString()

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        last = {}
        for pdf in batches:
            for key, g in _runs(pdf, keys):
                last = {key: g[value].iloc[-1]}   # only the partition's last key matters
        rows = [(pid, k, None if pd.isna(v) else v) for k, v in last.items()]
        yield pd.DataFrame(rows, columns=["pid", "key", "last"])

    summ = s.mapInPandas(summarise, f"pid int, key string, last {vtype}")
    rows = summ.orderBy("pid").collect()          # one row per partition
    carry: dict[int, tuple[str, object]] = {}
    prev_key, prev_val = None, None
    for r in rows:
        carry[r["pid"]] = (prev_key, prev_val)
        prev_key, prev_val = r["key"], r["last"]
    bc = s.sparkSession.sparkContext.broadcast(carry)

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        ck, cv = bc.value.get(pid, (None, None))
        cur_key, cur_last = ck, cv
        for pdf in batches:
            outs = []
            for key, g in _runs(pdf, keys):
                p = g[value].shift(1)
                p.iloc[0] = cur_last if key == cur_key else None
                o = g.copy()
                o[out] = p
                outs.append(o)
                cur_key, cur_last = key, g[value].iloc[-1]
            if outs:
                yield pd.concat(outs)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in s.schema.fields] +
                       [f"{out} {vtype}"])
    return s.mapInPandas(evaluate, schema)
