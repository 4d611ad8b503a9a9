import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF
from larkspur.streaming import ordered, streams

HOUR = 3_600_000_000


def plain(rows, ttl):
    """{id: hit} of (key, micros, id) rows taken in the order (micros, id)."""
    last, out = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        out[i] = k in last and t - last[k] <= ttl
        if not out[i]:
            last[k] = t
    return out


def test_reuse_over_many_batches_with_rows_out_of_order(spark, tmp_path):
    """Twelve files, rows up to two hours out of order across them, one hot key."""
    rng = np.random.default_rng(11)
    n = 900
    t = np.sort(rng.integers(0, 60 * HOUR, n)) // 1000 * 1000
    k = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 25, n))
    t[200:204], k[200:204] = t[200], 0                   # ties in time go by id
    arrival = np.argsort(t + rng.integers(0, 2 * HOUR, n), kind="stable")
    for j, part in enumerate(np.array_split(arrival, 12)):
        pdf = pd.DataFrame({"k": k[part], "event_id": part.astype("int64"), "t_us": t[part]})
        spark.createDataFrame(pdf, "k long, event_id long, t_us long").coalesce(1) \
            .write.parquet(str(tmp_path / "in" / f"part={j:02d}"))
    src = (spark.readStream.schema("k long, event_id long, t_us long, part int").option("maxFilesPerTrigger", 1)
           .parquet(str(tmp_path / "in")).withColumn("t", F.timestamp_micros("t_us")))
    out = ordered.stream_reuse_in_order(src, ["k"], "t", "t_us", "event_id", 5 * HOUR, "2 hours", HOUR // 2)
    got = {r.event_id: r.hit for r in spark.read.parquet(streams.run_to_sink(out, "ordered")).collect()}
    want = plain(list(zip(k.tolist(), t.tolist(), range(n))), 5 * HOUR)
    passed = t.max() - 2 * HOUR
    assert got == {i: h for i, h in want.items() if t[i] <= passed}
    assert len(got) > 800 and 0 < sum(got.values()) < len(got)


def test_judge_walks_misses():
    hit, last = ordered.judge(np.array([0, 5, 10, 11, 30]), None, 10)
    assert hit.tolist() == [False, True, True, False, False] and last == 30
    assert ordered.judge(np.array([], np.int64), 4, 10)[1] == 4


def test_every_key_is_computed_once(spark, tmp_path):
    rows = [(f"k{j % 7}", j, f"2024-01-01 {j // 60 % 24:02d}:{j % 60:02d}:00") for j in range(0, 1400, 10)]
    for b in range(5):
        spark.createDataFrame(rows[b * 28:(b + 1) * 28], "key string, id long, ts string") \
            .withColumn("t", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"part={b}"))
    src = spark.readStream.schema("key string, id long, ts string, t timestamp, part int") \
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    seen = spark.sparkContext.accumulator(0)

    def score(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pd.DataFrame({"key": pdf["key"], "answer": pdf["key"].str.upper()})

    def compute(rows):
        return rows.select("key").mapInPandas(score, "key string, answer string")
    path = ordered.stream_compute_once(src, "key", "t", "30 minutes", compute, ["answer"])
    got = spark.read.parquet(path).select("key", "answer").collect()
    assert sorted(map(tuple, got)) == [(f"k{j}", f"K{j}") for j in range(7)]
    assert seen.value == 7


def run_many_keys(spark, tmp_path, monkeypatch, make):
    """Rows of 400 keys, some null, over three files in time order; 16 buckets of state."""
    monkeypatch.setattr(streams, "KEY_BUCKETS", 16)
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(1, 50 * HOUR, 3000))
    rows = [(None if k == 0 else int(k), "ab"[int(k) % 2], (1 << 60) + i, int(m))
            for i, (k, m) in enumerate(zip(rng.integers(0, 400, 3000), t))]
    for j in range(3):
        spark.createDataFrame(rows[j * 1000:(j + 1) * 1000], "k long, s string, id long, t_us long").coalesce(1) \
            .write.parquet(str(tmp_path / "in" / f"part={j}"))
    src = spark.readStream.schema("k long, s string, id long, t_us long, part int").option("maxFilesPerTrigger", 1) \
        .parquet(str(tmp_path / "in")).withColumn("t", F.timestamp_micros("t_us"))
    q = make(src).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")) \
        .option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    streams.finish(q, 200)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 16
    return rows, spark.read.parquet(str(tmp_path / "out")).collect()


def test_reuse_keeps_one_state_for_many_keys(spark, tmp_path, monkeypatch):
    rows, got = run_many_keys(spark, tmp_path, monkeypatch, lambda src: streams.stream_reuse_within_ttl(
        src, ["k", "s"], "t", "t_us", "id", 6 * HOUR, "1 hour"))
    want = plain([((k, s), t, i) for k, s, i, t in rows], 6 * HOUR)
    assert {r.id: r.hit for r in got} == want and len(got) == len(rows)
    assert {(r.id, r.k, r.s) for r in got} == {(i, k, s) for k, s, i, _ in rows}


def test_batches_keep_one_state_for_many_keys(spark, tmp_path, monkeypatch):
    rows, got = run_many_keys(spark, tmp_path, monkeypatch, lambda src: streams.stream_batches(
        src, ["k", "s"], "t", "t_us", "id", 3, 9 * HOUR, "1 hour"))
    want, open_, number = {}, {}, {}
    for k, s, i, t in rows:
        if open_.get((k, s)) and t >= open_[k, s][0][1] + 9 * HOUR:
            want |= {j: (k, s, number[k, s], p + 1, "timeout") for p, (j, _) in enumerate(open_.pop((k, s)))}
        if not open_.get((k, s)):
            open_[k, s], number[k, s] = [], number.get((k, s), 0) + 1
        open_[k, s].append((i, t))
        if len(open_[k, s]) == 3:
            want |= {j: (k, s, number[k, s], p + 1, "full") for p, (j, _) in enumerate(open_.pop((k, s)))}
    passed = (rows[-1][3] // 1000 - 3_600_000) * 1000
    for (k, s), batch in open_.items():
        if (batch[0][1] + 9 * HOUR) // 1000 < passed // 1000:
            want |= {j: (k, s, number[k, s], p + 1, "timeout") for p, (j, _) in enumerate(batch)}
    assert {r.id: (r.k, r.s, r.batch_no, r.pos, r.reason) for r in got} == want and len(got) == len(want)
    assert {r.reason for r in got} == {"full", "timeout"}


@pytest.mark.parametrize("name", ["stream_reuse_in_order", "stream_compute_once"])
def test_registered_streams_equal_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    df = E.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({E.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 100


def test_ordered_reuse_runs_where_the_package_is_on_the_drivers_path_only(tmp_path):
    """The process in which Spark first loads the state processor cannot import the package."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, sys.argv[1])\n"
            "from larkspur.session import get_spark\n"
            "import __spark_entry__ as E\n"
            "spark = get_spark('local[2]', shuffle_partitions=2, driver_memory='1g')\n"
            "print('ROWS', E.queries()['stream_reuse_in_order'](spark, sys.argv[2]).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, repo, SF], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("ROWS")[1]) > 100


def test_ordered_reuse_runs_where_the_session_keeps_state_elsewhere(spark):
    """It needs RocksDB, which only ``get_spark`` sets; the session's own setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own, hdfs = spark.conf.get(name), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    try:
        for other in (hdfs, None):
            spark.conf.set(name, other) if other else spark.conf.unset(name)
            assert E.queries()["stream_reuse_in_order"](spark, SF).count() > 100
            assert spark.conf.getAll.get(name) == other
    finally:
        spark.conf.set(name, own)


def test_ordered_reuse_keeps_few_states_for_odd_keys(spark, tmp_path, monkeypatch):
    """Null keys, ids and times, repeated rows, ids that no double holds; a row exactly at the final
    watermark, and one that comes last but is due at once.  State is per bucket and slot, not per key."""
    monkeypatch.setattr(ordered, "ORDERED_BUCKETS", 4)
    monkeypatch.setattr(ordered, "_STATE_ROWS", 100)
    rng = np.random.default_rng(5)
    n, end = 1500, 60 * HOUR
    t = np.sort(rng.integers(HOUR, end, n))
    t[-1] = end
    rows = [(None if k == 0 else int(k), "ab"[int(k) % 2] if k % 7 else None, (1 << 60) + i, int(m))
            for i, (k, m) in enumerate(zip(rng.integers(0, 500, n), t))]
    rows[5] = (*rows[5][:2], None, rows[5][3])
    rows[700:700] = [rows[699]] * 3
    arrival = sorted(range(len(rows)), key=lambda i: rows[i][3] + int(rng.integers(0, HOUR)))
    files = [[rows[i] for i in part] for part in np.array_split(arrival, 4)]
    files[1] += [(3, "b", 7, None), (None, None, 8, None)]                   # no time: never passed
    files[3] += [(901, "a", 9, end - 2 * HOUR)]                              # at the final watermark
    files.append([(902, "a", 10, end - 2 * HOUR - 1), (902, "a", 11, end - 2 * HOUR)])
    for j, part in enumerate(files):
        spark.createDataFrame(part, "k long, s string, id long, t_us long").coalesce(1) \
            .write.parquet(str(tmp_path / "in" / f"part={j}"))
    src = spark.readStream.schema("k long, s string, id long, t_us long, part int").option("maxFilesPerTrigger", 1) \
        .parquet(str(tmp_path / "in")).withColumn("t", F.timestamp_micros("t_us"))
    out = ordered.stream_reuse_in_order(src, ["k", "s"], "t", "t_us", "id", 20 * HOUR, "2 hours", 6 * HOUR)
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")) \
        .option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    streams.finish(q, 200)
    last, want = {}, []
    for k, s, i, m in sorted((r for part in files for r in part if r[3] is not None),
                             key=lambda r: (r[3], r[2] is None, r[2] or 0)):
        hit = (k, s) in last and m - last[k, s] <= 20 * HOUR
        if not hit:
            last[k, s] = m
        if m <= end - 2 * HOUR:
            want.append((k, s, i, hit))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "s", "id", "hit").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {9, 10, 11, None} <= {r[2] for r in got} and {r[3] for r in got} == {True, False}
    # a part a slot, time and flush, the two values and the timers of a bucket; over 800 keys wait
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < 200 < len({r[:2] for r in rows})


def test_rows_of_many_keys_are_judged_as_key_by_key():
    rng = np.random.default_rng(2)
    t, k = np.sort(rng.integers(0, 500, 400)), rng.integers(0, 20, 400)
    last = {(3,): -5}
    hit = np.array(ordered.judge_in_turn(t.tolist(), [(int(j),) for j in k], last, 40))
    for j in range(20):
        want, miss = ordered.judge(t[k == j], -5 if j == 3 else None, 40)
        assert hit[k == j].tolist() == want.tolist() and last[j,] == miss
