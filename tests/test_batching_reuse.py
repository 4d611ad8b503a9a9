import pytest
from pyspark.sql import functions as F

from larkspur.operators import batching, reuse


def _py_batches(rows, b, delay):
    out, cur, t0, no = {}, [], 0, 0
    for t, i in rows:
        if cur and t >= t0 + delay:
            for p, j in enumerate(cur):
                out[j] = (no, p + 1, "timeout")
            cur = []
        if not cur:
            no += 1
            t0 = t
        cur.append(i)
        if len(cur) >= b:
            for p, j in enumerate(cur):
                out[j] = (no, p + 1, "full")
            cur = []
    for p, j in enumerate(cur):
        out[j] = (no, p + 1, "shutdown")
    return out


def test_assign_batches_matches_python(spark):
    # equal timestamps, an arrival exactly at the deadline, a full batch
    rows = [(0, 1), (5, 2), (5, 3), (10, 4), (11, 5), (12, 6), (13, 7), (14, 8), (40, 9), (41, 10)]
    df = spark.createDataFrame([("u", t, i) for t, i in rows], "k string, t long, id long")
    got = {r["id"]: (r["batch_no"], r["pos"], r["reason"]) for r in
           batching.assign_batches(df, ["k"], ["t", "id"], "t", 4, 10, "id").collect()}
    assert got == _py_batches(rows, 4, 10)


def test_batch_stats_and_chunks(spark):
    rows = [("u", t, t) for t in range(10)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    a = batching.assign_batches(df, ["k"], ["t", "id"], "t", 4, 10 ** 9, "id").join(
        df.select("id", "t"), "id")
    st = {r["batch_no"]: (r["size"], r["reason"]) for r in
          batching.batch_stats(a, ["k"], "t").collect()}
    assert st == {1: (4, "full"), 2: (4, "full"), 3: (2, "shutdown")}
    ch = batching.chunk_batches(a, ["k", "batch_no"], ["pos"], 8)  # chunk size 2
    assert sorted((r["id"], r["chunk_index"]) for r in ch.collect())[:4] == [
        (0, 0), (1, 0), (2, 1), (3, 1)]


def _py_policy(depths, b, lo, hi):
    hist, d, out = [], lo, []
    for q in depths:
        hist.append(q)
        hist = hist[-10:]
        avg = sum(hist) / len(hist)
        target = hi if avg >= b else lo + avg / b * (hi - lo)
        d = d * 0.7 + target * 0.3
        out.append(max(lo, min(d, hi)))
    return out


@pytest.mark.parametrize("depths", [[2], [7] * 10, [32] * 20, [15] * 10 + [1], [0, 0, 0]])
def test_adaptive_delay_matches_policy(spark, depths):
    df = spark.createDataFrame([("g", i, q) for i, q in enumerate(depths)], "k string, t long, q int")
    got = [r["delay"] for r in batching.adaptive_delay(df, ["k"], ["t"], "q", 32, 0.1, 0.3)
           .orderBy("t").collect()]
    assert got == pytest.approx(_py_policy(depths, 32, 0.1, 0.3), abs=1e-12)


def test_adaptive_delay_long_history(spark):
    depths = [(i * 7) % 40 for i in range(300)]
    df = spark.createDataFrame([("g", i, q) for i, q in enumerate(depths)], "k string, t long, q int")
    got = [r["delay"] for r in batching.adaptive_delay(df, ["k"], ["t"], "q", 16, 0.01, 0.2)
           .orderBy("t").collect()]
    assert got == pytest.approx(_py_policy(depths, 16, 0.01, 0.2), abs=1e-12)


def test_reuse_ttl_rules(spark):
    # ttl 10: a hit does not renew; a gap exactly equal to the ttl is a hit
    rows = [("a", 0, 1), ("a", 10, 2), ("a", 15, 3), ("a", 21, 4), ("a", 31, 5), ("b", 5, 6)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    got = {r["id"]: r["hit"] for r in reuse.reuse_within_ttl(df, ["k"], ["t", "id"], "t", 10, "id")
           .collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}
    ratio = reuse.reuse_ratio(reuse.reuse_within_ttl(df, ["k"], ["t", "id"], "t", 10, "id"), ["k"])
    assert {r["k"]: (r["hits"], r["misses"]) for r in ratio.collect()} == {"a": (2, 3), "b": (0, 1)}


def test_lookup_or_compute(spark):
    store = spark.createDataFrame([("k1", "old")], "key string, answer string")
    req = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k2")], "id int, key string")
    calls = []

    def compute(m):
        calls.append(1)
        return m.select("key", F.concat(F.lit("new-"), "key").alias("answer"))

    res, fresh = reuse.lookup_or_compute(req, store, "key", compute, ["answer"])
    got = {r["id"]: (r["origin"], r["answer"]) for r in res.collect()}
    assert got == {1: ("hit", "old"), 2: ("miss", "new-k2"), 3: ("miss", "new-k2")}
    assert fresh.count() == 1  # k2 computed once


def test_adaptive_delay_scan_splits_hot_key(spark):
    from larkspur.operators import sequence
    hot = [("hot", i, (i * 13) % 50) for i in range(2500)]
    cold = [("c%d" % j, i, (i * 3 + j) % 40) for j in range(5) for i in range(30)]
    df = spark.createDataFrame(hot + cold, "k string, t long, q int").withColumn("id", F.col("t"))
    out = sequence.adaptive_delay_scan(df, ["k"], ["t"], "q", 16, 0.01, 0.2, "id", partitions=12)
    got = {}
    for r in out.collect():
        got.setdefault(r["k"], []).append((r["id"], r["delay"]))
    for k in ["hot", "c0", "c4"]:
        seq = [q for kk, _, q in sorted(hot + cold, key=lambda x: (x[0], x[1])) if kk == k]
        exp = _py_policy(seq, 16, 0.01, 0.2)
        assert [d for _, d in sorted(got[k])] == pytest.approx(exp, abs=1e-12)
    # the hot key really was cut into several partitions
    parts = sequence.range_sorted(df, ["k"], ["t"], 12).where(F.col("k") == "hot") \
        .select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 3


@pytest.mark.parametrize("b,delay", [(4, 10), (3, 1000), (8, 25)])
def test_assign_batches_scan_hot_key(spark, b, delay):
    from larkspur.operators import sequence
    import random
    rnd = random.Random(b * 7 + delay)
    rows, t = [], 0
    for i in range(1500):
        t += rnd.choice([0, 1, 2, 5, 9, 30])
        rows.append(("hot", t, i))
    for j in range(6):
        tt = 0
        for i in range(rnd.randint(1, 12)):
            tt += rnd.choice([0, 3, 11])
            rows.append(("k%d" % j, tt, 10000 + j * 100 + i))
    df = spark.createDataFrame(rows, "k string, t long, id long")
    got = {r["id"]: (r["batch_no"], r["pos"], r["reason"]) for r in
           sequence.assign_batches_scan(df, ["k"], ["t", "id"], "t", b, delay, "id",
                                        partitions=16).collect()}
    exp = {}
    for k in sorted({r[0] for r in rows}):
        exp.update(_py_batches(sorted((t, i) for kk, t, i in rows if kk == k), b, delay))
    assert got == exp


@pytest.mark.parametrize("ttl", [10, 1, 100])
def test_reuse_scan_hot_key(spark, ttl):
    from larkspur.operators import sequence
    import random
    rnd = random.Random(ttl)
    rows, t = [], 0
    for i in range(2000):
        t += rnd.choice([0, 1, 2, 4, 7, 13, 40])
        rows.append(("hot", t, i))
    for j in range(5):
        tt = 0
        for i in range(rnd.randint(1, 9)):
            tt += rnd.choice([0, 5, 11])
            rows.append(("k%d" % j, tt, 10000 + j * 100 + i))
    df = spark.createDataFrame(rows, "k string, t long, id long")
    got = {r["id"]: r["hit"] for r in sequence.reuse_within_ttl_scan(
        df, ["k"], ["t", "id"], "t", ttl, "id", partitions=16).collect()}
    exp = {}
    for k in sorted({r[0] for r in rows}):
        last = None
        for tt, i in sorted((tt, i) for kk, tt, i in rows if kk == k):
            if last is not None and tt - last <= ttl:
                exp[i] = True
            else:
                exp[i] = False
                last = tt
    assert got == exp
