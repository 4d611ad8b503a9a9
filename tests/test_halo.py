import random

import pytest

from larkspur.operators import halo


@pytest.mark.parametrize("block_rows", [1, 4, 37, 100_000])
def test_trailing_mean_over_blocks(spark, block_rows):
    rnd = random.Random(8)
    rows = [(None if rnd.random() < 0.05 else rnd.choice(["hot", "hot", "hot", "a", "b"]), t, i,
             None if rnd.random() < 0.1 else rnd.randrange(50))
            for i, t in enumerate(rnd.choices(range(60), k=400))]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int").repartition(5)
    got = {r.i: r.m for r in halo.trailing_mean(df, ["k"], ["t", "i"], "v", 10, "m", block_rows).collect()}
    want, seen = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        seen.setdefault(k, []).append(v)
        last = [x for x in seen[k][-10:] if x is not None]
        want[i] = sum(last) / len(last) if last else None
    assert got == pytest.approx(want)


def test_numbers_of_repeated_rows(spark):
    df = spark.createDataFrame([("x", 1)] * 500 + [("y", k) for k in range(20)], "k string, t int")
    got = sorted((r._pos, r.k, r.t) for r in halo.numbered(df.repartition(7), ["k", "t"]).collect())
    assert [g[0] for g in got] == list(range(520)) and [g[1:] for g in got[500:]] == [("y", k) for k in range(20)]
