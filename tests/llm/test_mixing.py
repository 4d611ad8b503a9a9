import math
import re
from collections import defaultdict

import pytest

from larkspur.llm import mixing as M

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0D]+")


def wanted(rows, weights=M.WEIGHTS, share=M.SHARE, cap=M.CAP):
    """Targets by sharing the excess again until nobody is above."""
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_ = {}, list(order)
    left = share * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > cap * size[s]]
        if not over:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in over:
            target[s] = cap * size[s]
            left -= target[s]
            open_.remove(s)
    return size, target


def check(rows, got, slack):
    size, target = wanted(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= slack
    return size, target


def test_query_meets_targets_and_tilts_by_size(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = M.query(spark, SF).collect()
    size, target = check(rows, got, 5)
    own = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    assert all(r.size == own[r.doc_id] for r in got)
    tilted = 0
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
    for s, docs in by_source.items():
        if not 0 < target[s] < 2 * size[s]:
            assert all(r.copies == 2 for r in docs if r.size)
            continue
        mean = size[s] / sum(r.size > 0 for r in docs)
        lo, hi = -1e4, 1e4                              # plain bisection for the multiplier
        for _ in range(200):
            lam = (lo + hi) / 2
            words = sum(r.size * math.exp(min(math.log(2), lam * r.size / mean)) for r in docs)
            lo, hi = (lam, hi) if words < target[s] else (lo, lam)
        for r in docs:
            if r.size:
                assert r.rate == pytest.approx(min(2, math.exp(min(1, lam * r.size / mean))), rel=1e-5, abs=1e-9)
                tilted += r.rate not in (0, 1, 2)
    assert tilted > 100
    again = M.query(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


SCHEMA = "doc_id long, text string, source string, key string, size string, part string, target string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", "y", "z", None) for d, t, s in rows], SCHEMA)


def test_nulls_repeats_empty_and_long_texts(spark):
    rows = ([(1, "a b\tc\x0bd", "b"), (1, "a b\tc\x0bd", "b"), (2, None, "b"), (3, "", ""), (4, " \n", None),
             (None, "one two", None), (5, "x " * 300_000, "a"), (6, "\x1cy z é", "\U0001F600")]
            + [(7, "same words here", "hot")] * 400 + [(k, "w " * (k % 30), "c") for k in range(10, 300)])
    docs = frame(spark, rows)
    got = M.mix(docs).collect()
    size, target = wanted(docs.collect())
    assert len(got) == len(rows)
    assert size["\U0001F600"] == 2 and size[""] == 0 and size[None] == 2
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert abs(taken["hot"] - target["hot"]) <= 3 and abs(taken["c"] - target["c"]) <= 1
    assert [r.taken for r in got if r.source == ""] == [0]
    assert {r.copies for r in got if r.source == "hot"} <= {0, 1, 2}


def test_no_rows_and_no_words(spark):
    assert M.mix(frame(spark, []).limit(0)).collect() == []
    got = M.mix(frame(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_other_weights_and_caps(spark):
    docs = frame(spark, [(k, "w " * (1 + k % 50), "ab"[k % 2]) for k in range(200)])
    got = M.mix(docs, weights=(1.0, 9.0), share=2.5, cap=4).collect()
    total = sum(r.size for r in got)
    words = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    target = {r.source: r.target for r in got}
    most = {r.source: 4 * r.source_size for r in got}
    assert target["b"] == most["b"] and target["a"] == pytest.approx(2.5 * total - most["b"])
    assert all(abs(words[s] - target[s]) <= 1 for s in "ab")
    assert all(r.copies <= 4 for r in got)
