import random
import re

import numpy as np
import pytest

from larkspur.llm import minhash as M
from larkspur.llm.common import connected_components

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))


def roots(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    index, links = {}, []
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    near = {(a, b) for group in index.values() for a in group for b in group if a < b}
    for a, b in near:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= percent * len(sets[a] | sets[b]):
            links.append((a, b))
    comp = roots(sets, links)
    return sorted((d, len(s), comp[d], comp[d] == d) for d, s in sets.items())


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, M.query(spark, SF).collect()))
    assert got == brute(rows)
    assert any(not r[3] for r in got)


def test_planted_groups(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for size, change in ((60, 0.0), (60, 0.006), (40, 0.012), (30, 0.017), (20, 0.03), (15, 0.05)):
        base = [f"w{rng.randrange(5000)}" for _ in range(220)]
        for _ in range(size):
            rows.append((n, " ".join(f"v{rng.randrange(9999)}" if rng.random() < change else w
                                     for w in base)))
            n += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, M.near_duplicates(docs).collect())) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"z{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (5, "one  TWO"),
            (None, "one two"), (6, long), (7, long + " end"), (8, "tie x"), (9, "tie y"),
            (10, "a b c d e f g"), (10, "other words are here for ten"), (11, "other words are here for ten")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_shingles int")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(docs).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
                   (None, 1, None, True), (6, 59_996, 6, True), (7, 59_997, 6, False), (8, 1, 8, True),
                   (9, 1, 9, True), (10, 3, 10, True), (10, 2, 10, True), (11, 2, 10, False)}
    kept = M.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9, 10, 10]
    assert M.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(80), 100 + rng.randrange(80))
                                               for _ in range(60)] + [(500, k) for k in range(501, 560)]
    edges += [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({i for e in real for i in e}, real)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:3000], rng.integers(0, 1 << 63, 1000).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((M.signature(a) == M.signature(b)).mean() - true) < 0.15
