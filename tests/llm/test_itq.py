import numpy as np
import pytest

from larkspur.llm import itq as I


def brute(rows, limit=0.9):
    """{row number: (links, component)} and the number of links."""
    good = [(k, v, np.array(e, float)) for k, (v, e) in enumerate(rows)
            if v is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(np.array(e, float))]
    ids = {v for _, v, _ in good}
    up = {v: v for v in ids}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v
    links = dict.fromkeys(range(len(rows)), 0)
    x = [e / np.linalg.norm(e) for _, _, e in good]
    for p in range(len(good)):
        for q in range(p):
            if len(x[p]) == len(x[q]) and x[p] @ x[q] >= limit:
                links[good[p][0]] += 1
                links[good[q][0]] += 1
                a, b = root(good[p][1]), root(good[q][1])
                up[max(a, b)] = min(a, b)
    return sorted((v, links[k], root(v) if v in up else v) for k, (v, _) in enumerate(rows) if v is not None)


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in I.query(spark, sf).collect())
    want = brute(rows)
    assert len(got) == len(want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    found, true = sum(g[1] for g in got), sum(w[1] for w in want)
    print("recall", found / max(1, true), "links", true // 2)
    assert found >= 0.98 * true


def test_recall_at_the_limit(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)                     # many blocks per cell
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 32))
    rows = []
    for k in range(900):
        v = base[k % 40] + rng.standard_normal(32) * rng.choice([0.02, 0.15, 0.3, 2.0])
        rows.append((k, v.tolist()))
    rows += [(900 + k, rows[3][1]) for k in range(50)]      # a group of equal vectors
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in I.near_vectors(df).collect())
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]),
            (7, [2.0, 0.0]), (8, [1e200, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]),
            (11, []), (12, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in I.near_vectors(df).collect())
    assert got == [(0, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True),
                   (5, 0, 5, True), (6, 3, 6, True), (7, 3, 6, False), (8, 3, 6, False), (9, 0, 9, True),
                   (10, 0, 10, True), (11, 0, 11, True), (12, 3, 6, False)]
    assert I.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("share, exact", [(0.5, False), (0.7, False), (0.9, True)])
def test_recall_with_a_common_direction(spark, monkeypatch, share, exact):
    """Pairs at cosine 0.90-0.93 of vectors whose mean holds ``share`` of the squared norm."""
    monkeypatch.setattr(I, "BLOCK", 64)
    rng = np.random.default_rng(5)
    n, dim = 2400, 64
    z = rng.standard_normal((n, dim - 1))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    turn = rng.standard_normal((n // 4, dim - 1))
    own = z[:n // 4]
    turn -= own * (turn * own).sum(axis=1, keepdims=True)
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    c = 1 - (1 - rng.uniform(0.90, 0.93, (n // 4, 1))) / (1 - share)
    z = np.vstack([z, c * own + np.sqrt(1 - c ** 2) * turn])
    x = np.hstack([np.full((len(z), 1), share ** 0.5), (1 - share) ** 0.5 * z])
    codes = I.Codes(x[rng.permutation(len(x))], len(x))
    assert (codes.width == 0) == exact
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [r.n_links for r in I.near_vectors(df).orderBy("vec_id").collect()]
    want = near.sum(axis=1)
    assert all(g <= w for g, w in zip(got, want))
    assert sum(got) >= 0.95 * want.sum() > 0


def test_repeated_rows_of_one_id(spark):
    rows = [(6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in I.near_vectors(df).collect())
    assert got == [(6, 1, 6, True), (6, 1, 6, True), (7, 2, 6, False), (8, 0, 8, True), (8, 0, 8, True), (9, 0, 9, True)]
