import numpy as np
import pytest

from larkspur.operators import fetch, knn

DOCS = [(1, "Test Doc 1", "This is test content 1", "test"),
        (2, "Test Doc 2", "This is test content 2", "test"),
        (3, "Long Title", "A" * 1000, "test")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, content string, category string")


def _ids(spark, rows):
    return spark.createDataFrame(rows, "request_id string, doc_ids array<long>")


def test_fetch_order_duplicates_missing(spark, docs):
    req = _ids(spark, [("a", [2, 1, 2]), ("b", []), ("c", [999, 1000]), ("d", [3])])
    got = {r["request_id"]: [d["doc_id"] for d in r["docs"]]
           for r in fetch.fetch_documents(req, docs).collect()}
    assert got == {"a": [2, 1, 2], "b": [], "c": [], "d": [3]}


def test_fetch_truncates(spark, docs):
    req = _ids(spark, [("d", [3])])
    r = fetch.fetch_documents(req, docs, truncate=100).first()
    assert len(r["docs"][0]["content"]) == 100


def test_scores_pair_by_key(spark, docs):
    req = spark.createDataFrame([("a", [1, 999, 2], [0.1, 0.2, 0.3])],
                                "request_id string, doc_ids array<long>, scores array<double>")
    r = fetch.fetch_documents(req, docs, scores_col="scores").first()
    assert [(d["doc_id"], d["score"]) for d in r["docs"]] == [(1, 0.1), (2, 0.3)]


def test_docs_in_id_set(spark, docs):
    ids = spark.createDataFrame([(1,), (1,), (3,), (7,)], "doc_id long")
    assert sorted(r[0] for r in fetch.docs_in_id_set(docs, ids).select("doc_id").collect()) == [1, 3]


def _brute(q, x, qids, xids, k):
    out = {}
    for qi, qv in zip(qids, q):
        d = ((x.astype(np.float64) - qv.astype(np.float64)) ** 2).sum(1)
        order = sorted(range(len(xids)), key=lambda j: (d[j], xids[j]))[:k]
        out[qi] = [(xids[j], d[j]) for j in order]
    return out


@pytest.mark.parametrize("limit", [64 * 1024 * 1024, 256])
def test_knn_exact_matches_brute_force(spark, limit):
    rng = np.random.default_rng(42)
    x = rng.random((60, 8)).astype(np.float32)
    x[7] = x[3]  # exact duplicate: tie broken by id
    q = x[:9]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                   "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)],
                                    "query_id long, embedding array<float>")
    got = knn.knn_exact(queries, corpus, k=5, broadcast_limit=limit, block_rows=7).collect()
    exp = _brute(q, x, list(range(9)), list(range(60)), 5)
    by_q = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_q.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"]))
    for qi, lst in exp.items():
        assert [v for v, _ in by_q[qi]] == [v for v, _ in lst]
        assert np.allclose([d for _, d in by_q[qi]], [d for _, d in lst], atol=1e-9)


def test_ivf_full_probe_equals_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6)).astype(np.float32)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                   "vec_id long, embedding array<float>")
    q = corpus.withColumnRenamed("vec_id", "query_id")
    exact = {(r[0], r[1], r[2]) for r in knn.knn_exact(q, corpus, k=4).select(
        "query_id", "rank", "vec_id").collect()}
    assigned, cents = knn.build_ivf(corpus, nlist=5, seed=3)
    ivf = {(r[0], r[1], r[2]) for r in knn.knn_ivf(q, assigned, cents, nprobe=5, k=4,
                                                    block_rows=10).select(
        "query_id", "rank", "vec_id").collect()}
    assert ivf == exact
    part = knn.knn_ivf(q, assigned, cents, nprobe=2, k=4).count()
    assert part <= 80 * 4
    st = knn.index_stats(assigned, 5, 2).first()
    assert st["n_vectors"] == 80 and st["probed_pct"] == 40.0


def test_probes_of_centroids_in_parts(spark):
    rng = np.random.default_rng(9)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)))],
                                   "vec_id long, embedding array<double>")
    q = corpus.withColumnRenamed("vec_id", "query_id")
    _, cents = knn.build_ivf(corpus, nlist=12, seed=3)
    whole, parts = ({(r.query_id, r.cell) for r in knn.probe_cells(q, cents, 4, broadcast_limit=b).collect()}
                    for b in (1 << 20, 100))
    assert whole == parts and len(whole) == 90 * 4


def test_odd_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [float("nan"), 0.0]), (3, [1.0, 1.0]), (4, None)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([("a", [0.0, 0.0])], "query_id string, embedding array<double>")
    assert [r.vec_id for r in knn.knn_exact(q, corpus, k=5).orderBy("rank").collect()] == [1, 3]
    with pytest.raises(Exception, match="other than 2 components"):
        knn.knn_exact(q, corpus.union(spark.createDataFrame([(5, [1.0])], corpus.schema)), k=5).collect()


def test_search_holds_few_numbers_a_query():
    """Neither the neighbours' vectors nor all differences are in memory at once."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(20000, 64)), rng.normal(size=(2000, 64))
    top = knn._TopK(q, 10)
    tracemalloc.start()
    top.add(np.arange(1000), x[:1000])
    top.add(np.arange(1000, 2000), x[1000:])
    got = [(r["query_id"], r["vec_id"]) for b in top.results(pa.array(np.arange(20000))) for r in b.slice(0, 10).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000                             # the vectors of the neighbours alone: 102 MB
    for j in {a for a, _ in got}:
        d = ((q[j] - x) ** 2).sum(1)
        assert [v for a, v in got if a == j] == np.argsort(d)[:10].tolist()
