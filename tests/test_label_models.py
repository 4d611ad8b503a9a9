import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from larkspur.operators import label_models as L, linear_text as X, scorers

SF1 = "/root/testdata/sf0.1"


def auc(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return np.mean([np.mean((p > np.array(neg)) + 0.5 * (p == np.array(neg))) for p in pos])


def test_pooled_shares_are_the_best_monotone_fit():
    rng = np.random.default_rng(2)
    for _ in range(40):
        bins = sorted(rng.choice(L.BINS, rng.integers(1, 12), replace=False).tolist())
        rows = [(b, int(n), int(rng.integers(0, n + 1))) for b, n in zip(bins, rng.integers(1, 9, len(bins)))]
        got = L.pooled_shares(rows)
        for i, (b, _, _) in enumerate(rows):              # the min-max formula
            want = max(min(sum(r[2] for r in rows[a:c + 1]) / sum(r[1] for r in rows[a:c + 1])
                           for c in range(i, len(rows))) for a in range(i + 1))
            assert got[b] == pytest.approx(want, abs=1e-12)
        assert got == sorted(got) and got[0] == got[bins[0]] and got[-1] == got[bins[-1]]
    assert L.pooled_shares([]) is None


@pytest.fixture(scope="module")
def labelled(spark):
    return E.catalog._labelled(spark, SF1)


def test_held_out_quality_and_calibration(spark, labelled):
    """Three parts: counts, calibration, and texts that neither has seen."""
    unseen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    models = L.fit_labels(labelled.where(~unseen), ("quality", "toxic"))
    test = labelled.where(unseen)
    rows = L.label_scores(test, "doc_id", "text", models).toDF("doc_id", "pq", "pt") \
        .join(test.select("doc_id", "quality", "toxic"), "doc_id").collect()
    for p, y, least in (("pq", "quality", 0.75), ("pt", "toxic", 0.6)):
        assert auc([(r[p], r[y]) for r in rows]) >= least
        # expected calibration error, and no worse than always saying the base rate
        cells = {}
        for r in rows:
            cells.setdefault(r[p], []).append(r[y])
        off = sum(abs(k - np.mean(v)) * len(v) for k, v in cells.items()) / len(rows)
        base = np.mean([r[y] for r in rows])
        brier = np.mean([(r[p] - r[y]) ** 2 for r in rows])
        print(p, "auc", auc([(r[p], r[y]) for r in rows]), "calibration error", off, "brier", brier,
              "of base rate", base * (1 - base))
        assert off < 0.06 and brier < base * (1 - base)
    raw = L.raw_scores(test, "doc_id", "text", models).collect()
    uncalibrated = {r.doc_id: 1 / (1 + np.exp(-np.clip(r.raw_toxic, -500, 500))) for r in raw}
    assert np.mean([(uncalibrated[r.doc_id] - r.toxic) ** 2 for r in rows]) \
        > np.mean([(r.pt - r.toxic) ** 2 for r in rows])


def test_odd_labels_and_texts(spark):
    rows = [(k, t, q, x) for k, (t, q, x) in enumerate([("good fine", 1, 0), ("bad", 0, 1), (None, 1, None), ("", None, 0)] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    models = L.fit_labels(df, ("quality", "toxic"))
    got = {r.doc_id: r for r in L.label_scores(df, "doc_id", "text", models).collect()}
    assert len(got) == len(rows) and all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in got.values())
    assert got[0].quality > got[1].quality and got[0].toxic < got[1].toxic
    none = L.fit_labels(df.limit(0), ("quality",))
    assert none.labels["quality"].shares is None
    assert L.label_scores(df.limit(1), "doc_id", "text", none).first().quality == 0.5


def test_linear_scorer_shipped_and_loaded_once_per_worker(spark, labelled):
    seen = labelled.where(~L.held_out("doc_id"))
    test = labelled.where(L.held_out("doc_id"))
    weights = X.train_elastic_net(seen)
    assert 50 < np.count_nonzero(weights[:X.DIM]) < X.DIM / 2         # the L1 part makes it sparse
    path = X.save_model(weights)
    loads = spark.sparkContext.accumulator(0)
    X.register_linear_scorer(spark, "linear_test", path, on_load=lambda: loads.add(1))
    try:
        docs = test.select("doc_id", "text").repartition(16).cache()
        got = {r.doc_id: r.p for r in scorers.score_batches(docs, "linear_test").collect()}
        first = loads.value
        again = {r.doc_id: r.p for r in scorers.score_batches(docs, "linear_test").collect()}
    finally:
        scorers.unregister_scorer("linear_test")
    assert got == again and len(got) == docs.count()
    assert 1 <= first <= 8                                            # 16 tasks, workers are reused
    rows = test.collect()
    for r in rows[:50]:
        f = X.features(r.text)
        z = weights[f].sum() / np.sqrt(max(1, len(f))) + weights[X.DIM]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -50, 50))), abs=1e-9)
    found = auc([(got[r.doc_id], r.quality) for r in rows])
    print("linear auc", found)
    assert found >= 0.8


def test_learned_lexicon_labels_texts(spark):
    df = spark.createDataFrame([(k, t, q) for k, (t, q) in enumerate([("lovely nice the", 1), ("awful the bad", 0)] * 30)],
                               "doc_id long, text string, quality int")
    w = X.train_elastic_net(df)
    lex = X.polarity_lexicon(df, w)
    polarity = {r.w: r.polarity for r in lex.collect()}
    assert polarity["lovely"] > 0 > polarity["awful"] and "the" not in polarity
    got = {r.doc_id: r.label for r in scorers.sentiment_label(df.where("doc_id < 2"), "doc_id", "text", lex).collect()}
    assert got == {0: "5 stars", 1: "1 star"}
    assert not X.train_elastic_net(df.where("quality = 1")).any()
