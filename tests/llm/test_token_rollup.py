from collections import Counter

import pytest

from larkspur.llm import token_rollup as R

SF = "/root/testdata/sf0.01"


def count(text, version):
    return len(R._encoding(R.default_vocabulary(version)).encode_ordinary(text or ""))


def test_query_equals_recount(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    first = {}
    for r in rows:
        first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    docs, tokens = Counter(), Counter()
    for r in rows:
        if first[r.text] == r.doc_id:
            docs[r.source, r.lang, R.NEW] += 1
            tokens[r.source, r.lang, R.NEW] += count(r.text, R.NEW)
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in R.query(spark, SF).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}
    assert len(rows) > sum(docs.values())


def test_commits_are_idempotent(spark, tmp_path):
    store = R.RollupStore(spark, str(tmp_path))
    assert store.totals().count() == 0
    docs = spark.createDataFrame([(1, "a", "en", "one two", "x"), (2, "a", None, "three", "x"), (3, None, None, None, "x"),
                                  (4, "b", "en", "", "x"), (4, "b", "en", "", "x"), (5, "b", "en", "w " * 100_000, "x")],
                                 "doc_id long, source string, lang string, text string, docs string")
    both = R.token_counts(docs, {v: R.default_vocabulary(v) for v in (R.OLD, R.NEW)})
    assert store.commit("b1", R.signed(both, 1, R.OLD, R.OLD))
    before = sorted(map(tuple, store.totals().collect()), key=repr)
    assert not store.commit("b1", R.signed(both, 1, R.OLD, R.OLD))
    assert sorted(map(tuple, store.totals().collect()), key=repr) == before
    want = {("a", "en"): (1, count("one two", R.OLD)), ("a", None): (1, count("three", R.OLD)), (None, None): (1, 0),
            ("b", "en"): (3, count("w " * 100_000, R.OLD))}
    assert {(s, k): (d, t) for s, k, _, d, t in before} == want
    # a batch written but not committed is not seen, and its retry replaces it
    R._sum(R.signed(both, 1, "x", R.OLD)).write.parquet(f"{tmp_path}/batches/b2")
    assert sorted(map(tuple, store.totals().collect()), key=repr) == before
    store.compact()
    assert store.commit("b2", R.signed(both.where("source = 'a'"), -1, R.OLD, R.OLD))
    assert store.commit("b3", R.revised(both.where("source = 'b'"), R.OLD, R.NEW))
    assert not store.commit("b1", R.signed(both, 1, R.OLD, R.OLD))
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in store.totals().collect()}
    assert got == {(None, None, R.OLD): (1, 0), ("b", "en", R.NEW): (3, count("w " * 100_000, R.NEW))}
    store.compact()
    assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in store.totals().collect()} == got
    assert store.commit("empty", R.signed(both.limit(0), 1, R.OLD, R.OLD))
    with pytest.raises(ValueError):
        store.commit("../x", R.signed(both, 1, R.OLD, R.OLD))


def write_documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, digest string") \
        .write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_repeated_ids_and_empty_table_through_the_query(spark, tmp_path):
    a, b = "alpha beta gamma", "delta epsilon"
    rows = [(3, "s", "en", a, "x"), (5, "s", "en", a, "x"), (5, "s", "en", b, "x"), (None, "s", "en", b, None),
            (7, "s", "en", None, None), (8, "s", "en", None, None)]
    got = {tuple(r)[:3]: (r.docs, r.tokens) for r in R.query(spark, write_documents(spark, tmp_path / "a", rows)).collect()}
    # (5, A) repeats (3, A); (5, B) is another text of its id; a row without id repeats nothing
    assert got == {("s", "en", R.NEW): (5, count(a, R.NEW) + 2 * count(b, R.NEW))}
    assert R.query(spark, write_documents(spark, tmp_path / "b", [])).count() == 0


def test_batches_committed_during_compaction_count_once(spark, tmp_path):
    store = R.RollupStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "en", "v", 1, 10)], R.DELTA)
    store.commit("b1", rows)
    listed = store.committed

    def late():                                            # another writer commits after the listing
        ids = listed()
        store.committed = listed
        store.commit("b2", rows)
        return ids
    store.committed = late
    store.compact()
    assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(2, 20)]
    store.compact()
    assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(2, 20)]
