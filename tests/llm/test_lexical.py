import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from larkspur.llm import lexical as L

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, top=10):
    """Every document against every item."""
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        found = []
        for d, c, n in held:
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, d is None, d))
        out += [(i, k, d, -s) for k, (s, _, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({L.ORACLE_SQL})").fetchall(), key=repr)
    have = got(L.query(spark, SF))
    assert have == want and len(have) >= 400


SCHEMA = "doc_id long, text string, rank int, item string, term string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], SCHEMA)


def test_cases_in_small_blocks_of_items(spark):
    words = "Alpha beta GAMMA delta épée 42 alpha-beta".split()
    rng = np.random.default_rng(3)
    docs = [(k, " ".join(rng.choice(words, rng.integers(0, 12)))) for k in range(300)]
    docs += [(7, docs[7][1])] * 40 + [(None, "alpha beta"), (400, None), (401, ""), (402, "?! -"),
                                      (403, "beta " * 200_000), (404, "alpha beta"), (405, "alpha beta")]
    items = [(1, "alpha beta"), (1, "Alpha BETA"), (2, "gamma, épée"), (2, "delta"), (3, None), (4, "..."),
             (None, "42 zzz"), (5, "zzz"), (6, " ".join(f"w{k}" for k in range(90)) + " alpha 42")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, score int")
    want = plain(docs, items)
    for block_terms in (L.BLOCK_TERMS, 4):
        assert got(L.search(docs_frame(spark, docs), frame, block_terms=block_terms)) == want
    assert {r[0] for r in want} == {1, 2, 6, None}
    assert got(L.search(docs_frame(spark, docs), frame, top=400)) == plain(docs, items, 400)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert got(L.search(docs_frame(spark, []), items)) == []
    assert got(L.search(docs_frame(spark, [(1, "a")]), items.limit(0))) == []
    assert got(L.search(docs_frame(spark, [(1, None)]), items)) == []


@pytest.mark.parametrize("k", [3, 64, 70])
def test_groups_by_mask_leave_out_no_document(k):
    rng = np.random.default_rng(k)
    tf = (rng.random((k, 3000)) < 0.2) * rng.integers(1, 9, (k, 3000)).astype(np.int32)
    tf[:, 1000:2000] = tf[:, :1]                        # a third of the documents is one group
    m = rng.integers(10, 4000, 3000)
    weight = rng.integers(0, 9000, k)
    first, at = L.masks(tf > 0)
    assert ((tf[:, first[at]] > 0) == (tf > 0)).all() and len(first) == len(np.unique(tf > 0, axis=1).T)
    best = L.Best(10)
    done = sum(L.search_block(best, tf[:, lo:lo + 500], m[lo:lo + 500], np.arange(lo, lo + 500), weight)
               for lo in range(0, 3000, 500))
    score = L.scores(tf, m, weight)
    order = np.lexsort((np.arange(3000), -score))[:10]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == score[order].tolist()
    assert k < 64 or done < 2000                        # most documents are never evaluated
