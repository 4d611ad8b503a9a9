import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import collocations as C

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_count, top, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, ws[i:i + k]) for i in range(len(ws) - k + 1))
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= min_count}
    longer = {}
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = lang, p[i:i + k]
                longer[key] = max(longer.get(key, 0), a)
    out = {}
    for (lang, p), a in cand.items():
        if longer.get((lang, p), 0) >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, left, right))
    return sorted((lang, rank, p.decode(), a, left, right, n[lang], -s) for lang, found in out.items()
                  for rank, (s, _, p, a, left, right) in enumerate(sorted(found)[:top], 1))


def got(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({C.ORACLE_SQL})").fetchall())
    have = got(C.query(spark, SF))
    assert have == want and len(have) > 20


SCHEMA = "text string, lang string, id long, phrase string, a int"


def frame(spark, rows):
    return spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], SCHEMA)


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(12)] + ["Épée", "of", "THE", "\x1cx"]
    rows = []
    for _ in range(400):
        ws = [words[int(k)] for k in np.minimum(rng.zipf(1.4, rng.integers(1, 40)) - 1, 15)]
        seps = rng.choice([" ", "  ", "\t", ". ", ",", "\r\n"], len(ws), p=[.7, .1, .05, .05, .05, .05])
        rows.append(("".join(w + s for w, s in zip(ws, seps)), [None, "en", "und", "a\nb"][int(rng.integers(4))]))
    rows += [("in the middle of nowhere we are", "en")] * 150 + [("aa " * 30_000, "long")]
    return rows + [(None, "en"), ("", None), (" .\n!", "en"), ("lone", "xx")]


@pytest.mark.parametrize("top", [7, 100_000])
def test_equals_plain_count(spark, top):
    rows = corpus()
    assert got(C.collocations(frame(spark, rows), min_count=8, top=top)) == plain(rows, 8, top)


def test_shards_small_filters_and_blocks(spark):
    """Many filters per task and many quotient blocks give the same counts."""
    rows = corpus()
    docs = frame(spark, rows).repartition(7)
    words, seed = C.vocabulary(docs)
    ids = C.coded(docs, C.Sieve(words.where("f >= 8"), "id"), seed)
    want = {tuple(r.ids): r.a for r in C.count_phrases(ids, 2, None, 6, 8).collect()}
    assert len(want) > 30
    for bits in (1, 11, 20):
        assert {tuple(r.ids): r.a for r in C.count_phrases(ids, 2, None, bits, 8).collect()} == want
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 50, 5000).astype(np.uint64) for _ in range(3)]
    whole = C.QuotientFilter(3, 4)
    for k in range(9):                                     # nine shards, merged from their rows
        part = C.QuotientFilter(3, 4)
        for lo in range(k * 500, (k + 1) * 500 + (500 if k == 8 else 0), 100):
            part.add(C.permute([x[lo:lo + 100] for x in keys]))
            part.settle()
        out = part.rows().to_pydict()
        whole.read(out["quotient"], out["remainders"], [np.array(c) for c in out["counters"]])
    back = np.stack(C.unpermute(whole.keys), axis=1).tolist()
    assert dict(zip(map(tuple, back), whole.counts.tolist())) == Counter(zip(*(k.tolist() for k in keys)))


def test_words_of_one_hash_get_another_seed(spark):
    real = C.xxhash.xxh64_intdigest
    docs = frame(spark, [("a b c", "en")] * 3)

    def narrow(named, seed):                               # the first two seeds are no good
        import xxhash
        return xxhash.xxh64_intdigest(named, seed) if seed > 1 else seed and 77
    words, seed = C.vocabulary(docs, word_id=narrow)
    assert seed == 2 and {r.id % 2 ** 64 for r in words.collect()} == {real(b"en\n" + w, 2) for w in (b"a", b"b", b"c")}


def test_equal_first_blocks_are_told_apart():
    keys = [np.zeros(6, np.uint64), np.array([3, 1, 3, 2, 1, 3], np.uint64)]
    grouped, counts = C.group(keys, np.ones(6, np.int64))
    assert dict(zip(grouped[1].tolist(), counts.tolist())) == {1: 2, 2: 1, 3: 3}


def test_scores_beyond_64_bits(spark):
    numbers = [(3_000_000_000_000, 40_000_000_000_000, 5_000_000_000_000, 3_000_000_000_001), (100, 7, 100, 100)]
    rows = spark.createDataFrame(numbers, "a long, n long, l long, r long")
    have = [r.s for r in rows.select(C.collocation_score(*(F.col(c) for c in "anlr")).alias("s")).collect()]
    assert have == [1000 * a * n // (left * right) for a, n, left, right in numbers]


def test_empty_table(spark):
    assert C.collocations(frame(spark, []).limit(0)).collect() == []
    assert C.collocations(frame(spark, [("rare words", None)])).collect() == []
