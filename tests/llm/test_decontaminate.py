import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import decontaminate as D

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window=10):
    out = []
    coded = [(i, WORD.findall((t or "").translate(FOLD))) for i, t in items]
    wins = {}
    for i, w in coded:
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + window]), set()).add(i)
    sizes = {len(w) for w in wins}
    for d, t in docs:
        w = WORD.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = wins.get(tuple(w[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids),
                    hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_query_matches_brute_force(spark):
    got = sorted(map(tuple, D.query(spark, SF).collect()), key=repr)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    want = brute(docs, items)
    assert got == want
    assert any(r[5] for r in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=6),
       st.lists(st.sampled_from("abcd"), max_size=40))
def test_automaton_matches_brute_force(items, doc):
    items = list(enumerate(" ".join(i) for i in items))
    auto = D.ItemAutomaton([(i, D.split_words(t)) for i, t in items], window=3)
    words = D.split_words(" ".join(doc))
    flag, found, longest = auto.scan(words)
    want = brute([(0, " ".join(doc))], items, window=3)[0]
    assert (int(flag.sum()), len(found)) == (want[2], want[3])
    if auto.shortest == 1:
        texts = [t for _, t in items]
        assert longest == max((n for n in range(len(doc) + 1) for k in range(len(doc) - n + 1)
                               if any(" ".join(doc[k:k + n]) in t for t in texts)), default=0)


EDGE_ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"),
              (2, "short item"), (None, "null owner words"), (4, None), (5, ""), (6, "...")]
EDGE_DOCS = [(1, None), (2, ""), (3, "..!"), (4, "SHORT, item"), (4, "SHORT, item"),
             (None, "a null owner words b"),
             (7, "start one two three four five six seven eight nine ten end " + "x " * 50_000)]


@pytest.mark.parametrize("block_words", [10_000, 4])
def test_edge_rows_and_blocks(spark, block_words):
    docs = spark.createDataFrame([(*d, "h") for d in EDGE_DOCS], "doc_id long, text string, hits string")
    items = spark.createDataFrame(EDGE_ITEMS, "item_id long, text string")
    rows = D.mark(docs, items, block_words=block_words).collect()
    got = sorted(((r.doc_id, r.n_words, sum(r.hits[1::2]) - sum(r.hits[::2]), sorted(r.item_ids))
                  for r in rows), key=repr)
    want = sorted([(1, 0, 0, []), (2, 0, 0, []), (3, 0, 0, []), (4, 2, 2, [2]), (4, 2, 2, [2]),
                   (None, 5, 3, []), (7, 50_012, 10, [1])], key=repr)
    assert got == want
    cut = {(r.doc_id, r.text if r.text is None else r.text[:12]) for r in
           D.remove_spans(docs, items, block_words=block_words, max_coverage=0.7).collect()}
    assert cut == {(1, None), (2, ""), (3, "..!"), (None, "a b"), (7, "start end x ")}


def test_cut_does_not_depend_on_the_blocks(spark):
    """Overlapping windows and coverage split over blocks, and text joined over a cut."""
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(words[k:k + 10])) for k in range(0, 40, 4)]
    items.append((90, " ".join(words[50:55] + words[40:45])))
    docs = [(1, "a b " + " ".join(words[:14]) + " c d " + "x " * 30),
            (2, " ".join(words[:10]) + " x" * 13 + " " + " ".join(words[16:26]) + " y" * 4),
            (3, " ".join(words[50:55]) + " " + " ".join(words[:10]) + " " + " ".join(words[40:45]) + " z" * 20),
            (4, None), (5, "")]
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(*d, "h") for d in docs], "doc_id long, text string, hits string")
    assert len(D.item_blocks(items, block_words=8)) > 5
    one, many = (sorted(map(tuple, D.remove_spans(docs, items, block_words=n).collect())) for n in (10_000, 8))
    assert one == many
    assert [(r[0], len(D.split_words(r[1]))) for r in one] == [(1, 34), (3, 30), (4, 0), (5, 0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in D.mark(docs, items).collect()] == [(1, 2, 0, [], [])]
    assert D.remove_spans(docs, items).collect()[0].text == "some text"
    assert D.mark(docs.limit(0), items).count() == 0


def test_random_cuts_keep_the_rest():
    rng = random.Random(1)
    item = " ".join(f"w{k}" for k in range(15))
    auto = D.ItemAutomaton([(1, D.split_words(item))])
    for _ in range(20):
        a, b = ([f"x{rng.randrange(99)}" for _ in range(rng.randrange(1, 30))] for _ in "ab")
        text = " ".join(a) + " " + item + ". " + " ".join(b)
        cut = D.clean_text(text, auto, 0.99)
        assert D.split_words(cut) == D.split_words(" ".join(a + b))
