import hashlib
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import secret_scan as S

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def digest(spans):
    return hashlib.sha256(",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = S.query(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, x, _ in want) for k in range(3)]
        assert r.base_sha256 == digest(want)
        listed = [x for x in r.spans.split(",") if x and not x.startswith("guess")]
        assert listed == [f"{S.KINDS[k]}:{s}:{e}" for s, k, e in want]
    assert sum(r.n_assign + r.n_hex for r in rows) > 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "apikey", "API_KEY", "=", ":", " ", '"', "AKIA", "ABCDEF12",
                                 "deadbeef", "0123456789", "é", "\u212a", "secret=", "x.y/z", "\n"]), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    assert [(s, k, e) for s, k, e, _ in S.find_spans(text) if k < 3] == base(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aq1w2!9P", max_size=8))
def test_guess_cost_is_the_best_segmentation(value):
    cheap = {}
    for a, b, c in S._segments(value):
        cheap[a, b] = min(c, cheap.get((a, b), 99))
    best = 0.0 if not value else 1e9
    for cuts in itertools.product((0, 1), repeat=max(0, len(value) - 1)):
        at = [0, *(k for k, c in enumerate(cuts, 1) if c), len(value)]
        cost = sum(min(cheap.get(p, 1e9), sum(map(S._char_cost, value[p[0]:p[1]])))
                   for p in itertools.pairwise(at) if p[0] < p[1])
        best = min(best, cost + S._SEGMENT * (len(at) - 2))
    assert S.guess_cost(value) == pytest.approx(best)


@pytest.mark.parametrize("weak, strong", [("hunter2", "x9$Lq2!vT"), ("password123", "rT7#kW2pQz"),
                                          ("qwertyuiop", "q8Zt!4mNc"), ("19840321", "8f!Kd92xQ"),
                                          ("abcabcabc", "aB3$xY9!k"), ("requirements", "zQ4&hT8*w")])
def test_cost_separates(weak, strong):
    assert S.guess_cost(weak) < S.MIN_COST <= S.guess_cost(strong)
    assert not S.find_spans(f"the password is {weak}, ok")
    assert [k for _, k, _, _ in S.find_spans(f"the password is {strong}, ok")] == [3]


@pytest.mark.parametrize("name", ["secret_key", "SECRET-KEY", "token_id", "password_2", "aws_secret_access_key"])
def test_context_names_take_suffixes(name):
    text = f"{name} = x9$Lq2!vTzz8 end"
    assert S.mask(text) == f"{name} = {S.MASK} end"
    assert S.mask(f"{name}=wJalrXUtnFEMI/K7MDENG end") == f"{name}={S.MASK} end"


def test_edge_rows_and_redaction(spark):
    long = "word " * 100_000 + "token = 0123456789abcdef0123"
    rows = [(1, None), (2, ""), (3, "api_key: 'ABCDEFGHIJKL12'"), (3, "api_key: 'ABCDEFGHIJKL12'"),
            (None, "db postgres://me:s3cr!tZ9x@host/x"), (5, long), (6, "plain text")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = sorted(((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.n_guess) for r in S.scan(docs).collect()))
    assert got == [(0, 0, 0, 0, 1), (1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 1, 0, 0, 0), (3, 1, 0, 0, 0),
                   (5, 1, 0, 1, 0), (6, 0, 0, 0, 0)]
    clean = S.redact(docs)
    assert clean.schema == docs.schema
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts == {1: None, 2: "", 3: "api_key: '[SECRET]'", None: "db postgres://me:[SECRET]@host/x",
                     5: "word " * 100_000 + "token = [SECRET]", 6: "plain text"}
    assert S.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("value", ["qzxvkjwmtrbl", "Qzxvkjwmtrbl", "vkqxjzwp"])
def test_letters_that_are_no_words_are_secrets(value):
    assert S.guess_cost(value) >= S.MIN_COST
    assert S.mask(f"pwd={value} end") == f"pwd={S.MASK} end"


def test_long_values_take_no_time():
    import random
    import time
    rnd = random.Random(1)
    n = 1_000_000
    for value, secret in (("$" * n, False), ("xy" * (n // 2), None), ("qwertyuiop" * (n // 10), None),
                          ("the" * (n // 3), None), ("".join(rnd.choices("aQ1$w!", k=n)), True),
                          ("correcthorse" * (n // 12), None)):
        began = time.perf_counter()
        spans = S.find_spans("pwd=" + value)
        assert time.perf_counter() - began < 1
        assert secret is None or bool(spans) == secret


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abqw12$", max_size=24), st.floats(1, 12))
def test_threshold_cuts_nothing_below_it(value, enough):
    assert S.guess_cost(value, enough) == pytest.approx(min(enough, S.guess_cost(value)))
