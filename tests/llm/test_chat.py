import random

from larkspur.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or "", r, x))
    seqs = {c: [(m[-2], m[-1]) for m in sorted(v, key=lambda m: m[:6])] for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values()):
            continue
        same = [k for k, o in seqs.items() if o == s]
        if c == min((k for k in same if k is not None), default=None):
            out[c] = ("".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for r, x in s), len(s), len(same))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    parts = sorted(chat.format_chats(df).collect(), key=lambda r: (r.conv_id or -1, r.part))
    out = {}
    for r in parts:
        text, _, _ = out.get(r.conv_id, ("", 0, 0))
        out[r.conv_id] = (text + r.text, r.n_turns, r.n_copies)
    return out


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 3)
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(12):
        turns = [(rng.choice("ua"), f"t{rng.randrange(3)}") for _ in range(rng.randrange(1, 11))]
        for cut in {*(rng.randrange(1, len(turns) + 1) for _ in range(4)), len(turns)}:
            rows += [(n, k, *t) for k, t in enumerate(turns[:cut])]
            n += 1
    assert run(spark, rows) == brute(rows)
    assert len(brute(rows)) < n


def test_edge_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (2, 0, "user", "a"), (2, 1, "", ""),
            (3, 0, "user", "a"), (None, 0, "user", "z"), (4, None, "system", "s"), (4, 0, "user", "b"),
            (5, 7, "user", "tie2"), (5, 7, "user", "tie1"), (6, 0, "user", "x" * 500_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}


def test_long_conversation_is_cut_into_parts(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(300)] + [(2, k, "user", f"t{k}") for k in range(299)]
    got = run(spark, rows)
    assert got == brute(rows) and list(got) == [1]


def test_equal_and_null_turns_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 8)
    rows = [(1, 3, "user", f"t{k:03d}") for k in range(100)] + [(2, None, "user", f"t{k:03d}") for k in range(90)]
    rows += [(None, k % 2, None, f"n{k}") for k in range(70)] + [(3, 1 << 60, "user", "far"), (3, -5, "user", "before")]
    got = run(spark, rows)
    assert got == {k: v for k, v in brute(rows).items()} | {k: v for k, v in got.items() if k is None}
    assert got[None][1] == 70 and 2 not in got
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    numbered = chat.numbered_turns(df)
    assert numbered.groupBy("conv", "block").count().agg({"count": "max"}).first()[0] <= 8
    assert chat.format_chats(df).where("conv_id = 1").count() == 13
