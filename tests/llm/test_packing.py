import zlib

import numpy as np
import pytest

from larkspur.llm import packing as P

SF = "/root/testdata/sf0.01"


def check_plan(sizes, counts, plan, capacity):
    used = {}
    for config, n in plan:
        assert n > 0 and 0 < sum(config) <= capacity
        for x in config:
            used[x] = used.get(x, 0) + n
    assert used == {int(s): int(c) for s, c in zip(sizes, counts)}
    return sum(n for _, n in plan)


def first_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        for k, r in enumerate(rooms):
            if r >= x:
                rooms[k] -= x
                break
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed, low, high, n", [(1, 1, 4096, 1500), (2, 1300, 2100, 1200), (3, 1, 300, 3000),
                                                (4, 2000, 2100, 300), (5, 900, 1400, 1500)])
def test_solver_beats_first_fit(seed, low, high, n):
    lengths = np.random.default_rng(seed).integers(low, high, n)
    sizes, counts = np.unique(lengths, return_counts=True)
    used = check_plan(sizes, counts, P.solve(sizes, counts, 4096), 4096)
    assert -(-int(lengths.sum()) // 4096) <= used <= first_fit(lengths.tolist(), 4096)


@pytest.mark.parametrize("sizes, counts, capacity, best", [([], [], 8, 0), ([8], [3], 8, 3), ([3], [7], 8, 4),
                                                           ([3, 5], [9, 9], 8, 9), ([2, 3, 4], [2, 2, 2], 9, 2)])
def test_solver_small(sizes, counts, capacity, best):
    assert check_plan(sizes, counts, P.solve(np.array(sizes), np.array(counts), capacity), capacity) == best


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer
    own, ref = P.WordEncoder(P.default_tokenizer()), Tokenizer.from_file(P.default_tokenizer())
    texts = ["", " ", "It's 'start !!'s don't\x1c a\xa0b ÀÉ ß ¼²³ 12345 x1y2 ... d'été 'll''d", "''s", "I'M HERE'S",
             "naïve café ΣΑΣ 日本 <|endoftext|> tail", "\x85\x0b\x00\x7f", "ÿÞ×÷ªº", "a" * 3000]
    import pyarrow.dataset as ds
    texts += [t for t in ds.dataset(f"{SF}/documents.parquet").to_table()["text"].to_pylist()[:300] if t]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids, t[:60]


def check_rows(rows, texts, capacity):
    from tokenizers import Tokenizer
    ref = Tokenizer.from_file(P.default_tokenizer())
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = [*ref.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // capacity)))
        for r in parts:
            own = np.array(ids[r.start:r.start + r.length], "<u4")
            assert r.start == r.piece * capacity and len(own) == r.length == min(capacity, len(ids) - r.start)
            assert zlib.crc32(own.tobytes()) == r.ids_crc32
    return len(by_seq)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = P.query(spark, SF).collect()
    n = check_rows(rows, texts, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) * 1.01 + 1


def test_edge_rows_and_ids(spark):
    texts = {1: None, 2: "", 3: "one two three", 4: "word " * 9000, 5: "tie", 6: "tie"}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, length int")
    packed = P.pack_documents(docs, capacity=64, with_ids=True)
    rows = packed.collect()
    check_rows(rows, texts, 64)
    whole = {r.sequence_id: r.ids for r in P.packed_sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    again = docs.union(docs).union(spark.createDataFrame([(None, "no id", 0)], docs.schema))
    rows = P.pack_documents(again, capacity=64).collect()
    assert len(rows) == len({(r.sequence_id, r.offset) for r in rows})
    assert sum(r.doc_id is None for r in rows) == 1
    assert P.pack_documents(docs.limit(0)).count() == 0
