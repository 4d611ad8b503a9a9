"""Benchmark decontamination: a generalised suffix automaton over the
normalised test items is streamed along every training text; spans whose match
length or coverage passes a limit are removed.

Normalisation: A-Z lower-cased, words are runs of digits, letters a-z and
anything outside ASCII.  The automaton (states with suffix links, one
transition map per state, word ids as symbols) keeps the longest match ending
at each word.  A *window* is any ``window`` consecutive words of an item; an
item with fewer words (but at least one) is one window as a whole.

Scale: the text table is only mapped, never shuffled.  Items are packed into
blocks of at most ``BLOCK_WORDS`` words; one automaton per block is built in
each worker from the broadcast block, so what is broadcast has a fixed bound
and a larger test set simply takes more blocks.

Defined cases: null or empty text has no words and is returned unchanged;
null or wordless items match nothing; repeated items and repeated rows give
the same marks; a null item_id marks words but is not listed; no items leave
everything untouched; further columns are carried along as they are.
"""

from __future__ import annotations

import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import free_name, map_batches, open_table, replace_column

WINDOW = 10
MAX_COVERAGE = 0.5
#: Words of test items in one broadcast block (about 40 MB of automaton).
BLOCK_WORDS = 200_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split_words(text: str | None) -> list[bytes]:
    """Normalised words of a text as UTF-8 bytes."""
    return text.encode().translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of all items, each inserted from the root.

    ``long_items[s]`` lists the items having the ``window``-word suffix of
    state ``s``; ``short[s]`` lists (length, items) of whole short items that
    end in ``s`` or one of its suffixes."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = array("i", [-1])
        self.length = array("i", [0])
        coded = []
        for item, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((item, ids))
                self._insert(ids)
        self.shortest = min([window, *(len(ids) for _, ids in coded)]) if coded else 0
        self._annotate(coded)

    def _insert(self, ids: list[int]) -> None:
        last = 0
        for symbol in ids:
            last = self._extend(last, symbol)

    def _extend(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(symbol)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, known, symbol)
        state = self._new(length[last] + 1, {})
        while last >= 0 and symbol not in nxt[last]:
            nxt[last][symbol] = state
            last = link[last]
        if last < 0:
            link[state] = 0
        else:
            target = nxt[last][symbol]
            link[state] = target if length[target] == length[last] + 1 \
                else self._split(last, target, symbol)
        return state

    def _new(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, target: int, symbol: int) -> int:
        """The copy of ``target`` that ends after the shorter context ``at``."""
        copy = self._new(self.length[at] + 1, dict(self.next[target]))
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def _suffix(self, state: int, n: int) -> int:
        """The state of the ``n``-word suffix of a match of length >= n."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _annotate(self, coded: list[tuple[int | None, list[int]]]) -> None:
        owners: dict[int, set] = {}
        short: dict[int, dict[int, set]] = {}
        for item, ids in coded:
            state = 0
            for k, symbol in enumerate(ids, 1):
                state = self.next[state][symbol]
                if k >= self.window:
                    owners.setdefault(self._suffix(state, self.window), set()).add(item)
            if len(ids) < self.window:
                short.setdefault(self._suffix(state, len(ids)), {}).setdefault(len(ids), set()).add(item)
        self.owners = owners
        self.short = short
        #: nearest state on the suffix path (itself included) with short items, or -1
        self.near = array("i", [-1]) * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.near[s] = s if s in short else self.near[self.link[s]]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set, int]:
        """(hit flag per word, items whose windows occur, longest match)."""
        n = len(words)
        hit = np.zeros(n + 1, np.int32)
        items: set = set()
        longest = 0
        if not self.shortest or n < self.shortest:
            return hit[:n] > 0, items, longest
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, n)
        known = _edges(ids >= 0)
        nxt, link, length, near = self.next, self.link, self.length, self.near
        for begin, end in zip(known[::2].tolist(), known[1::2].tolist()):
            if end - begin < self.shortest:
                continue
            state, size = 0, 0
            for k, symbol in enumerate(ids[begin:end].tolist(), begin):
                while symbol not in nxt[state]:
                    if not state:
                        break
                    state = link[state]
                    size = length[state]
                else:
                    state = nxt[state][symbol]
                    size += 1
                if size > longest:
                    longest = size
                if size >= self.window:
                    hit[k - self.window + 1] += 1
                    hit[k + 1] -= 1
                    items |= self.owners[self._suffix(state, self.window)]
                s = near[state]
                while s > 0:
                    for m, own in self.short[s].items():
                        if m <= size:
                            hit[k - m + 1] += 1
                            hit[k + 1] -= 1
                            items |= own
                    s = near[link[s]]
        return np.cumsum(hit[:n]) > 0, items, longest


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The items in blocks of about ``block_words`` words each.

    The number of blocks comes from a total word count; a block is a hash
    range of the item text, so no block depends on the order of rows."""
    spec = items.select(F.col(id_col).cast("long").alias("item_id"),
                        F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = spec.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (4 * block_words)))
    return [spec.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).distinct() for k in range(n)]


_BUILT: dict[tuple, ItemAutomaton] = {}


def _automaton(shared, window: int) -> ItemAutomaton:
    key = (shared.value[0], window)
    if key not in _BUILT:
        _BUILT.clear()                               # one block at a time in a worker
        _BUILT[key] = ItemAutomaton([(i, split_words(t)) for i, t in shared.value[1]], window)
    return _BUILT[key]


def _broadcast(block: DataFrame):
    """A block's items for the workers; its size is bounded by item_blocks."""
    rows = sorted(((r.item_id, r.text) for r in block.collect()),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return block.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))


MARK_SCHEMA = ("doc_id long, text string, n_words long, longest int, hits array<int>, "
               "item_ids array<long>")


def _edges(flag: np.ndarray) -> np.ndarray:
    """Flat [first, end) pairs of the runs of set flags."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flag, [0])).astype(np.int8)))


def mark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, longest, hits, item_ids) per row; ``hits`` are flat
    [first word, end word) pairs of the marked spans.

    With several blocks each pass adds its marks to those carried along, so
    rows never have to be brought together again."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    blocks = item_blocks(items, block_words=block_words)
    for k, block in enumerate(blocks):
        shared = _broadcast(block)

        def fn(batch: pa.RecordBatch, shared=shared, first=k == 0,
               last=k == len(blocks) - 1) -> pa.RecordBatch:
            auto = _automaton(shared, window)
            texts = batch.column(1).to_pylist()
            before = [None] * len(texts) if first else \
                list(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5))))
            counts, longest, spans, owners = [], [], [], []
            for text, old in zip(texts, before):
                words = split_words(text)
                flag, found, most = auto.scan(words)
                if old is not None:
                    most = max(most, old[0])
                    flag = flag.copy()
                    for lo, hi in zip(old[1][::2], old[1][1::2]):
                        flag[lo:hi] = True
                    found = found.union(old[2])
                counts.append(len(words))
                longest.append(most)
                spans.append(_edges(flag))
                owners.append(sorted(i for i in found if i is not None))
            kept = pa.nulls(len(texts), pa.string()) if last else batch.column(1).cast(pa.string())
            return pa.record_batch([batch.column(0), kept, pa.array(counts, pa.int64()),
                                    pa.array(longest, pa.int32()),
                                    pa.array(spans, pa.list_(pa.int32())),
                                    pa.array(owners, pa.list_(pa.int64()))],
                                   names=["doc_id", "text", "n_words", "longest", "hits", "item_ids"])
        out = map_batches(out, fn, MARK_SCHEMA)
    return out.drop("text")


def clean_text(text: str, auto: ItemAutomaton, max_coverage: float = MAX_COVERAGE) -> str | None:
    """``text`` without its marked spans (white space around a removed span
    shrinks to one blank); None if more than ``max_coverage`` of it is marked."""
    return cut_spans(text, auto.scan(split_words(text))[0], max_coverage)


def cut_spans(text: str, flag: np.ndarray, max_coverage: float = MAX_COVERAGE) -> str | None:
    """``clean_text`` with the marked words given."""
    if not flag.any():
        return text
    if flag.mean() > max_coverage:
        return None
    places = [m.span() for m in _WORD.finditer(text)]
    edge = _edges(flag).tolist()
    kept, at = [], 0
    for begin, end in zip(edge[::2], edge[1::2]):
        kept.append(text[at:places[begin][0]].rstrip())
        at = places[end - 1][1]
    kept.append(text[at:].lstrip())
    return " ".join(k for k in kept if k)


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW,
                 max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (all columns) with contaminated spans cut out of the text;
    documents marked over more than ``max_coverage`` of their words go.

    Several blocks mark one after the other, each on the whole text, and carry
    the merged marks on the row; the limit and the cut come once, with the last."""
    schema = docs.schema
    spans = free_name(docs, "hits")
    marked = T.StructType([*schema, T.StructField(spans, T.ArrayType(T.IntegerType()))])
    blocks = item_blocks(items, block_words=block_words)
    for k, block in enumerate(blocks):
        shared = _broadcast(block)

        def fn(batch: pa.RecordBatch, shared=shared, first=k == 0,
               last=k == len(blocks) - 1) -> pa.RecordBatch:
            auto = _automaton(shared, window)
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            before = [()] * len(texts) if first else batch.column(batch.num_columns - 1).to_pylist()
            own = batch if first else batch.select(schema.names)
            flags = []
            for text, old in zip(texts, before):
                flag = auto.scan(split_words(text))[0].copy()
                for lo, hi in zip(old[::2], old[1::2]):
                    flag[lo:hi] = True
                flags.append(flag)
            if not last:
                return pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array([_edges(f) for f in flags], pa.list_(pa.int32()))],
                    names=[*schema.names, spans])
            new = [t if t is None else cut_spans(t, f, max_coverage) for t, f in zip(texts, flags)]
            keep = pa.array([t is None or x is not None for t, x in zip(texts, new)])
            return replace_column(own, text_col, pa.array(new, pa.string())).filter(keep)
        docs = map_batches(docs, fn, schema if k == len(blocks) - 1 else marked)
    return docs


QUERY_NAME = "op10_benchmark_decontamination"
#: The windows and their union of positions are not practical in SQL on whole
#: texts; the query is tested against a brute-force scan instead.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the marks for every document."""
    docs = open_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = open_table(spark, sf_dir, "benchmark").select("item_id", "text")
    marks = mark(docs, items)
    n_hit = F.expr("aggregate(sequence(0, size(hits) - 1), 0L, (s, i) -> "
                   "s + if(i % 2 = 0, -hits[i], hits[i]))")
    listed = F.array_join(F.array_sort(F.transform(F.array_distinct("item_ids"),
                                                   lambda i: i.cast("string"))), ",")
    return marks.select(
        "doc_id", "n_words",
        F.when(F.size("hits") > 0, n_hit).otherwise(F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.array_distinct("item_ids")).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))
