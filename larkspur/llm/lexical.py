"""Ranked lexical search by presence masks.

For every item of a stated query set the best ``top`` documents by a saturated
term weight (integers throughout, see ``scores``).  The documents are read once:
each becomes its term count and the (term, occurrences) pairs that any item
asks for.  The ranking then goes over that small table in blocks of documents:
a block is a matrix of terms x documents, its presence bits packed; an item's
rows of it give each document's mask of matched terms, and equal masks form a
group.  A group's score is at most the sum, over the mask, of the score each
term could have with its largest count and the group's shortest length.  Groups
are evaluated by descending bound and the rest is left as soon as no bound
reaches the item's ``top``-th score so far, which is carried through the task.
What a task gives back is at most ``top`` rows per item; these meet in one more
ranking per item.

Term weights need the number of documents holding each asked term, the number
of documents and of all terms: grouped sums over the written table.

Scale: documents are only mapped.  Items are dealt into blocks of at most
``BLOCK_TERMS`` (item, term) rows (or a single item); a block is what is
collected and broadcast, and every block is a pass of its own.

Defined cases: null and wordless texts hold no term, count in no statistic and
are never listed; rows repeated under one doc_id are documents of their own; a
null doc_id comes after all others of its score; rows of one item_id are one
item with the terms of all its texts; items without terms list nothing; a null
item_id is an item like others; no items or documents give no rows; further
columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import map_batches, materialise, open_table

TOP = 10
#: (item, term) rows of one broadcast block of items.
BLOCK_TERMS = 500_000
#: Cells of one terms x documents matrix.
BLOCK_CELLS = 4_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))
_ASCII = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_terms(text: str | None) -> list[bytes]:
    """Terms of a text as UTF-8 bytes."""
    return text.encode().translate(_FOLD).split() if text else []


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term): the distinct terms of every item; ``item`` is a
    key that is never null."""
    text = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    rows = items.select(F.col(id_col).alias("item_id"),
                        F.explode(F.regexp_extract_all(text, F.lit(_ASCII), F.lit(0))).alias("term"))
    key = F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.lit("null"))
    return rows.select(key.alias("item"), "item_id", "term").distinct()


def item_blocks(terms: DataFrame, block_terms: int = BLOCK_TERMS) -> list[DataFrame]:
    """The rows of whole items, dealt into blocks of about ``block_terms``.

    A hash of the item deals them into buckets of a quarter of that size on
    average; buckets are then joined up in order.  Only bucket sizes are seen."""
    total = terms.count()
    n = max(1, -(-4 * total // block_terms))
    if total <= block_terms:
        return [terms] if total else []
    bucket = F.pmod(F.xxhash64("item"), F.lit(n))
    sizes = sorted((r.b, r["count"]) for r in terms.groupBy(bucket.alias("b")).count().collect())
    blocks, size = [[]], 0
    for b, many in sizes:
        if blocks[-1] and size + many > block_terms:
            blocks.append([])
            size = 0
        blocks[-1].append(b)
        size += many
    return [terms.where(bucket.isin(b)) for b in blocks]


class Items:
    """One block of items: asked terms numbered, each item a list of numbers."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.vocab: dict[bytes, int] = {}
        own: dict[str, list[int]] = {}
        for item, term in rows:
            own.setdefault(item, []).append(self.vocab.setdefault(term.encode(), len(self.vocab)))
        self.names = list(own)
        self.terms = [np.array(t) for t in own.values()]


_HELD: dict[str, Items] = {}


def _items(shared) -> Items:
    key, rows = shared.value
    if key not in _HELD:
        _HELD.clear()                                # one block at a time in a worker
        _HELD[key] = Items(rows)
    return _HELD[key]


def matched_terms(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with terms: its length and the
    asked terms it holds."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = _items(shared).vocab
        ids, size, terms, tf = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = split_terms(text)
            if words:
                found = Counter(words)
                held = [(vocab[w], found[w]) for w in found.keys() & vocab.keys()]
                ids.append(doc)
                size.append(len(words))
                terms.append([h[0] for h in held])
                tf.append([h[1] for h in held])
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(size, pa.int64()),
                                pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                               names=["doc_id", "n", "terms", "tf"])
    return map_batches(rows, fn, "doc_id long, n long, terms array<int>, tf array<long>")


def scores(tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum over the terms (rows) of weight * (10**9 tf div (1000 tf + 8 m))."""
    tf = tf.astype(np.int64)
    part = (1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * m, 1)
    return (weight[:, None] * part).sum(axis=0)


def masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents (columns) grouped by which terms (rows) they hold: the first
    document of every group and each document's group number."""
    bits = np.packbits(present, axis=0)
    bits = np.concatenate([bits, np.zeros((-len(bits) % 8, bits.shape[1]), np.uint8)])
    packed = np.ascontiguousarray(bits.T).view(np.uint64)
    if packed.shape[1] > 1:
        order = np.lexsort(packed.T)
        new = np.insert((packed[order[1:]] != packed[order[:-1]]).any(axis=1), 0, True)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        return order[new], at
    _, first, at = np.unique(packed[:, 0], return_index=True, return_inverse=True)
    return first, at


class Best:
    """The highest scores of one item so far, equal ones by smallest id."""

    def __init__(self, top: int):
        self.top, self.score, self.doc = top, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """The score a document needs to be listed."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        some = score >= self.least
        score, doc = np.append(self.score, score[some]), np.append(self.doc, doc[some])
        order = np.lexsort((doc, -score))[:self.top]
        self.score, self.doc = score[order], doc[order]


def search_block(best: Best, tf: np.ndarray, m: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> int:
    """Adds the documents (columns of ``tf``) of one item; returns how many
    were evaluated.  Groups of one mask go by descending bound."""
    present = tf > 0
    some = np.flatnonzero(present.any(axis=0))
    if not len(some):
        return 0
    first, at = masks(present[:, some])
    kinds, most = present[:, some[first]], tf.max(axis=1)
    # a bound without the group's own length spares most groups the closer one
    each = scores(most[None, :], m[some].min(), np.ones(1, np.int64)) * weight
    near = np.flatnonzero(each.astype(np.float64) @ kinds >= best.least)
    shortest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(shortest, at, m[some])
    bound = np.zeros(len(first), np.int64)
    bound[near] = scores(np.where(kinds[:, near], most[:, None], 0), shortest[near], weight)
    order = np.argsort(-bound, kind="stable")
    members = np.argsort(at, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(first))))
    done = k = 0
    while k < len(order) and bound[order[k]] >= best.least:
        # the next groups together, as many as would fill the list
        take, n = [], 0
        while k < len(order) and n < max(best.top, 64) and bound[order[k]] >= best.least:
            g = order[k]
            take.append(some[members[ends[g]:ends[g + 1]]])
            n += len(take[-1])
            k += 1
        cols = np.concatenate(take)
        best.add(scores(tf[:, cols], m[cols], weight), doc[cols])
        done += n
    return done


_NO_ID = np.iinfo(np.int64).max


def _ranked(matched: DataFrame, shared, weights, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item."""
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = _items(shared), weights.value
        best = [Best(top) for _ in items.terms]
        step = max(64, BLOCK_CELLS // max(1, len(weight)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                doc = batch.column(0).fill_null(_NO_ID).to_numpy()
                m = np.array([10 + (90 * n * n_docs) // n_terms for n in batch.column(1).to_pylist()], np.int64)
                lists = batch.column(2)
                tf = np.zeros((len(weight), batch.num_rows), np.int32)
                owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                tf[lists.flatten().to_numpy(), owner] = batch.column(3).flatten().to_numpy()
                for b, terms in zip(best, items.terms):
                    search_block(b, tf[terms], m, doc, weight[terms])
        names = [n for n, b in zip(items.names, best) for _ in b.score]
        doc = np.concatenate([b.doc for b in best])
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(doc, mask=doc == _NO_ID),
                               pa.array(np.concatenate([b.score for b in best]))], names=["item", "doc_id", "score"])
    return matched.mapInArrow(rank, "item string, doc_id long, score long")


def _numbered(frame: DataFrame, n: int, col: str) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for r in frame.collect():                        # at most one row per asked term of a block
        out[r.term] = r[col]
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item."""
    spark = docs.sparkSession
    terms = materialise(item_terms(items, item_col, item_text_col), "item_terms")
    found, totals = [], None
    for block in item_blocks(terms, block_terms):
        rows = sorted((r.item, r.term) for r in block.select("item", "term").collect())
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
        asked = len({term for _, term in rows})
        matched = materialise(matched_terms(docs, shared, id_col, text_col), "matched")
        if totals is None:
            totals = matched.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not totals.n:
            break
        df = _numbered(matched.select(F.explode("terms").alias("term")).groupBy("term").count(), asked, "count")
        weight = np.array([math.floor(1000 * math.log((2 * totals.n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        found.append(_ranked(matched, shared, spark.sparkContext.broadcast(weight), totals.n, totals.l, top))
    if not found:
        return terms.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                            F.lit(0).cast("long").alias("score")).limit(0)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(terms.select("item", "item_id").distinct(), "item") \
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


QUERY_NAME = "op13_mask_search"
_SQL_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
ORACLE_SQL = f"""
WITH split AS (
  SELECT doc_id, {_SQL_TERMS} AS ts FROM documents
), held AS (
  SELECT doc_id, ts, len(ts)::BIGINT AS n FROM split WHERE len(ts) > 0
), totals AS (
  SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM held
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark)
), tf AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, n, unnest(ts) AS term FROM held)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, totals GROUP BY term, nd
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), totals GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = open_table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, open_table(spark, sf_dir, "benchmark").select("item_id", "text"))
