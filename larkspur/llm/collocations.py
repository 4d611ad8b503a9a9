"""Phrase collocations counted with quotient filters.

A word's id is a 64-bit hash of (language, word); the vocabulary pass proves
that no two words share one (else it takes another seed), so ids need no
dictionary on the workers and every count is per language by itself.  A phrase
of k words is the k ids packed side by side and permuted by a Feistel-like
sweep that can be undone.  The leading bits of the permuted number are its
*quotient*, all other bits its *remainder*: a counting quotient filter keeps
sorted remainders with one counter each, and as the remainder is kept in full,
nothing is lost.  Every task fills such filters over its texts and emits them
quotient by quotient; the filters of one quotient block meet in one unit, where
sorted runs are merged, counters added, and the permutation undone for the
phrases that reach ``min_count``.  The permutation spreads even the most common
phrases evenly over blocks, and a phrase costs one counter per filter, however
common it is.

Phrases of k words are only counted where both phrases of k - 1 words inside
can reach ``min_count``; the test is a bitmap of at most 32 MB, which may let
others through but never holds one back, so counts stay exact at any size.
Texts are read twice (vocabulary, ids); later passes read the ids, in which
words too rare for any phrase are gaps.

Defined cases: null, empty and wordless texts add nothing; a null language is
``und``; repeated rows count each time; phrases never cross a piece; equal
scores are ordered by count, then phrase; no rows give no phrases; further
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import map_units, materialise, open_table

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
COVERED_PERCENT = 100
#: Words held by a worker's id cache; entries of a vocabulary or filter before it is emitted.
CACHE_WORDS, VOCABULARY_ENTRIES, FILTER_ENTRIES = 200_000, 1 << 18, 1 << 19
#: Occurrences that one quotient block stands for.
BLOCK_GRAMS = 1 << 19
#: Texts handled at a time.
SLICE_ROWS = 256

_U64 = np.uint64
_END = b"\n"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c
              for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Words of a text in order, with ``_END`` between pieces."""
    if not text:
        return []
    return [w for w in text.encode().translate(_FOLD).replace(_END, b" \n ").split(b" ") if w]


class _WordIds(dict):
    """Ids of one language's words while they stay in the cache."""

    def __init__(self, lang: str, seed: int):
        super().__init__()
        self.lang, self.seed = lang.encode() + _END, seed
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self[_END] = 0
        value = self[word] = word_id(self.lang + word, self.seed)
        return value


def word_id(named: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(named, seed)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(lo, SLICE_ROWS)


def vocabulary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
               word_id: Callable[[bytes, int], int] = word_id) -> tuple[DataFrame, int]:
    """(lang, word, id, f) of every word, and the seed of its ids."""
    seed = 0
    while True:
        def count(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            held: dict[str, Counter] = {}
            for batch in _slices(batches):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held.setdefault(lang, Counter()).update(split_words(text))
                if sum(map(len, held.values())) >= VOCABULARY_ENTRIES:
                    yield from emit(held, seed)
                    held.clear()
            yield from emit(held, seed)

        def emit(held: dict[str, Counter], seed: int) -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                words.pop(_END, None)
                head = lang.encode() + _END
                ids = np.fromiter((word_id(head + w, seed) for w in words), _U64, len(words))
                yield pa.record_batch(
                    [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()),
                     pa.array(ids.view(np.int64)), pa.array(list(words.values()), pa.int64())],
                    names=["lang", "word", "id", "f"])
        counted = _texts(docs, text_col, lang_col).mapInArrow(count, "lang string, word string, id long, f long")
        words = materialise(counted.groupBy("lang", "word", "id").agg(F.sum("f").alias("f")), "vocabulary")
        shared = words.groupBy("id").count().where("count > 1 OR id = 0")
        if shared.isEmpty():
            return words, seed
        seed += 1


class Sieve:
    """Bitmap over the leading bits of 64-bit hashes, about 16 bits for each up
    to ``MAX_BITS`` in all; the bound of its broadcast is 32 MB."""

    MAX_BITS = 28

    def __init__(self, keys: DataFrame, col: str):
        n = keys.count()
        self.width = min(self.MAX_BITS, max(15, math.ceil(math.log2(16 * n + 1))))
        place = F.shiftrightunsigned(col, 64 - self.width) + 1
        rows = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")) \
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
        flags = bytearray((1 << self.width) // 8)
        for r in rows:
            flags[(r.bucket - 1) * 4096:r.bucket * 4096] = r.bits
        self.shared = keys.sparkSession.sparkContext.broadcast(bytes(flags))

    @staticmethod
    def hits(flags: bytes, width: int, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> _U64(64 - width)).astype(np.int64)
        return ((np.frombuffer(flags, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def coded(docs: DataFrame, frequent: Sieve, seed: int, text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """(ids) of every text: runs of two or more frequent words, 0 between them."""
    shared, width = frequent.shared, frequent.width

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _WordIds] = {}
        for batch in _slices(batches):
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split_words(text)
                if lang not in known:
                    if sum(map(len, known.values())) >= CACHE_WORDS:
                        known.clear()
                    known[lang] = _WordIds(lang, seed)
                ids = np.zeros(len(words) + 2, _U64)
                ids[1:-1] = np.fromiter(map(known[lang].__getitem__, words), _U64, len(words))
                keep = Sieve.hits(shared.value, width, ids) & (ids != 0)
                run = keep[1:-1] & (keep[:-2] | keep[2:])       # a lone word is in no phrase
                ids = np.where(run, ids[1:-1], _U64(0))
                ids = ids[run | np.insert(run[:-1], 0, False)] if len(ids) else ids
                out.append(np.append(ids, _U64(0)).view(np.int64) if len(ids) else None)
            ids = pa.array([x for x in out if x is not None], pa.list_(pa.int64()))
            yield pa.record_batch([ids], names=["ids"])
        pa.default_memory_pool().release_unused()
    return _texts(docs, text_col, lang_col).mapInArrow(code, "ids array<long>")


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + _U64(salt)) * _U64(0x9E3779B97F4A7C15)
    x ^= x >> _U64(32)
    x *= _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(29))


def permute(ids: list[np.ndarray]) -> list[np.ndarray]:
    """Bijection of k packed 64-bit ids: each is changed by a function of the
    one before it, round the circle; the first one comes last."""
    out = [x.copy() for x in ids]
    k = len(out)
    for j in range(k):
        out[(j + 1) % k] ^= _mix(out[j], j + 1)
    return out


def unpermute(blocks: list[np.ndarray]) -> list[np.ndarray]:
    out = [x.copy() for x in blocks]
    k = len(out)
    for j in reversed(range(k)):
        out[(j + 1) % k] ^= _mix(out[j], j + 1)
    return out


def group(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal keys brought together in order, their counters added.  Sorted runs
    (filters) merge in linear time; keys equal in the first block only are told
    apart by the others."""
    if not len(counts):
        return keys, counts
    order = np.argsort(keys[0], kind="stable")
    sorted_ = [k[order] for k in keys]
    same = sorted_[0][1:] == sorted_[0][:-1]
    if any((same & (k[1:] != k[:-1])).any() for k in sorted_[1:]):
        order = np.lexsort(keys[::-1])
        sorted_ = [k[order] for k in keys]
        same = sorted_[0][1:] == sorted_[0][:-1]
        for k in sorted_[1:]:
            same &= k[1:] == k[:-1]
    first = np.flatnonzero(np.insert(~same, 0, True))
    return [k[first] for k in sorted_], np.add.reduceat(counts[order], first)


class QuotientFilter:
    """Sorted permuted phrases of ``k`` words with exact counters."""

    def __init__(self, k: int, quotient_bits: int):
        self.k, self.bits = k, quotient_bits
        self.short = (64 - quotient_bits + 7) // 8          # bytes of the first block's remainder
        self.clear()

    def clear(self) -> None:
        self.keys = [np.empty(0, _U64) for _ in range(self.k)]
        self.counts = np.empty(0, np.int64)
        self.waiting: list[list[np.ndarray]] = []
        self.n_waiting = 0

    def add(self, permuted: list[np.ndarray]) -> None:
        self.waiting.append(permuted)
        self.n_waiting += len(permuted[0])
        if self.n_waiting >= FILTER_ENTRIES:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            new = group([np.concatenate(c) for c in zip(*self.waiting)], np.ones(self.n_waiting, np.int64))
            self.waiting, self.n_waiting = [], 0
            self.keys, self.counts = group([np.concatenate(c) for c in zip(self.keys, new[0])],
                                           np.concatenate([self.counts, new[1]]))

    def __len__(self) -> int:
        return len(self.counts)

    def rows(self) -> pa.RecordBatch:
        """One row per quotient: its remainders as bytes, and their counters."""
        self.settle()
        shift = _U64(64 - self.bits)
        quotient = self.keys[0] >> shift
        first = np.flatnonzero(np.insert(quotient[1:] != quotient[:-1], 0, True)) if len(quotient) else \
            np.empty(0, np.int64)
        ends = np.append(first, len(quotient))
        rest = self.keys[0] & ((_U64(1) << shift) - _U64(1))
        parts = [rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.short]]
        parts += [k.astype("<u8").view(np.uint8).reshape(-1, 8) for k in self.keys[1:]]
        record = np.ascontiguousarray(np.concatenate(parts, axis=1))
        data = pa.Array.from_buffers(pa.binary(), len(first), [
            None, pa.py_buffer((ends * record.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(record.tobytes())])
        counters = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.counts, pa.int64()))
        return pa.record_batch([pa.array(quotient[first].view(np.int64)), data, counters],
                               names=["quotient", "remainders", "counters"])

    def read(self, quotients: list[int], remainders: list[bytes], counters: list[np.ndarray]) -> None:
        """Merges rows of other filters into this one."""
        width = self.short + 8 * (self.k - 1)
        runs = [self.keys], [self.counts]
        for q, data, n in zip(quotients, remainders, counters):
            record = np.frombuffer(data, np.uint8).reshape(-1, width)
            head = np.zeros((len(record), 8), np.uint8)
            head[:, :self.short] = record[:, :self.short]
            keys = [head.view("<u8").ravel() | (_U64(q) << _U64(64 - self.bits))]
            keys += [np.ascontiguousarray(record[:, at:at + 8]).view("<u8").ravel()
                     for at in range(self.short, width, 8)]
            runs[0].append(keys)
            runs[1].append(n)
        self.keys, self.counts = group([np.concatenate(c) for c in zip(*runs[0])], np.concatenate(runs[1]))


def windows(ids: np.ndarray, k: int, sieve: tuple[bytes, int] | None) -> list[np.ndarray]:
    """Permuted k-word windows of a run of ids (0 is a gap) of which both
    (k - 1)-word parts pass the sieve (k = 2: all)."""
    if len(ids) < k:
        return [np.empty(0, _U64)] * k
    gap = np.concatenate(([0], np.cumsum(ids == 0)))
    ok = gap[k:] == gap[:-k]
    if sieve is not None:
        part = permute([ids[j:len(ids) - k + 2 + j] for j in range(k - 1)])[0]
        hit = Sieve.hits(*sieve, part)
        ok &= hit[:-1] & hit[1:]
    at = np.flatnonzero(ok)
    return permute([ids[at + j] for j in range(k)])


def count_phrases(ids: DataFrame, k: int, sieve: Sieve | None, quotient_bits: int, min_count: int) -> DataFrame:
    """(head, ids, a) of the k-word phrases that occur ``min_count`` times."""
    shared, width = (sieve.shared, sieve.width) if sieve else (None, 0)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QuotientFilter(k, quotient_bits)
        for batch in _slices(batches):
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(_U64)
            own.add(windows(flat, k, (shared.value, width) if shared else None))
            if len(own) >= FILTER_ENTRIES:
                yield own.rows()
                own.clear()
        yield own.rows()
        pa.default_memory_pool().release_unused()

    def merge(unit: pa.Table) -> pa.Table | None:
        whole = QuotientFilter(k, quotient_bits)
        counters = unit.column("counters")
        whole.read(unit.column("quotient").to_pylist(), unit.column("remainders").to_pylist(),
                   [c.values.to_numpy() for c in (counters[j] for j in range(len(counters)))])
        often = whole.counts >= min_count
        if not often.any():
            return None
        keys = [x[often] for x in whole.keys]
        packed = np.stack(unpermute(keys), axis=1)
        ends = np.arange(len(packed) + 1, dtype=np.int32) * k
        return pa.table({"head": pa.array(keys[0].view(np.int64)),
                         "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(packed.ravel().view(np.int64))),
                         "a": pa.array(whole.counts[often])})
    shards = ids.mapInArrow(fill, "quotient long, remainders binary, counters array<long>")
    return map_units(shards, ["quotient"], merge, "head long, ids array<long>, a long")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                     text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The vocabulary (lang, word, id, f) and all phrases (ids, a) of 2 to
    ``max_words`` words that occur ``min_count`` times, exactly counted."""
    words, seed = vocabulary(docs, text_col, lang_col)
    often = words.where(F.col("f") >= min_count)
    ids = materialise(coded(docs, Sieve(often, "id"), seed, text_col, lang_col), "ids")
    total = ids.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, total / BLOCK_GRAMS))))
    found, sieve = [], None
    for k in range(2, max_words + 1):
        phrases = materialise(count_phrases(ids, k, sieve, bits, min_count), f"phrases{k}")
        found.append(phrases.select("ids", "a"))
        if k == max_words or phrases.isEmpty():
            break
        sieve = Sieve(phrases, "head")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return words, every


def collocation_score(a: F.Column, n: F.Column, l: F.Column, r: F.Column) -> F.Column:
    """floor(1000 a n / (l r)) in 38-digit integers."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, l, r)]
    return F.call_function("div", wide[0] * wide[1] * F.lit(1000).cast("decimal(4,0)"), wide[2] * wide[3])


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int | None = TOP,
                 covered_percent: int = COVERED_PERCENT, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score), the first ``top`` of
    each language (all, if None)."""
    words, phrases = frequent_phrases(docs, min_count, max_words, text_col, lang_col)
    totals = materialise(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    often = words.where(F.col("f") >= min_count)

    counts = phrases.select(F.col("ids").alias("part"), F.col("a").alias("c")).unionByName(
        often.select(F.array("id").alias("part"), F.col("f").alias("c")))
    # covered: words of a longer phrase that is as frequent
    size = F.size("ids")
    inner = (phrases.where(size > 2).select("a", "ids", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
             .select("a", "ids", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
             .select(F.expr("slice(ids, at, m)").alias("ids"), "a")
             .groupBy("ids").agg(F.max("a").alias("longer")))
    left = phrases.join(inner, "ids", "left").where(
        F.coalesce(F.col("longer") * 100 < F.col("a") * covered_percent, F.lit(True))).select("ids", "a")

    spelled = (left.select("ids", "a", F.posexplode("ids").alias("at", "id"))
               .join(often.select("id", "lang", "word"), "id").groupBy("ids", "a")
               .agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
               .select("ids", "a", "lang", F.array_join("w.word", " ").alias("phrase")))
    spelled = materialise(spelled.join(totals, "lang"), "spelled")
    cuts = (spelled.select("ids", "a", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
            .select("ids", "a", "n", "k", F.expr("slice(ids, 1, k)").alias("head"),
                    F.expr("slice(ids, k + 1, size(ids) - k)").alias("tail"))
            .join(counts.select(F.col("part").alias("head"), F.col("c").alias("l")), "head")
            .join(counts.select(F.col("part").alias("tail"), F.col("c").alias("r")), "tail"))
    scored = cuts.withColumn("score", collocation_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    rows = spelled.join(lowest, "ids").select("lang", "phrase", F.size("ids").cast("long").alias("words"), "a",
                                              "x.l", "x.r", "n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


QUERY_NAME = "op12_quotient_collocations"
ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded
), spans AS (
  SELECT lang, ws[i:i + k - 1] AS p FROM starts, range(1, 6) AS t(k) WHERE i + k - 1 <= len(ws)
), f AS (
  SELECT lang, p, count(*) AS c FROM spans GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang
), cand AS (
  SELECT lang, p, c AS a, len(p) AS size FROM f WHERE len(p) >= 2
), sized AS (
  SELECT lang, p, a, size, unnest(range(2, size)) AS m FROM cand
), placed AS (
  SELECT lang, p, a, m, unnest(range(1, size - m + 2)) AS i FROM sized
), longer AS (
  SELECT lang, p[i:i + m - 1] AS p, max(a) AS most FROM placed GROUP BY ALL
), kept AS (
  SELECT cand.* FROM cand LEFT JOIN longer USING (lang, p) WHERE most IS NULL OR 100 * most < 100 * a
), cuts AS (
  SELECT lang, p, a, size, unnest(range(1, size)) AS k FROM kept
), scored AS (
  SELECT cuts.lang, cuts.p, a, k, h.c AS l, t.c AS r, n,
         ((1000::HUGEINT * a * n) // (h.c::HUGEINT * t.c))::BIGINT AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.p = cuts.p[1:k]
       JOIN f t ON t.lang = cuts.lang AND t.p = cuts.p[k + 1:size]
       JOIN totals ON totals.lang = cuts.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
       array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    docs = open_table(spark, sf_dir, "documents").select("text", "lang")
    return collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
