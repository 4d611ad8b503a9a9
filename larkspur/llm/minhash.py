"""MinHash near-duplicate removal with circulant signatures.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words
split at ASCII white space; a text of fewer words is one shingle as a whole).
Two permutations of 32-bit numbers make the whole signature: the first
(``_sigma``) scatters the shingles, the second (``_pi``) is applied after a
circular shift by k to give coordinate k.  ``BANDS`` x ``ROWS`` coordinates
are banded; documents that share a band are candidates, and every link is
confirmed on the full sets (intersection / union >= ``PERCENT`` / 100).  A pair
at that similarity meets in some band with probability above 0.999999 (0.9999
for ``percent`` = 80).

What keeps hot groups apart:

* equal sets are grouped first (128-bit fingerprint, partial minimum before
  the shuffle); only one representative of each goes on;
* within a band bucket the representatives are compared with three leaders
  (smallest, largest, smallest hash), not with each other; leaders come from
  grouped minima, the pairs from a join that AQE can split;
* after the components of those links are known, rows of *different*
  components in one bucket are compared as well: block by block, counting
  common shingles through an inverted list inside the task.  A block gives
  back at most a spanning forest, never pairs.  Rows of one component are not
  compared again, as that could not change anything.  So no candidate link
  between different components is lost and nothing is capped.

Sets are built (a second pass over the texts) only for documents that have
candidates; a bitmap of their ids keeps the other texts out of the shuffle.

Defined cases: null, empty or wordless texts have an empty set and link with
nothing; a null doc_id links with nothing, has a null component and is kept;
rows repeated under one doc_id count as one document, linked through any of
its texts; further columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import (IdFilter, connected_components, free_name, map_batches,
                                 map_units, materialise, open_table)

SHINGLE = 5
BANDS, ROWS = 24, 5
PERCENT = 85
#: Rows of one block when the components of a bucket are compared.
BLOCK = 512
#: Bound of the word-hash cache of one worker.
CACHE_WORDS = 100_000

_U64 = np.uint64


class _WordHash(dict):
    """64-bit hashes of words, computed once while they stay in the cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHash()


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    length = min(n, size)
    acc = np.full(n - length + 1, length, np.uint64)
    for k in range(length):
        acc = acc * _U64(0x9E3779B97F4A7C15) + w[k:n - length + 1 + k]
    return np.unique(_mix64(acc))


def _sigma(shingles: np.ndarray) -> np.ndarray:
    """First permutation, onto the circle of 32-bit positions."""
    return (_mix64(shingles ^ _U64(0x5851F42D4C957F2D)) >> _U64(32)).astype(np.uint32)


def _pi(x: np.ndarray) -> np.ndarray:
    """Second permutation (a bijection of 32-bit numbers), in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k: minimum of the second permutation after a shift by k."""
    at = _sigma(shingles)
    best = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(at), 1024):
        np.minimum(best, _pi(at[lo:lo + 1024, None] + _SHIFTS).min(axis=0), out=best)
    return best


_BAND_NO = np.arange(1, BANDS + 1, dtype=np.uint64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band number is part of the key."""
    acc = _BAND_NO.copy()
    for column in sig.reshape(BANDS, ROWS).T:
        acc = _mix64(acc * _U64(0x9E3779B97F4A7C15) + column)
    return acc


PROFILE = "doc_id long, n_shingles long, fp binary, bands array<long>"


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, fingerprint, band keys) of every row."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, fp, bands = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text)
            size.append(len(s))
            if len(s):
                sig = signature(s)
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_keys(sig).view(np.int64))
            else:
                fp.append(None)
                bands.append(None)
        return pa.record_batch(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(fp, pa.binary()),
             pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "bands"])
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                   F.col(text_col).cast("string").alias("text")), fn, PROFILE)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the wanted ids; texts stay where they are read."""
    chance = IdFilter(wanted, "id")
    flags = chance.flags
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .where("id IS NOT NULL")
    rows = rows.withColumn("place", chance.column(F.col("id")))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(IdFilter.hits(flags.value, batch.column(2))))
        sets = [shingle_set(t).view(np.int64) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))],
                               names=["id", "shingles"])
    return map_batches(rows, fn, "id long, shingles array<long>") \
        .join(wanted.hint("merge"), "id", "left_semi")


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The written pairs (a, b) whose full sets reach the similarity."""
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (both.select("a", "b", common.alias("common"),
                        (F.size("sa") + F.size("sb") - common).alias("total"))
            .where(F.lit(100) * F.col("common") >= F.lit(percent) * F.col("total"))
            .select("a", "b"))


def _open_units(part: DataFrame) -> DataFrame:
    """Units of work for buckets with several components.

    The largest component of a bucket only has to be compared with the other
    rows (the probes), and those with each other.  Targets (all rows) and
    probes are dealt into blocks of about ``BLOCK`` rows; every pair of a
    target block and a probe block is one unit (key, t, q)."""
    sizes = part.groupBy("key", "component").count()
    plan = (sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("rows"),
                                     F.max(F.struct("count", "component")).alias("main"))
            .where("parts > 1")
            .select("key", F.col("main.component").alias("main"),
                    F.ceil(F.col("rows") / BLOCK).alias("nt"),
                    F.ceil((F.col("rows") - F.col("main.count")) / BLOCK).alias("nq")))
    rows = part.join(materialise(plan, "plan"), "key")
    spread = F.xxhash64(F.lit("block"), "id")

    def dealt(own: str, other: str, n_own: str, n_other: str, probe: bool, frame: DataFrame) -> DataFrame:
        return frame.select("key", F.pmod(spread, F.col(n_own)).alias(own),
                            F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1)).alias(other),
                            F.lit(probe).alias("probe"), "id", "component")
    return dealt("t", "q", "nt", "nq", False, rows).unionByName(
        dealt("q", "t", "nq", "nt", True, rows.where("component <> main")))


def _settle(unit: pa.Table, percent: int) -> pa.Table | None:
    """Links of one unit that join components not yet joined within it."""
    probe = unit.column("probe").to_numpy(zero_copy_only=False)
    ids = unit.column("id").to_numpy()
    comp = unit.column("component").to_numpy()
    lists = unit.column("shingles").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy()
    size = np.diff(ends)
    target = np.flatnonzero(~probe)
    if not len(target) or not probe.any():
        return None
    flat = np.concatenate([values[ends[k]:ends[k + 1]] for k in target])
    owner = np.repeat(np.arange(len(target)), size[target])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    up = {c: c for c in set(comp.tolist())}

    def root(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c
    a, b = [], []
    for k in np.flatnonzero(probe):
        own = values[ends[k]:ends[k + 1]]
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(target))
        near = np.flatnonzero(100 * common >= percent * (len(own) + size[target] - common))
        for j in target[near]:
            x, y = root(comp[k].item()), root(comp[j].item())
            if x != y:
                up[max(x, y)] = min(x, y)
                a.append(min(ids[k], ids[j]))
                b.append(max(ids[k], ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    prof = materialise(profiles(docs, id_col, text_col), "profiles")
    reps = materialise(
        prof.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp")
        .agg(F.min(F.struct("doc_id", "bands")).alias("r"))
        .select(F.col("r.doc_id").alias("id"), "fp", "r.bands"), "representatives")
    rows = reps.select("id", F.explode("bands").alias("key"))

    buckets = materialise(
        rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"),
                                F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("any"))
        .where("first <> last").select("key", "first", "last", F.col("any.id").alias("any")), "buckets")
    leaders = materialise(
        rows.join(buckets.hint("merge"), "key")
        .select("id", F.explode(F.array("first", "last", "any")).alias("leader"))
        .where("id <> leader")
        .select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
        .distinct(), "leaders")
    # rows of one doc_id with different texts are one document: link their sets
    named = prof.where("fp IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "fp")
    several = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")) \
        .where("lo <> hi").select("doc_id")
    twins = named.join(several, "doc_id", "left_semi").join(reps.select("fp", "id"), "fp") \
        .select(F.least("id", "doc_id").alias("a"), F.greatest("id", "doc_id").alias("b"))
    # every row of a bucket has a leader or is one, so these are all candidates
    wanted = materialise(leaders.select(F.col("a").alias("id")).union(leaders.select("b")).distinct(), "wanted")
    sets = materialise(_sets(docs, wanted, id_col, text_col), "sets")
    links = materialise(_confirm(sets, leaders, percent).union(twins), "links")
    comps = connected_components(links)

    # what the leaders could not settle: rows of different components in one bucket
    part = rows.join(buckets.select("key").hint("merge"), "key", "left_semi") \
        .join(comps.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    units = _open_units(materialise(part, "members")).join(sets.hint("merge"), "id")
    more = materialise(map_units(units, ["key", "t", "q"], lambda u: _settle(u, percent),
                                 "a long, b long").distinct(), "more")
    if not more.isEmpty():
        comps = connected_components(links.union(more))

    label = materialise(reps.join(comps.hint("merge"), "id", "left")
                        .select("fp", F.coalesce("component", "id").alias("component")), "labels")
    out = prof.join(label.hint("merge"), "fp", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.
    Exact repeats of an (id, text) row collapse; all columns stay.

    Rows whose id is neither dropped nor repeated pass without a shuffle; a
    bitmap tells most of them apart and the others meet the exact lists."""
    found = materialise(near_duplicates(docs, id_col, text_col, percent), "groups")
    drop = found.where(~F.col("kept")).select("doc_id").distinct()
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    touched = materialise(drop.union(again), "touched")
    chance = IdFilter(touched, "doc_id")
    flags, place, key = chance.flags, free_name(docs, "place"), F.col(id_col).cast("long")
    rows = docs.withColumn(place, F.when(key.isNotNull(), chance.column(key)))

    def side(hit: bool):
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.column(batch.schema.get_field_index(place))
            hits = IdFilter.hits(flags.value, at.fill_null(1)) & at.is_valid().to_numpy(zero_copy_only=False)
            return batch.filter(pa.array(hits == hit))
        return map_batches(rows, fn, rows.schema).drop(place)
    stay = side(True).join(drop.select(F.col("doc_id").alias("_drop_id")).hint("merge"),
                           F.col(id_col).cast("long") == F.col("_drop_id"), "left_anti")
    return side(False).unionByName(stay.dropDuplicates([id_col, text_col]))


QUERY_NAME = "op6_minhash_dedup"
#: Shingle sets and reachability over whole tables are too slow in SQL; tested
#: against a brute-force version.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_duplicates(open_table(spark, sf_dir, "documents").select("doc_id", "text"))
