"""Embedding near-duplicates by iterative quantisation (ITQ).

A rotation learned on a bounded sample turns vectors into balanced binary
codes: centre, project on principal directions, then alternate between signs
and the orthogonal rotation that brings the projections closest to them.
Several such rotations (from different starts) give long codes.  The code is
cut into ``tables`` substrings, one Hamming table each; two vectors meet if a
substring is equal.  Substrings grow with log2 of the number of rows, so table
cells keep a bounded mean size, and the number of tables follows from the
recall wanted at the similarity limit: from the angles that pairs at the limit
have around the mean, which are wider than the raw angle when the vectors share
a direction, and the recall of the learned codes on such pairs is measured and
topped up.  Where the wider angles ask for many more tables, the substrings are
shortened to the width that copies a row least; with a very strong common
direction that is width 0, one cell whose pairs are all compared.  Vectors that
meet are ranked again by the exact cosine in double precision.

Vectors at equal direction bits may form a cell of any size.  Equal vectors
are grouped before anything else; a large cell is cut into blocks, and every
pair of blocks is a unit of work.  A unit returns one count per vector and a
spanning forest, never pairs.  A pair is counted only in the first table where
it meets.

Defined cases: vectors that are null or zero, or hold null or non-finite
components, link with nothing; a null vec_id links with nothing, has no
component and is kept; vectors of different lengths are never linked; rows
repeated under one vec_id with one vector count as several links of others but
none of their own id; further columns (labels) are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import connected_components, map_batches, map_units, materialise, open_table

MIN_COSINE = 0.9
#: Rows the rotations are learned on.
SAMPLE = 8192
ITERATIONS = 30
#: Probability wanted that a pair exactly at the limit meets in some table.
RECALL = 0.97
BLOCK = 1024
#: Sample pairs at the limit on which the layout is measured.
PAIRS = 2048
#: Tables beyond those of the raw angle from which the width is chosen anew.
MORE_TABLES = 1.5


class Codes:
    """Rotations and substring layout; small (a few matrices) and broadcast."""

    def __init__(self, sample: np.ndarray, rows: int, min_cosine: float = MIN_COSINE, seed: int = 7):
        dim = sample.shape[1]
        raw = math.acos(min_cosine)
        self.width = int(min(26, max(8, math.ceil(math.log2(max(2, rows))) - 4)))
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
        rng = np.random.default_rng(seed)
        left, right = limit_pairs(sample, self.mean, min_cosine, np.random.default_rng(seed + 1))
        angles = _angles(left - self.mean, right - self.mean, raw)
        self.tables = tables_wanted(angles, self.width)
        if self.tables > MORE_TABLES * tables_wanted(np.array([raw]), self.width):
            self.width = min(range(self.width, -1, -1), key=lambda w: copies(angles, w, rows))
            self.tables = tables_wanted(angles, self.width)
        turns = [np.empty((dim, 0))]
        while True:
            while sum(t.shape[1] for t in turns) < self.width * self.tables:
                turns.append(learn_rotation(sample - self.mean, rng))
            self.turn = np.hstack(turns)[:, :self.width * self.tables]
            if not len(left) or (self.substrings(left) == self.substrings(right)).any(axis=1).mean() >= RECALL:
                break
            self.tables += max(1, self.tables // 8)
            if self.tables * (1 + rows / 2 ** self.width / BLOCK) > 1 + rows / BLOCK:
                self.width, self.tables = 0, 1            # comparing all pairs copies less

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """(row, table) substring values."""
        bits = (x - self.mean) @ self.turn > 0
        bits = bits.reshape(len(x), self.tables, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64))


def limit_pairs(sample: np.ndarray, mean: np.ndarray, min_cosine: float,
                rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sample vectors and partners at ``min_cosine``: each is turned around the
    mean towards another sample vector, so that a partner shares the common
    direction, at most by a right angle."""
    if len(sample) < 2:
        return sample[:0], sample[:0]
    left = sample[rng.permutation(len(sample))[:PAIRS]]
    z = left - mean
    size = np.linalg.norm(z, axis=1, keepdims=True)
    away = sample[rng.integers(0, len(sample), len(left))] - mean
    away = away - z * ((away * z).sum(axis=1, keepdims=True) / np.maximum(size ** 2, 1e-300))
    away *= size / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)

    def turned(by: np.ndarray) -> np.ndarray:
        y = mean + np.cos(by) * z + np.sin(by) * away
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    low, high = np.zeros((len(left), 1)), np.full((len(left), 1), math.pi / 2)
    for _ in range(40):
        middle = (low + high) / 2
        near = (left * turned(middle)).sum(axis=1, keepdims=True) >= min_cosine
        low, high = np.where(near, middle, low), np.where(near, high, middle)
    return left, turned(low)


def _angles(x: np.ndarray, y: np.ndarray, otherwise: float) -> np.ndarray:
    """Angle of every pair; ``otherwise`` where a vector has no direction, or without pairs."""
    sizes = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    cosine = np.clip((x * y).sum(axis=1) / np.maximum(sizes, 1e-300), -1, 1)
    return np.where(sizes > 1e-12, np.arccos(cosine), otherwise) if len(x) else np.array([otherwise])


def tables_wanted(angles: np.ndarray, width: int) -> int:
    """Tables in which pairs at these angles meet with probability ``RECALL`` on average."""
    meet = np.minimum((1 - angles / math.pi) ** width, 1 - 1e-12)
    low, high = 0, 1
    while np.mean((1 - meet) ** high) > 1 - RECALL and high < 1 << 40:
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if np.mean((1 - meet) ** middle) > 1 - RECALL else (low, middle)
    return high


def copies(angles: np.ndarray, width: int, rows: int) -> float:
    """Copies made of a row: one for every block of its cell, in every table."""
    return tables_wanted(angles, width) * (1 + rows / 2 ** width / BLOCK)


def learn_rotation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Projection and rotation whose signs lie closest to the projections."""
    dim = x.shape[1]
    start, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    if len(x) < 2:
        return start
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    r = start
    for _ in range(ITERATIONS):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def usable(vec: str) -> F.Column:
    """The vector has a direction: no null or non-finite component, not zero."""
    good = F.forall(vec, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(vec, lambda e: e != 0), F.lit(False))


def _matrix(lists: pa.Array) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)          # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(rows: pa.Table, min_cosine: float) -> pa.Table | None:
    """Counts and forest links of one pair of blocks of a table cell."""
    side = rows.column("left").to_numpy(zero_copy_only=False)
    same = rows.column("a")[0].as_py() == rows.column("b")[0].as_py()
    left = np.flatnonzero(side)
    right = left if same else np.flatnonzero(~side)
    if not len(left) or len(right) < (2 if same else 1):
        return None
    x = _matrix(rows.column("embedding"))
    keys = np.array(rows.column("keys").to_pylist(), np.int32).reshape(len(x), -1)
    ids, many = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
    near = x[left] @ x[right].T >= min_cosine
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    if len(i):
        first = ~(keys[left[i]] == keys[right[j]]).any(axis=1)
        i, j = left[i[first]], right[j[first]]
    if not len(i):
        return None
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, many[j])
    np.add.at(links, j, many[i])
    up = list(range(len(ids)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k
    got = np.flatnonzero(links)
    out_id, out_n, out_to = ids[got].tolist(), links[got].tolist(), [None] * len(got)
    for p, q in zip(i.tolist(), j.tolist()):
        p, q = root(p), root(q)
        if p != q:
            up[max(p, q)] = min(p, q)
            out_id.append(ids[p])
            out_n.append(0)
            out_to.append(ids[q])
    return pa.table({"id": pa.array(out_id, pa.int64()), "links": pa.array(out_n, pa.int64()),
                     "other": pa.array(out_to, pa.int64())})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 min_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    # single-precision components travel as they are; all arithmetic is in double
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = materialise(vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                                      F.col(vec_col).cast(kind).alias("embedding")), "vectors")
    good = rows.where(F.col("vec_id").isNotNull() & usable("embedding"))
    groups = materialise(good.groupBy("embedding").agg(F.min("vec_id").alias("id"),
                                                       F.count(F.lit(1)).alias("copies")), "groups")
    sizes = [r[0] for r in groups.select(F.size("embedding")).distinct().collect()]
    links = None
    for dim in sorted(sizes):                             # one index per vector length
        own = groups.where(F.size("embedding") == dim)
        found = _links(own, own.count(), dim, min_cosine)
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "id long, links long, other long")
    links = materialise(links, "links")
    comps = connected_components(links.where("other IS NOT NULL")
                                 .select(F.col("id").alias("a"), F.col("other").alias("b")))
    counted = links.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    label = materialise(
        groups.join(counted, "id", "left").join(comps, "id", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id")), "labels")
    # rows of one vec_id that repeat its vector are no links of each other
    twice = good.groupBy("vec_id").count().where("count > 1").select("vec_id")
    own = materialise(good.join(twice, "vec_id", "left_semi").groupBy("vec_id", "embedding")
                      .agg((F.count(F.lit(1)) - 1).alias("again")).where("again > 0"), "repeats")
    linked = good.join(label.hint("merge"), "embedding").join(own, ["vec_id", "embedding"], "left") \
        .select("vec_id", (F.col("n_links") - F.coalesce("again", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.where(F.col("vec_id").isNull() | ~usable("embedding")) \
        .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(groups: DataFrame, n: int, dim: int, min_cosine: float) -> DataFrame:
    sample = groups.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
    codes = groups.sparkSession.sparkContext.broadcast(
        Codes(_matrix(sample.column("embedding")).reshape(-1, dim), n, min_cosine))

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = codes.value.substrings(_matrix(batch.column(1)))
        return pa.record_batch([batch.column(0), batch.column(2),
                                pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32()))],
                               names=["id", "copies", "keys"])
    coded = materialise(map_batches(groups.select("id", "embedding", "copies"), code,
                                    "id long, copies long, keys array<int>"), "codes")
    cells = coded.select("id", F.posexplode("keys").alias("tab", "cell"))
    sizes = materialise(cells.groupBy("tab", "cell").count().where("count > 1")
                        .select("tab", "cell", F.ceil(F.col("count") / BLOCK).alias("blocks")), "cells")
    placed = cells.join(sizes.hint("merge"), ["tab", "cell"]) \
        .withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = placed.select("id", "tab", "cell", F.least("own", "other").alias("a"),
                          F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).alias("left"))
    full = groups.select("id", "embedding").join(coded, "id")
    # a unit only asks for the substrings of the tables before its own
    met = units.join(materialise(full, "coded").hint("merge"), "id") \
        .withColumn("keys", F.slice("keys", F.lit(1), F.col("tab")))
    return map_units(met, ["tab", "cell", "a", "b"], lambda u: _unit(u, min_cosine),
                     "id long, links long, other long")


QUERY_NAME = "op8_itq_near_vectors"
#: Learned codes; tested against brute force.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(open_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
