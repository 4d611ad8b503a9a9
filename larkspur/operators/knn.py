"""Nearest-neighbour search by squared L2 distance.

Physical strategies, chosen from a measured size of the query side:

* broadcast: the query matrix (counted and sized first, at most
  ``BROADCAST_LIMIT_BYTES``) is shipped once to every executor and the
  corpus is streamed through ``mapInArrow`` - the corpus is never shuffled
  and its values are read from the Arrow buffers as one matrix per batch.
  Each task keeps a running top-k per query.
* streamed: beyond the bound, queries are split into ``G`` groups and the
  corpus into stripes; a task holds one group and a stripe streams past it.
* blocked: with given cells (``knn_ivf``), every cell is split into blocks of
  at most ``KNN_BLOCK_ROWS`` rows; one ``cogroup`` per (cell, block, group)
  computes a local top-k.

No task holds more than one bounded part of each side, and no pair is emitted -
only k candidates per query and stripe or block.

Either way the global top-k is a ``row_number() <= k`` window per query,
which Spark plans as a partial ``WindowGroupLimit`` before the shuffle.
Ordering is total: (distance, id).  Distances are float64 from float32
inputs; selection uses the GEMM form and the returned distances are
recomputed as direct sums of squared differences.  A vector of another
dimension raises; one with null or non-finite components has no distance to
anything and is no neighbour (``validate_vectors`` tells which and why).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.constants import BROADCAST_LIMIT_BYTES, KNN_BLOCK_ROWS

#: Distances computed at once, the rows they are for, and rows handed on at once.
_TILE_BYTES = 8 * 1024 * 1024
_TILE_ROWS = 8192
_RESULT_ROWS = 65536


def _stack(series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0), dtype=np.float64)
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """The rows of a list column without null lists, as float64."""
    if pc.any(pc.not_equal(pc.list_value_length(vectors), dim)).as_py():
        raise ValueError(f"vectors of other than {dim} components")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class _TopK:
    """Running exact top-k per query over blocks of candidates.

    Holds k ids and distances a query and, while rows are added, a few tiles of
    ``_TILE_BYTES``; vectors of candidates are not kept."""

    def __init__(self, q: np.ndarray, k: int, decimals: int | None = None):
        self.q, self.k, self.decimals = q, k, decimals
        self.qn = (q * q).sum(1)
        self.near = np.full((len(q), k), np.inf)         # for choosing
        self.exact = np.full((len(q), k), np.inf)        # sums of squared differences
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray, who: np.ndarray | None = None) -> None:
        """Compares rows with the queries numbered ``who`` (all, if None)."""
        if not len(x) or not len(self.q):
            return
        sound = np.isfinite(x).all(axis=1)
        if not sound.all():
            ids, x = ids[sound], x[sound]
            if not len(ids):
                return
        rows = max(1, _TILE_BYTES // (8 * max(1, min(self.k, len(x)) * x.shape[1])))
        for lo in range(0, len(x), _TILE_ROWS):
            part, part_ids = x[lo:lo + _TILE_ROWS], ids[lo:lo + _TILE_ROWS]
            xn = (part * part).sum(1)
            step = min(rows, max(1, _TILE_BYTES // (8 * len(part))))
            for s in range(0, len(self.q) if who is None else len(who), step):
                at = np.arange(s, min(s + step, len(self.q))) if who is None else who[s:s + step]
                d = (self.q[s:s + step] if who is None else self.q[at]) @ part.T
                d *= -2.0
                d += self.qn[at, None]
                d += xn[None, :]
                np.maximum(d, 0.0, out=d)
                if self.decimals is not None:
                    np.round(d, self.decimals, out=d)
                self._merge(at, d, part_ids, part)

    def _merge(self, at: np.ndarray, d: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        k = self.k
        closer = d <= self.near[at, -1][:, None]
        found = closer.sum(1)
        busy = np.flatnonzero(found)
        if not len(busy):
            return
        at, d, closer = at[busy], d[busy], closer[busy]
        many = np.flatnonzero(found[busy] > 4 * k)
        if len(many):                                    # the k smallest with their ties
            closer[many] &= d[many] <= np.partition(d[many], k - 1, axis=1)[:, k - 1:k]
        row, col = np.nonzero(closer)
        every = np.concatenate([np.repeat(np.arange(len(at)), k), row])
        all_i = np.concatenate([self.ids[at].ravel(), ids[col]])
        order = np.lexsort((all_i, np.concatenate([self.near[at].ravel(), d[row, col]]), every))
        starts = np.searchsorted(every[order], np.arange(len(at)))
        order = order[(starts[:, None] + np.arange(k)).ravel()]   # k of each query, at least those it had
        old, new = order[order < len(at) * k], order[order >= len(at) * k] - len(at) * k
        fresh = order >= len(at) * k
        near, exact = np.empty(len(order)), np.empty(len(order))
        near[~fresh], exact[~fresh] = self.near[at].ravel()[old], self.exact[at].ravel()[old]
        near[fresh] = d[row[new], col[new]]
        diff = self.q[at[row[new]]] - x[col[new]]
        exact[fresh] = (diff * diff).sum(1)
        self.near[at], self.exact[at] = near.reshape(-1, k), exact.reshape(-1, k)
        self.ids[at] = all_i[order].reshape(-1, k)

    def results(self, qids: pa.Array):
        """Record batches (query_id, vec_id, distance) of a few queries each."""
        step = max(1, _RESULT_ROWS // max(1, self.k))
        for s in range(0, len(self.q), step):
            row, col = np.nonzero(np.isfinite(self.near[s:s + step]))
            yield pa.record_batch([qids.take(pa.array(row + s)), pa.array(self.ids[row + s, col]),
                                   pa.array(self.exact[row + s, col])], names=["query_id", "vec_id", "distance"])


def _cand_schema(q: DataFrame) -> str:
    qt = q.schema["query_id"].dataType.simpleString()
    return f"query_id {qt}, vec_id long, distance double"


def _final_topk(cands: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    d = F.col("distance") if decimals is None else F.round("distance", decimals)
    w = Window.partitionBy("query_id").orderBy(d, F.col("vec_id"))
    return (cands.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "distance"))


def _prep(queries, corpus, query_id, query_vec, corpus_id, corpus_vec):
    q = queries.select(F.col(query_id).alias("query_id"),
                       F.col(query_vec).alias("qvec")).where(F.col("qvec").isNotNull())
    c = corpus.select(F.col(corpus_id).cast("long").alias("vec_id"),
                      F.col(corpus_vec).alias("vec")).where(F.col("vec").isNotNull())
    return q, c


def query_side_size(q: DataFrame) -> tuple[int, int]:
    row = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("qvec")).alias("d")).first()
    return int(row["n"] or 0), int(row["d"] or 0)


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = 10,
              query_id: str = "query_id", query_vec: str = "embedding",
              corpus_id: str = "vec_id", corpus_vec: str = "embedding",
              broadcast_limit: int = BROADCAST_LIMIT_BYTES,
              block_rows: int = KNN_BLOCK_ROWS, tie_decimals: int | None = None) -> DataFrame:
    """K nearest corpus vectors per query -> (query_id, rank, vec_id, distance).

    ``tie_decimals``: distances equal to that many places are ties (broken by
    id), for vectors whose distances tie mathematically.
    """
    q, c = _prep(queries, corpus, query_id, query_vec, corpus_id, corpus_vec)
    n_q, dim = query_side_size(q)
    if n_q * max(dim, 1) * 8 <= broadcast_limit:
        return _final_topk(_broadcast_candidates(q, c, k, tie_decimals), k, tie_decimals)
    return _final_topk(_streamed_candidates(q, c, k, math.ceil(n_q * dim * 8 / broadcast_limit), dim, tie_decimals),
                       k, tie_decimals)


def _broadcast_candidates(q: DataFrame, c: DataFrame, k: int,
                          decimals: int | None = None) -> DataFrame:
    spark = q.sparkSession
    tbl = q.toArrow()  # bounded: the caller checked n_q * dim * 8 <= limit
    qids, vecs = (tbl.column(name).combine_chunks() for name in ("query_id", "qvec"))
    qmat = _matrix(vecs, len(vecs[0])) if len(vecs) else np.zeros((0, 0))
    bc = spark.sparkContext.broadcast((qids, qmat))

    def scan(batches):
        ids, mat = bc.value
        top = _TopK(mat, k, decimals)
        for batch in batches:
            if batch.num_rows and len(mat):
                top.add(batch.column(0).to_numpy(), _matrix(batch.column(1), mat.shape[1]))
        yield from top.results(ids)
    return c.mapInArrow(scan, _cand_schema(q))


def _streamed_candidates(q: DataFrame, c: DataFrame, k: int, groups: int, dim: int,
                         decimals: int | None = None, meet=None) -> DataFrame:
    """q(query_id, qvec), c(vec_id, vec[, cell]) -> local top-k rows.

    Every task holds one of ``groups`` groups of queries, and one of the stripes
    of the corpus, as many as keep the cores busy, streams past it.  The queries
    are copied to the stripes, the corpus to the groups, neither through the
    driver.  ``meet(mat)`` gives a function cell -> queries (numbers) that meet
    the cell's rows; without it every query meets every row.
    """
    spark = q.sparkSession
    stripes = max(1, math.ceil(3 * spark.sparkContext.defaultParallelism / groups))
    vec = q.schema["qvec"].dataType if q.schema["qvec"].dataType == c.schema["vec"].dataType else "array<double>"
    cell = F.col("cell") if meet else F.lit(0)
    left = q.select(F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("_s"),
                    F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("_g"), F.lit(0).alias("side"),
                    "query_id", F.lit(0).cast("long").alias("vec_id"), F.col("qvec").cast(vec).alias("vec"),
                    F.lit(0).alias("cell"))
    right = c.select(F.pmod(F.xxhash64("vec_id"), F.lit(stripes)).cast("int").alias("_s"),
                     F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"), F.lit(1).alias("side"),
                     F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), "vec_id",
                     F.col("vec").cast(vec).alias("vec"), cell.cast("int").alias("cell"))
    dealt = left.unionByName(right).repartitionById(groups * stripes, F.col("_g") * stripes + F.col("_s")) \
        .sortWithinPartitions("side", "cell").select("side", "query_id", "vec_id", "vec", "cell")

    def scan(batches):
        qids, mats, top, asked = [], [], None, None
        for batch in batches:
            n = int(np.searchsorted(batch.column(0).to_numpy(), 1))
            if n:
                qids.append(batch.column(1).slice(0, n))
                mats.append(_matrix(batch.column(3).slice(0, n), dim))
            if n == batch.num_rows or not mats:
                continue
            if top is None:
                mat = np.concatenate(mats)
                mats = [mat]
                top, asked = _TopK(mat, k, decimals), meet(mat) if meet else None
            rest = batch.slice(n)
            ids, x, own = rest.column(2).to_numpy(), _matrix(rest.column(3), dim), rest.column(4).to_numpy()
            if asked is None:
                top.add(ids, x)
                continue
            edges = np.flatnonzero(np.insert(own[1:] != own[:-1], 0, True))
            for s, e in zip(edges, [*edges[1:], len(own)]):
                top.add(ids[s:e], x[s:e], asked(own[s]))
        if top is not None:
            yield from top.results(pa.concat_arrays(qids))
    return dealt.mapInArrow(scan, _cand_schema(q))


def _blocked_candidates(probes: DataFrame, cells: DataFrame, k: int,
                        block_rows: int, groups: int,
                        decimals: int | None = None) -> DataFrame:
    """probes(query_id, qvec, cell), cells(vec_id, vec, cell) -> local top-k rows.

    Cell sizes come from one aggregate (one row per cell, bounded by nlist);
    a cell of n rows is split into ceil(n / block_rows) blocks by a hash of
    the id, and every probe of that cell is replicated to each block.
    """
    sizes = (cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
             .select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows)))
                     .cast("int").alias("n_blocks")))
    c = (cells.join(F.broadcast(sizes), "cell")
         .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int"))
         .withColumn("qgroup", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
         .drop("n_blocks"))
    p = (probes.join(F.broadcast(sizes), "cell")
         .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
         .withColumn("qgroup", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
         .drop("n_blocks"))

    def local(cpdf: pd.DataFrame, qpdf: pd.DataFrame) -> pd.DataFrame:
        if len(cpdf) == 0 or len(qpdf) == 0:
            return pd.DataFrame({"query_id": pd.Series([], dtype=qpdf["query_id"].dtype),
                                 "vec_id": pd.Series([], dtype="int64"),
                                 "distance": pd.Series([], dtype="float64")})
        top = _TopK(_stack(qpdf["qvec"]), k, decimals)
        top.add(cpdf["vec_id"].to_numpy(np.int64), _stack(cpdf["vec"]))
        row, col = np.nonzero(np.isfinite(top.near))
        return pd.DataFrame({"query_id": qpdf["query_id"].to_numpy()[row], "vec_id": top.ids[row, col],
                             "distance": top.exact[row, col]})

    keys = ["cell", "block", "qgroup"]
    return c.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(local, _cand_schema(probes))


# ---------------------------------------------------------------------------
# IVF: cell assignment (K4) and cell-pruned search
# ---------------------------------------------------------------------------

def build_ivf(corpus: DataFrame, nlist: int, sample_rows: int | None = None, seed: int = 42,
              corpus_id: str = "vec_id", corpus_vec: str = "embedding",
              max_iter: int = 20):
    """K4: train k-means on all vectors (or on about ``sample_rows`` of them, if
    asked), assign every vector to its nearest cell.

    Returns (assigned corpus (vec_id, embedding, cell), centroids (cell, center)).
    Training is distributed (pyspark.ml); the centroid table is nlist x dim.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    base = corpus.select(F.col(corpus_id).alias("vec_id"), F.col(corpus_vec).alias("embedding"))
    train = base
    if sample_rows is not None and (n := base.count()) > sample_rows:
        train = base.sample(False, sample_rows / n, seed)
    train = train.select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, initMode="k-means||",
                   featuresCol="features", predictionCol="cell").fit(train)
    assigned = (model.transform(base.withColumn("features", array_to_vector("embedding")))
                .select("vec_id", "embedding", F.col("cell").cast("int")))
    spark = corpus.sparkSession
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = spark.createDataFrame(centers, "cell int, center array<double>")
    return assigned, centroids


def probe_cells(queries: DataFrame, centroids: DataFrame, nprobe: int,
                query_id: str = "query_id", query_vec: str = "embedding",
                broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Per query, the ``nprobe`` closest cells -> (query_id, qvec, cell).

    The centroids (nlist x dim) are broadcast in parts of at most
    ``broadcast_limit`` bytes while queries are streamed; with several parts
    the closest cells of each are ranked together per query.
    """
    size = centroids.agg(F.count(F.lit(1)), F.max(F.size("center"))).first()
    parts = max(1, math.ceil((size[0] or 0) * (size[1] or 0) * 8 / broadcast_limit))
    found = [_probe_part(queries, centroids.where(F.pmod("cell", F.lit(parts)) == p), nprobe,
                         query_id, query_vec) for p in range(parts)]
    if parts == 1:
        return found[0].drop("_d")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    closest = Window.partitionBy("query_id").orderBy("_d", "cell")
    return (every.withColumn("_r", F.row_number().over(closest)).where(F.col("_r") <= nprobe)
            .select("query_id", "qvec", "cell"))


def assign_cells(corpus: DataFrame, centroids: DataFrame, corpus_id: str = "vec_id",
                 corpus_vec: str = "embedding") -> DataFrame:
    """K4 with given centres: (vec_id, embedding, cell) by the nearest one."""
    return probe_cells(corpus, centroids, 1, corpus_id, corpus_vec) \
        .select(F.col("query_id").alias("vec_id"), F.col("qvec").alias("embedding"), "cell")


def _probe_part(queries: DataFrame, centroids: DataFrame, nprobe: int,
                query_id: str, query_vec: str) -> DataFrame:
    """(query_id, qvec, cell, _d): the closest cells among some centroids."""
    spark = queries.sparkSession
    ct = centroids.orderBy("cell").toArrow()
    cells = np.asarray(ct.column("cell").to_pylist(), dtype=np.int64)
    cmat = _stack(ct.column("center").to_pylist())
    bc = spark.sparkContext.broadcast((cells, cmat))
    npr = min(nprobe, len(cells))

    def probe(batches):
        cid, cm = bc.value
        cn = (cm * cm).sum(1)
        for pdf in batches:
            if len(pdf) == 0 or npr == 0:
                continue
            qm = _stack(pdf["qvec"])
            d = (qm * qm).sum(1)[:, None] + cn[None, :] - 2.0 * qm @ cm.T
            o = np.lexsort((np.broadcast_to(cid, d.shape), d), axis=1)[:, :npr]
            rep = np.repeat(np.arange(len(pdf)), npr)
            yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[rep],
                                "qvec": pdf["qvec"].to_numpy()[rep],
                                "cell": cid[o.ravel()].astype("int32"),
                                "_d": np.take_along_axis(d, o, 1).ravel()})

    q = queries.select(F.col(query_id).alias("query_id"),
                       F.col(query_vec).alias("qvec")).where(F.col("qvec").isNotNull())
    qt = q.schema["query_id"].dataType.simpleString()
    vt = q.schema["qvec"].dataType.simpleString()
    return q.mapInPandas(probe, f"query_id {qt}, qvec {vt}, cell int, _d double")


def knn_ivf(queries: DataFrame, assigned: DataFrame, centroids: DataFrame,
            nprobe: int, k: int = 10, query_id: str = "query_id",
            query_vec: str = "embedding", block_rows: int = KNN_BLOCK_ROWS,
            broadcast_limit: int = BROADCAST_LIMIT_BYTES,
            tie_decimals: int | None = None) -> DataFrame:
    """Search only the ``nprobe`` nearest cells.  nprobe = nlist is exact.

    A semi-join with the cells probed keeps the others from being shuffled
    (and from being read, when the vectors are stored by cell)."""
    probes = probe_cells(queries, centroids, nprobe, query_id, query_vec, broadcast_limit)
    q, _ = _prep(queries, assigned, query_id, query_vec, "vec_id", "embedding")
    n_q, dim = query_side_size(q)
    groups = max(1, math.ceil(n_q * max(dim, 1) * 8 / broadcast_limit))
    cells = assigned.select("vec_id", F.col("embedding").alias("vec"), "cell") \
        .join(probes.select("cell").distinct(), "cell", "left_semi")
    return _final_topk(_blocked_candidates(probes, cells, k, block_rows, groups, tie_decimals),
                       k, tie_decimals)


def index_stats(assigned: DataFrame, nlist: int, nprobe: int) -> DataFrame:
    """Vectors, dim, nlist, used cells, probed share % and cell-size skew."""
    per_cell = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"),
                                            F.max(F.size("embedding")).alias("d"))
    stats = per_cell.agg(F.sum("n").alias("n_vectors"), F.max("d").alias("dim"),
                         F.count(F.lit(1)).alias("used_cells"),
                         F.max("n").alias("max_cell"), F.avg("n").alias("avg_cell"))
    return (stats
            .withColumn("nlist", F.lit(nlist))
            .withColumn("probed_pct", F.lit(min(nprobe, nlist) / nlist * 100.0))
            .withColumn("cell_skew", F.col("max_cell") / F.col("avg_cell")))
