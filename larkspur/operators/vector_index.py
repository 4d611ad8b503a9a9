"""A cell index whose cells are trained, stored and pruned.

Training has two levels, so the number of cells can grow with the rows.  A
bounded sample (smallest hashes of the id, ``TRAIN_PER_CELL`` rows a cell)
gives the *groups* by k-means; a second sample, dealt by group, is clustered
group by group into *cells*, as many as the group's rows ask for.  Every sound
vector is then put into the nearest cell of its nearest group, in a map.

Storage: one folder per group, rows sorted by cell within it.  A search
broadcasts the probed (group, cell) list: Spark prunes the folders of groups
that no query probes (dynamic partition pruning) and a map over the rest
compares each cell's rows only with the queries that probe it.

The number of cells to probe comes from measured recall (``calibrate``): true
neighbours of a sample of queries are looked up, and the rank of their cell
among all cells (nearest first) tells which share a given number of probes
finds; the smallest number that reaches the wanted share is stored with the
index.

Null vectors and vectors with non-finite components have no cell and are not
indexed; vectors of another dimension raise.  Ties go to the smaller cell and
the smaller id.  An empty corpus gives an empty index, in which every search is
empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.constants import BROADCAST_LIMIT_BYTES, KNN_BLOCK_ROWS
from larkspur.operators.knn import (_blocked_candidates, _broadcast_candidates, _final_topk, _matrix,
                                    _streamed_candidates, _TopK, knn_exact, query_side_size)
from larkspur.session import cut_lineage

#: Cells for n vectors: ``CELLS_PER_ROOT`` times the root of n.
CELLS_PER_ROOT = 4
#: Training rows a cell, and what one training task may hold.
TRAIN_PER_CELL = 64
TRAIN_BYTES = 64 * 1024 * 1024
#: Distances to centres computed at once in a search task.
_PROBE_BYTES = 8 * 1024 * 1024
#: Queries whose recall is measured, and the share of true neighbours wanted.
CALIBRATION_QUERIES = 256
TARGET_RECALL = 0.95


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` distinct centres of the rows of ``x`` (spread-out starts,
    then Lloyd rounds; an emptied centre moves to the worst-served row)."""
    rng = np.random.default_rng(seed)
    first = x[rng.integers(len(x))]
    centres, near = [first], ((x - first) ** 2).sum(1)
    while len(centres) < min(k, len(x)):
        total = near.sum()
        if not total > 1e-12:
            break                                       # all rows are centres already
        centres.append(x[np.searchsorted(np.cumsum(near), rng.random() * total, "right").clip(0, len(x) - 1)])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    for _ in range(rounds):
        d = _distances(x, c)
        own = d.argmin(1)
        size = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        new = sums / np.maximum(size, 1)[:, None]
        empty = np.flatnonzero(size == 0)
        if len(empty):
            new[empty] = x[np.argsort(-d.min(1), kind="stable")[:len(empty)]]
        if np.allclose(new, c, rtol=0, atol=1e-9):
            break
        c = new
    return c


def sound_vectors(corpus: DataFrame, corpus_id: str = "vec_id", corpus_vec: str = "embedding") -> DataFrame:
    """(vec_id, embedding) without null, NaN or infinite components."""
    finite = F.forall(corpus_vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return corpus.select(F.col(corpus_id).cast("long").alias("vec_id"), F.col(corpus_vec).alias("embedding")) \
        .where(F.col("embedding").isNotNull() & finite)


def _bounded_sample(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit("train"), "vec_id"), "vec_id").limit(n)


def train_cells(corpus: DataFrame, nlist: int, seed: int = 42) -> DataFrame:
    """(cell, cell_group, center, group_center): about ``nlist`` cells.

    ``corpus`` holds sound vectors.  One task trains the groups on at most
    ``TRAIN_BYTES`` of rows, one task per group its cells on at most
    ``KNN_BLOCK_ROWS`` of rows; rows are picked by a hash of the id."""
    spark = corpus.sparkSession
    row = corpus.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n, dim = int(row.n), int(row.d or 0)
    schema = "cell int, cell_group int, center array<double>, group_center array<double>"
    if not n:
        return spark.createDataFrame([], schema)
    groups = max(1, round(math.sqrt(nlist)))
    room = max(1, TRAIN_BYTES // (8 * dim))
    sample = _bounded_sample(corpus, min(room, TRAIN_PER_CELL * groups)).toArrow()
    centres = k_means(_matrix(sample.column("embedding").combine_chunks(), dim), groups, seed)
    shared = spark.sparkContext.broadcast(centres)

    # the second sample: every row whose hash is low enough, TRAIN_PER_CELL rows a cell on average
    share = min(1.0, TRAIN_PER_CELL * nlist / n)
    picked = corpus.where(F.pmod(F.xxhash64(F.lit("cells"), "vec_id"), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))

    def nearest(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            yield pa.record_batch([batch.column(0), batch.column(1),
                                   pa.array(_distances(x, shared.value).argmin(1).astype(np.int32))],
                                  names=["vec_id", "embedding", "cell_group"])
    vec_type = picked.schema["embedding"].dataType.simpleString()
    dealt = picked.mapInArrow(nearest, f"vec_id long, embedding {vec_type}, cell_group int")
    order = Window.partitionBy("cell_group").orderBy(F.xxhash64("vec_id"), "vec_id")
    most = max(TRAIN_PER_CELL, min(KNN_BLOCK_ROWS, room))
    dealt = dealt.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].map(lambda v: np.asarray(v, np.float64)))
        wanted = max(1, round(len(x) * nlist / max(1.0, share * n)))
        c = k_means(x, wanted, seed + int(pdf["cell_group"].iloc[0]))
        return pd.DataFrame({"cell_group": int(pdf["cell_group"].iloc[0]), "center": [v.tolist() for v in c]})
    trained = dealt.groupBy("cell_group").applyInPandas(cells, "cell_group int, center array<double>")
    rows = trained.toArrow().to_pylist()                  # nlist centres, kept below the bound by parts()
    seen = {r["cell_group"] for r in rows}
    rows += [{"cell_group": g, "center": centres[g].tolist()} for g in range(len(centres)) if g not in seen]
    rows.sort(key=lambda r: (r["cell_group"], r["center"]))
    return spark.createDataFrame([(k, r["cell_group"], r["center"], centres[r["cell_group"]].tolist())
                                  for k, r in enumerate(rows)], schema)


def _parts(table: pa.Table, limit: int) -> list[pa.Table]:
    """The cells, group by group, in parts of at most ``limit`` bytes (or one group)."""
    group = table.column("cell_group").to_numpy()
    starts = np.flatnonzero(np.insert(group[1:] != group[:-1], 0, True)) if len(group) else np.empty(0, int)
    ends = np.append(starts[1:], len(group))
    row = 8 * len(table.column("center")[0].as_py()) if len(group) else 1
    parts, lo = [], 0
    for s, e in zip(starts, ends):
        if e - lo > max(1, limit // row) and s > lo:
            parts.append(table.slice(lo, s - lo))
            lo = s
    return parts + [table.slice(lo)] if len(group) else []


def _stacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, group, centres, centres of the groups present in order)."""
    dim = len(table.column("center")[0].as_py())
    group = table.column("cell_group").to_numpy()
    flat = [_matrix(table.column(c).combine_chunks(), dim) for c in ("center", "group_center")]
    return table.column("cell").to_numpy(), group, flat[0], flat[1]


def assign(corpus: DataFrame, cells: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(vec_id, embedding, cell, cell_group) of every sound vector: the nearest
    cell of the nearest group.  Centres are broadcast in parts below ``limit``."""
    spark = corpus.sparkSession
    table = cells.orderBy("cell_group", "cell").toArrow()
    schema = (f"vec_id long, embedding {corpus.schema['embedding'].dataType.simpleString()}, "
              "cell int, cell_group int")
    if not table.num_rows:
        return spark.createDataFrame([], schema)
    cell, group, centre, group_centre = _stacked(table)
    first = np.flatnonzero(np.insert(group[1:] != group[:-1], 0, True))
    top = spark.sparkContext.broadcast((group[first], group_centre[first]))
    out = None
    for part in _parts(table, limit):
        fine = spark.sparkContext.broadcast(_stacked(part)[:3])

        def place(batches, fine=fine):
            group_no, group_mat = top.value
            cell_no, cell_group, mat = fine.value
            for batch in batches:
                x = _matrix(batch.column(1), mat.shape[1])
                own = group_no[_distances(x, group_mat).argmin(1)]
                found = np.full(len(x), -1, np.int32)
                for g in np.unique(own):
                    lo, hi = np.searchsorted(cell_group, [g, g + 1])
                    if hi > lo:
                        at = np.flatnonzero(own == g)
                        found[at] = cell_no[lo:hi][_distances(x[at], mat[lo:hi]).argmin(1)]
                mine = pa.array(found >= 0)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found),
                                       pa.array(own.astype(np.int32))],
                                      names=["vec_id", "embedding", "cell", "cell_group"]).filter(mine)
        placed = corpus.mapInArrow(place, schema)
        out = placed if out is None else out.unionByName(placed)
    return out


class VectorIndex:
    """A stored index: ``vectors`` (by cell_group, sorted by cell), ``cells``
    and the numbers found when it was built."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.cells = spark.read.parquet(f"{path}/cells")
        self.vectors = spark.read.schema("vec_id long, embedding array<float>, cell int, cell_group int") \
            .parquet(f"{path}/vectors")
        facts = spark.read.parquet(f"{path}/facts").first()
        self.nlist, self.nprobe, self.recall = facts.nlist, facts.nprobe, facts.recall

    @classmethod
    def build(cls, corpus: DataFrame, path: str, nlist: int | None = None, k: int = 10,
              target: float = TARGET_RECALL, seed: int = 42, corpus_id: str = "vec_id",
              corpus_vec: str = "embedding") -> VectorIndex:
        """Trains, writes and calibrates an index of every sound vector.  The
        facts are written last: a folder without them is not an index."""
        spark = corpus.sparkSession
        rows = sound_vectors(corpus, corpus_id, corpus_vec) \
            .withColumn("embedding", F.col("embedding").cast("array<float>"))
        if nlist is None:
            nlist = max(1, round(CELLS_PER_ROOT * math.sqrt(rows.count())))
        train_cells(rows, nlist, seed).write.mode("overwrite").parquet(f"{path}/cells")
        cells = spark.read.parquet(f"{path}/cells")
        # a group beyond the advised partition size is split over several tasks
        assign(rows, cells).hint("rebalance", F.col("cell_group")).sortWithinPartitions("cell_group", "cell") \
            .write.mode("overwrite").partitionBy("cell_group").parquet(f"{path}/vectors")
        vectors = spark.read.schema("vec_id long, embedding array<float>, cell int, cell_group int") \
            .parquet(f"{path}/vectors")
        nlist = cells.count()
        nprobe, recall = calibrate(vectors, cells, k, target)
        spark.createDataFrame([(nlist, nprobe, recall)], "nlist int, nprobe int, recall double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, query_id: str = "query_id",
               query_vec: str = "embedding", limit: int = BROADCAST_LIMIT_BYTES,
               block_rows: int = KNN_BLOCK_ROWS) -> DataFrame:
        """(query_id, rank, vec_id, distance): the nearest vectors of the
        ``nprobe`` nearest cells (calibrated, if not given)."""
        q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qvec")) \
            .where(F.col("qvec").isNotNull())
        return search_cells(q, self.vectors, self.cells, nprobe or self.nprobe, k, limit, block_rows)

    def stats(self) -> DataFrame:
        """Vectors, dimension, cells and how evenly they are filled."""
        per_cell = self.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"))
        return per_cell.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors"), F.max("d").alias("dim"),
                            F.count(F.lit(1)).alias("used_cells"), F.max("n").alias("max_cell"),
                            F.avg("n").alias("avg_cell")) \
            .withColumns({"nlist": F.lit(self.nlist), "nprobe": F.lit(self.nprobe), "recall": F.lit(self.recall),
                          "probed_pct": F.lit(100.0 * self.nprobe / max(1, self.nlist)),
                          "cell_skew": F.try_divide("max_cell", "avg_cell")})


def probe(queries: DataFrame, cells: DataFrame, nprobe: int, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(query_id, qvec, cell, cell_group, place): the nearest cells of every
    query, from 0.  Centres are broadcast in parts below ``limit``."""
    spark = queries.sparkSession
    schema = (f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
              f"qvec {queries.schema['qvec'].dataType.simpleString()}, cell int, cell_group int, d double")
    parts = _parts(cells.orderBy("cell_group", "cell").toArrow(), limit)
    found = []
    for part in parts:
        shared = spark.sparkContext.broadcast(_stacked(part)[:3])

        def near(batches, shared=shared):
            cell, group, mat = shared.value
            m = min(nprobe, len(cell))
            for batch in batches:
                for lo in range(0, batch.num_rows, max(1, limit // (8 * len(cell)))):
                    piece = batch.slice(lo, max(1, limit // (8 * len(cell))))
                    d = _distances(_matrix(piece.column(1), mat.shape[1]), mat)
                    d[~np.isfinite(d)] = np.inf
                    best = np.argsort(d, axis=1, kind="stable")[:, :m]
                    rep = pa.array(np.repeat(np.arange(piece.num_rows), m))
                    yield pa.record_batch(
                        [piece.column(0).take(rep), piece.column(1).take(rep), pa.array(cell[best.ravel()]),
                         pa.array(group[best.ravel()]), pa.array(np.take_along_axis(d, best, 1).ravel())],
                        names=["query_id", "qvec", "cell", "cell_group", "d"])
        found.append(queries.mapInArrow(near, schema))
    if not found:
        return spark.createDataFrame([], schema.rsplit(",", 1)[0] + ", place int")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("query_id").orderBy("d", "cell")
    return every.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < nprobe).drop("d")


def _meeting(cells: DataFrame, nprobe: int):
    """mat -> (cell -> the queries of ``mat``, by number, that probe it), from
    broadcast centres; a group's answers are kept as bits (cells * queries / 8 bytes)."""
    cell, _, centre, _ = _stacked(cells.orderBy("cell_group", "cell").toArrow())
    shared = cells.sparkSession.sparkContext.broadcast((cell, centre))

    def meet(mat: np.ndarray):
        cell, centre = shared.value
        step = 8 * max(1, _PROBE_BYTES // (64 * len(cell)))
        bits = []
        for lo in range(0, len(mat), step):
            d = _distances(mat[lo:lo + step], centre)
            d[~np.isfinite(d)] = np.inf
            probed = np.zeros(d.shape, bool)
            np.put_along_axis(probed, np.argsort(d, axis=1, kind="stable")[:, :nprobe], True, 1)
            bits.append(np.packbits(probed, axis=0))
        bits, by_cell = np.concatenate(bits), np.argsort(cell)

        def asked(number: int) -> np.ndarray:
            at = by_cell[np.searchsorted(cell, number, sorter=by_cell)]
            return np.flatnonzero(np.unpackbits(bits[:, at], count=len(mat)))
        return asked
    return meet


def search_cells(q: DataFrame, vectors: DataFrame, cells: DataFrame, nprobe: int, k: int,
                 limit: int = BROADCAST_LIMIT_BYTES, block_rows: int = KNN_BLOCK_ROWS) -> DataFrame:
    """Top k of the probed cells.  A batch of queries that fits the bound is
    broadcast and the pruned vectors stream past it; of a larger one a task
    holds a group, past which a stripe of the cells streams.  Only if the
    centres are beyond the bound, too, do probes meet blocks of cells by row.
    With all cells probed, all queries meet all rows and no probe is listed."""
    spark = q.sparkSession
    n_q, dim = query_side_size(q)
    nlist = cells.count()
    stored = vectors.select("vec_id", F.col("embedding").alias("vec"), "cell")
    if nprobe >= nlist and n_q * max(dim, 1) * 8 <= limit:
        return _final_topk(_broadcast_candidates(q, stored.drop("cell"), k), k)
    if n_q * (dim + 4 * k + nprobe) * 8 > limit and nlist * dim * 8 <= limit:
        all_cells = nprobe >= nlist
        n_groups = math.ceil(n_q * (8 * dim if all_cells else max(8 * dim, nlist / 8)) / limit)
        return _final_topk(_streamed_candidates(q, stored, k, max(1, n_groups), dim,
                                                meet=None if all_cells else _meeting(cells, nprobe)), k)
    probes = probe(q, cells, nprobe, limit)
    small = n_q * (dim + 4 * k + nprobe) * 8 <= limit
    if small:
        probes = probes.select("query_id", "cell", "cell_group", "place")
    probes = cut_lineage(probes)
    # at most one row per cell: nlist rows of 8 bytes are the bound of this broadcast
    groups = probes.where(F.col("place") >= 0).select("cell_group").distinct()
    pruned = vectors.join(F.broadcast(groups), "cell_group", "left_semi")
    if not small:
        kept = pruned.join(probes.select("cell").distinct(), "cell", "left_semi") \
            .select("vec_id", F.col("embedding").alias("vec"), "cell")
        n_groups = max(1, math.ceil(n_q * max(dim, 1) * 8 / limit))
        return _final_topk(_blocked_candidates(probes.select("query_id", "qvec", "cell"), kept, k, block_rows,
                                               n_groups), k)
    asked = q.orderBy("query_id").toArrow()
    listed = probes.select("query_id", "cell").toArrow()
    id_type = asked.schema.field("query_id").type
    names = asked.column("query_id").to_pylist()
    mat = _matrix(asked.column("qvec").combine_chunks(), dim) if n_q else np.zeros((0, dim))
    number = {name: j for j, name in enumerate(names)}
    cell = listed.column("cell").to_numpy()
    who = np.array([number[name] for name in listed.column("query_id").to_pylist()], np.int64)
    order = np.argsort(cell, kind="stable")
    shared = spark.sparkContext.broadcast((mat, cell[order], who[order]))

    def scan(batches):
        mat, cell, who = shared.value
        top = _TopK(mat, k)
        for batch in batches:
            own = batch.column(2).to_numpy()
            by_cell = np.argsort(own, kind="stable")
            edges = np.flatnonzero(np.insert(own[by_cell][1:] != own[by_cell][:-1], 0, True)) if len(own) else []
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), mat.shape[1]) if len(mat) else None
            for s, e in zip(edges, [*edges[1:], len(own)]):
                lo, hi = np.searchsorted(cell, [own[by_cell[s]], own[by_cell[s]] + 1])
                if hi > lo:
                    at = by_cell[s:e]
                    top.add(ids[at], x[at], who[lo:hi])
        yield from top.results(pa.array(names, id_type))
    found = pruned.select("vec_id", "embedding", "cell").mapInArrow(
        scan, f"query_id {q.schema['query_id'].dataType.simpleString()}, vec_id long, distance double")
    return _final_topk(found, k)


def calibrate(vectors: DataFrame, cells: DataFrame, k: int = 10, target: float = TARGET_RECALL,
              n_queries: int = CALIBRATION_QUERIES, limit: int = BROADCAST_LIMIT_BYTES) -> tuple[int, float]:
    """(nprobe, recall): the fewest probes that find ``target`` of the true
    neighbours of ``n_queries`` vectors picked by a hash of their id.

    A neighbour is found with p probes if fewer than p cells are nearer to the
    query than the neighbour's cell, so one exact search of the sample gives
    the recall of every p at once."""
    spark = vectors.sparkSession
    table = cells.orderBy("cell_group", "cell").toArrow()
    picked = vectors.orderBy(F.xxhash64(F.lit("calibrate"), "vec_id"), "vec_id").limit(n_queries) \
        .select(F.col("vec_id").alias("query_id"), "embedding").toArrow()
    if not picked.num_rows:
        return 1, 1.0
    q = spark.createDataFrame(picked)
    true = knn_exact(q, vectors, k=k).select("query_id", "vec_id")
    own = vectors.select("vec_id", "cell").join(F.broadcast(true), "vec_id").select("query_id", "cell") \
        .toArrow()                                       # n_queries * k rows
    number = {name: j for j, name in enumerate(picked.column("query_id").to_pylist())}
    dim = len(picked.column("embedding")[0].as_py())
    mat = _matrix(picked.column("embedding").combine_chunks(), dim)
    who = np.array([number[j] for j in own.column("query_id").to_pylist()], np.int64)
    cell = own.column("cell").to_numpy()
    number_, _, centre, _ = _stacked(table)
    at = np.empty(int(number_.max()) + 1, np.int64)
    at[number_] = np.arange(len(number_))
    d_own = ((mat[who] - centre[at[cell]]) ** 2).sum(1)
    nearer = np.zeros(len(who), np.int64)
    step = max(1, limit // (8 * len(mat)))
    for lo in range(0, len(centre), step):
        d = _distances(mat, centre[lo:lo + step])
        nearer += (d[who] < d_own[:, None] - 1e-9).sum(1)
    ranks = np.sort(nearer)
    need = max(0, math.ceil(target * len(ranks)) - 1)
    nprobe = int(ranks[need]) + 1
    return nprobe, float((ranks < nprobe).mean())
