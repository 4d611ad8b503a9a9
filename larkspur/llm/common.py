"""Shared pieces of the operators: table access, written intermediate tables,
Arrow-batch mapping and distributed connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import shared_dir, ship_package


SLICE_ROWS = 256


def open_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; also ships the package to the workers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame under the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can reach, so a lost executor
    never forces the work before this point to run again."""
    path = shared_dir(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch],
                schema: T.StructType | str) -> DataFrame:
    """``fn`` on slices of at most ``SLICE_ROWS`` rows of every Arrow batch of
    ``df`` (no shuffle); slices bound what a worker holds as Python objects."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                yield fn(batch.slice(lo, SLICE_ROWS))
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, batch.schema.field(at), values.cast(batch.schema.field(at).type))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b: long), where the
    component is the smallest id reachable.

    Each round points every node at its smallest neighbour, follows the
    pointers to their roots (doubling the distance each time) and contracts
    the edges to the roots, so the nodes left at least halve.  Every step is a
    join or a grouped minimum over written tables: nothing is collected, and
    a hub is only ever the repeated side of a join, which AQE can split.

    Null ends and self loops are ignored; repeated edges do no harm; no edges
    give no rows."""
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    found = None                                    # (id, component) so far
    while True:
        edges = materialise(edges, "edges")
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = materialise(
            both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
            .select("id", F.least("id", "low").alias("root")), "roots")
        while True:
            up = root.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = materialise(
                root.join(up, "root").select("id", "root", "next"), "jumps")
            moved = not jumped.where("next <> root").isEmpty()
            root = jumped.select("id", F.col("next").alias("root"))
            if not moved:
                break
        if found is None:
            found = root.select("id", F.col("root").alias("component"))
        else:
            step = root.select(F.col("id").alias("component"), "root")
            found = materialise(
                found.join(step, "component", "left")
                .select("id", F.coalesce("root", "component").alias("component")), "components")
        a = root.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = root.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = (edges.join(a, "a").join(b, "b").where("ra <> rb")
                 .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                 .distinct())
    if found is None:
        spark = edges.sparkSession
        return spark.createDataFrame([], "id long, component long")
    return found


def map_units(df: DataFrame, unit: list[str], fn: Callable[[pa.Table], pa.Table | None],
              schema: str) -> DataFrame:
    """``fn`` on the rows of every unit (equal values in the ``unit`` columns).

    Rows are dealt by unit and sorted, then the units are cut from the stream
    of Arrow batches; a unit must have a bounded number of rows, and many small
    ones cost no more than their rows."""
    dealt = df.repartition(*unit).sortWithinPartitions(*unit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in unit)))
            at = 0
            for k in range(n):
                if keys[k] != last:
                    if k > at:
                        held.append(batch.slice(at, k - at))
                    if held:
                        yield from emit(held)
                    held, at, last = [], k, keys[k]
            held.append(batch.slice(at))
        if held:
            yield from emit(held)

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fn(pa.Table.from_batches(parts).combine_chunks())
        if out is not None and out.num_rows:
            yield from out.to_batches()
    return dealt.mapInArrow(cut, schema)


class IdFilter:
    """A bitmap of hashed ids: ``column(id)`` may be in the set, or surely not.

    Built by grouped bitmap aggregates, 16 bits per id up to ``MAX_BITS`` in
    all (32 MB), which bounds the broadcast; a fuller bitmap only lets more
    strangers through, so an exact join has to follow."""

    MIN_BITS, MAX_BITS = 1 << 15, 1 << 28

    def __init__(self, ids: DataFrame, col: str):
        n = ids.count()
        self.bits = self.MIN_BITS
        while self.bits < min(16 * n, self.MAX_BITS):
            self.bits *= 2
        at = self.column(F.col(col))
        rows = (ids.where(F.col(col).isNotNull())
                .groupBy(F.bitmap_bucket_number(at).alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect())
        flags = bytearray(self.bits // 8)
        for r in rows:
            flags[(r.bucket - 1) * 4096:(r.bucket - 1) * 4096 + len(r.bits)] = r.bits
        self.flags = ids.sparkSession.sparkContext.broadcast(bytes(flags))

    def column(self, id_col: F.Column) -> F.Column:
        """Place of an id in the bitmap, from 1."""
        return F.pmod(F.xxhash64(id_col), F.lit(self.bits)) + 1

    @staticmethod
    def hits(flags: bytes, places: pa.Array):
        import numpy as np
        at = places.to_numpy(zero_copy_only=False).astype(np.int64) - 1
        table = np.frombuffer(flags, np.uint8)
        return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
