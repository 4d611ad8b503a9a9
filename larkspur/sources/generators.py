"""Deterministic generators, all keyed by an id column so the
work is spread by Spark (``spark.range`` or an id column of a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.constants import BROADCAST_LIMIT_BYTES, CORPUS_CONTENT, CORPUS_ISSUE_MODULUS
from larkspur.sources.tables import category_of


def corpus_from_ids(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Template documents for every id: title, content with id % 100,
    category by id % 4."""
    i = F.col(id_col).cast("long")
    head, tail = CORPUS_CONTENT.split("{i}")
    mid, end = tail.split("{m}")
    content = F.concat(F.lit(head), i.cast("string"), F.lit(mid),
                       F.pmod(i, F.lit(CORPUS_ISSUE_MODULUS)).cast("string"), F.lit(end))
    return ids.select(i.alias("doc_id"),
                      F.concat(F.lit("Document "), i.cast("string")).alias("title"),
                      content.alias("content"), category_of(i).alias("category"))


def generate_corpus(spark, n: int, partitions: int | None = None) -> DataFrame:
    """S10 over ``spark.range(n)``."""
    return corpus_from_ids(spark.range(0, n, 1, partitions).withColumnRenamed("id", "doc_id"))


def vectors_from_ids(ids: DataFrame, dim: int, seed: int = 42,
                     id_col: str = "doc_id") -> DataFrame:
    """Standard-normal vectors.  Each component is a hash of
    (seed, id, component) mapped through the Box-Muller transform, so a
    vector depends only on its id - not on partitioning or retries."""
    i = F.col(id_col).cast("long")
    comps = F.sequence(F.lit(0), F.lit(dim - 1))

    def unit(digest, at):
        """52 bits of the digest as a number strictly between 0 and 1."""
        h = F.conv(F.substring(digest, at, 13), 16, 10).cast("double")
        return (h + 0.5) / F.lit(float(1 << 52))

    digests = F.transform(comps, lambda j: F.md5(F.concat_ws(
        ":", F.lit(str(seed)), i.cast("string"), j.cast("string")).cast("binary")))
    gauss = F.transform(digests, lambda d: (F.sqrt(-2.0 * F.log(unit(d, 1))) *
                                            F.cos(F.lit(2.0 * 3.141592653589793) * unit(d, 14)))
                        .cast("float"))
    return ids.select(i.alias("vec_id"), gauss.alias("embedding"))


def number_list(items: DataFrame, order: str, out: str = "qpos") -> DataFrame:
    """0-based positions in the order of a column: ranks within the ranges of
    a range partitioning plus the counts of the ranges before."""
    from pyspark.sql import Window

    from larkspur.session import cut_lineage
    ranges = cut_lineage(items.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").count().select(
        "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return (ranges.withColumn("_rank", rank).join(starts, "_range")
            .withColumn(out, F.col("_start") + F.col("_rank") - 1).drop("_range", "_rank", "_start"))


def generate_requests(arrivals: DataFrame, queries: DataFrame, id_col: str = "id",
                      unique_suffix: bool = False, seed: int = 0) -> DataFrame:
    """Arrival i takes query number i % n_q of the ordered query list
    ``queries(qpos, query)``.

    The list is counted and broadcast only under the size bound; the optional
    suffix sha2("seed:id") makes every request text unique (defeats answer
    reuse) and is reproducible.
    """
    row = queries.agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.octet_length("query")).alias("b")).first()
    n_q, n_bytes = int(row["n"]), int(row["b"] or 0)
    if n_q == 0:
        raise ValueError("empty query list")
    side = queries.select(F.col("qpos").alias("_slot"), "query")
    if n_bytes + 32 * n_q <= BROADCAST_LIMIT_BYTES:
        side = F.broadcast(side)
    a = arrivals.withColumn("_slot", F.pmod(F.col(id_col), F.lit(n_q)))
    out = a.join(side, "_slot").drop("_slot")
    if unique_suffix:
        out = out.withColumn("query", F.concat(
            F.col("query"), F.lit(" #"),
            F.sha2(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")), 256)))
    return out
