"""Means over the rows before, without a task per key.

Rows are ranged on (keys, order) and numbered through; positions are cut into
blocks, and every block also gets the ``n - 1`` rows before it (its halo: at
most n - 1 rows a block are sent twice).  Each block is a window of its own, so
a key with a third of all rows is as many windows as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut_lineage

#: Rows of one window.
BLOCK_ROWS = 100_000


def numbered(df: DataFrame, order: list[str], out: str = "_pos") -> DataFrame:
    """``df`` with 0-based positions in the order of the columns (rows equal in
    all of them in any order): places within the ranges of a written range
    partitioning plus the rows of the ranges before."""
    # the row's own place splits ranges of equal rows and fixes their order
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order, "_row")
                       .sortWithinPartitions(*order, "_row").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_part").withColumn(out, F.col("_start") + F.col("_at")) \
        .drop("_part", "_start", "_at", "_row")


def trailing_mean(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, out: str,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of a key's last ``n`` values up to each row, in ``order``.  Null
    values are left out (a row without values before it gets null); a null key
    is a key of its own."""
    rows = numbered(df.select(*dict.fromkeys([*keys, *order, value])), [*keys, *order])
    block = F.floor(F.col("_pos") / block_rows)
    # the last rows of a block are the halo of the next (of several, if blocks are short)
    reach = F.floor((F.col("_pos") + (n - 1)) / block_rows)
    dealt = rows.withColumn("_block", F.explode(F.sequence(block, reach))) \
        .withColumn("_own", F.col("_block") == block)
    # runs of one key within a block; a halo row only lends its value
    last = Window.partitionBy("_block", *keys).orderBy("_pos").rowsBetween(1 - n, 0)
    return dealt.withColumn(out, F.avg(value).over(last)).where("_own").drop("_block", "_own", "_pos")
