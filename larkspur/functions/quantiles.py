"""A2: exact order statistics per group without putting a group in one task.

``rank_select`` returns the values at requested 1-based ranks inside each
group.  Rows are counted by (group, value) first, with map-side combine, so a
value that many rows share is one row; the counted values are range-partitioned
on (group keys, value), so a group holding a third of all rows is spread over
many partitions.  Per-partition totals (one row per partition and group) give
every partition's rank offset, and running counts are taken only in the
partitions that hold a requested rank.  The counted values are checkpointed to
the shared checkpoint folder so both passes read the same partitioning and the
lineage is cut (it survives executor loss).

``ranks_near`` does the same for ranks near known shares of a group, without
moving or writing the values: a quantile sketch (one aggregate) bounds each
wanted value, a second aggregate counts the rows between the bounds and keeps
only the values inside them.

The exclusive-method quantile (the default method of Python's
``statistics.quantiles``) and the median are expressed as ranks plus a
linear interpolation, so they are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.constants import BROADCAST_LIMIT_BYTES
from larkspur.session import shared_dir


def exclusive_quantile_ranks(L: Column, n: int, i: int) -> tuple[Column, Column]:
    """(j, delta) of cut point i of n for a group of L sorted values.

    m = L + 1, j = clamp(floor(i*m/n), 1, L-1), delta = i*m - j*n; the value is
    (x_j * (n - delta) + x_{j+1} * delta) / n.  For L = 1 the value is x_1.
    """
    m = L + 1
    j = F.least(F.greatest(F.floor(F.lit(i) * m / F.lit(n)), F.lit(1)), L - 1)
    j = F.when(L <= 1, F.lit(1)).otherwise(j).cast("long")
    delta = (F.lit(i) * m - j * F.lit(n)).cast("double")
    return j, delta


def rank_select(df: DataFrame, keys: list[str], value: str, wanted: DataFrame,
                partitions: int | None = None) -> DataFrame:
    """Values at ranks: wanted(keys..., r) -> (keys..., r, v).

    Rank 1 is the smallest value of the group; ties are equal values, so the
    result does not depend on how ties are ordered.
    """
    spark = df.sparkSession
    shared_dir(spark, unique=False)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
         .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
         .repartitionByRange(p, *keys, "_v")
         .withColumn("_pid", F.spark_partition_id())
         .checkpoint(eager=True))
    part = ["_pid", *keys]
    per_part = s.groupBy(*part).agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    targets = (offsets.join(wanted, keys)
               .where((F.col("r") > F.col("_off")) & (F.col("r") <= F.col("_off") + F.col("_n")))
               .select(*part, "r", (F.col("r") - F.col("_off")).alias("_at")))
    if targets.count() * 64 <= BROADCAST_LIMIT_BYTES:
        targets = F.broadcast(targets)
    upto = Window.partitionBy(*part).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    running = (s.join(targets.select(*part).distinct(), part, "left_semi")
               .withColumn("_to", F.sum("_c").over(upto)))
    return (running.join(targets, part)
            .where((F.col("_at") > F.col("_to") - F.col("_c")) & (F.col("_at") <= F.col("_to")))
            .select(*keys, "r", F.col("_v").alias("v")))


#: Relative rank error of the sketch, and the slack taken around a share.
SKETCH_ACCURACY, SLACK = 100_000, 1e-4
#: Groups of up to this many rows are counted value by value.
SMALL_GROUP = 50_000


def ranks_near(df: DataFrame, keys: list[str], value: str, wanted: DataFrame,
               shares: tuple[float, ...]) -> DataFrame:
    """Values at ranks: wanted(keys..., ranks array) -> (keys..., r, v).

    Every rank must lie within two places of one of the ``shares`` (ascending)
    of its group's rows.  The sketch's rank error is a tenth of the slack; a
    rank outside its bounds raises, so a returned value is exact.  What is
    sorted per group is its counted values between the bounds: about 2e-4 of
    its rows for each share.  Nothing is written and nothing is collected."""
    rows = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    asked = [q for p in shares for q in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
    bounds = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.percentile_approx("_v", F.array(*[F.lit(q) for q in asked]), SKETCH_ACCURACY).alias("_q"))
    small = F.col("_n") <= SMALL_GROUP
    # in a large group two places are less than the slack the error leaves
    bounds = bounds.select(*keys, *[
        F.when(small, F.col("_least" if k % 2 == 0 else "_most")).otherwise(F.col("_q")[k]).alias(f"_b{k}")
        for k in range(len(asked))])
    pairs = [(F.col(f"_b{2 * k}"), F.col(f"_b{2 * k + 1}")) for k in range(len(shares))]
    v, inside, above = F.col("_v"), F.lit(False), F.lit(0)
    for low, high in pairs:
        inside = inside | ((v >= low) & (v <= high))
        above = above + F.when(v > high, 1).otherwise(0)
    # a group's cells in order: its values between the bounds, and one count for each gap
    cells = (rows.join(bounds, keys).select(*keys, "_v", inside.alias("_in"), above.alias("_gap"))
             .groupBy(*keys, "_gap", F.when(F.col("_in"), v).alias("_cell"))
             .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_at")))
    upto = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    running = cells.withColumn("_to", F.sum("_c").over(upto))
    hit = F.filter("ranks", lambda r: (r > F.col("_to") - F.col("_c")) & (r <= F.col("_to")))
    found = running.join(wanted, keys).select(*keys, "_cell", F.explode(hit).alias("r"))
    outside = F.raise_error(F.lit("a rank lies outside the bounds of the sketch"))
    return found.select(*keys, F.col("r").cast("long").alias("r"),
                        F.when(F.col("_cell").isNull(), outside.cast("double")).otherwise(F.col("_cell")).alias("v"))
