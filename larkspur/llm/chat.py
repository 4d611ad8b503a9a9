"""Chat formatting: cumulative snapshots are collapsed before rendering.

Chat logs often hold every state of a conversation: after two turns, after
four, and so on.  A conversation that equals the first turns of a longer one is
such a snapshot and goes; of equal conversations the one with the smallest id
stays.  Prefixes are recognised by rolling hashes: the hash of the first k turns
is the running sum of two 64-bit hashes of (position, role, text), so one scan
gives the hashes of all prefixes, and an anti-join against the proper prefixes
of every conversation leaves the maximal ones.  Only DataFrame functions are
used.

Turns get their positions from ranges of (conversation, turn, role, text): the
place within a range plus the counts of the ranges before, so that neither a long
conversation nor one of equal or null turns is ever sorted in one task (the ranges
are cut by the first ``RANGE_CHARS`` characters of role and text; turns that also
agree in these stay together).  Conversations are then handled in blocks of
``BLOCK_TURNS`` positions: running sums are taken within a block and the sums of
earlier blocks are added.  Rendering gives one text per block (``part``); most
conversations have just one.

Defined cases: a null conv_id is a conversation of its own, a null turn sorts
first; exact repeats of a row collapse; rows that share a turn are ordered
by role and text; null roles and texts differ from empty ones for the
comparison and render as empty; no rows give no rows; further columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialise, open_table

BLOCK_TURNS = 128
#: Characters of role and text by which ranges of turns are cut; bounds the sampled keys.
RANGE_CHARS = 128


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, block, pos, role, text, h1, h2): position from 1 and hashes of the turn."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    order = ["conv", "turn", "role", "text"]
    ranges = rows.repartitionByRange("conv", "turn", *(F.substring(c, 1, RANGE_CHARS) for c in ("role", "text")))
    # the number of a row grows with its range and its place there
    rows = materialise(ranges.sortWithinPartitions(*order).select(
        *order, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row")), "ordered")
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("conv", "range").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("count")) \
        .withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    same = [F.col("rows.conv").eqNullSafe(F.col("starts.conv")), F.col("rows.range") == F.col("starts.range")]
    rows = rows.alias("rows").join(starts.alias("starts"), same).select(
        "rows.conv", "rows.role", "rows.text", (F.col("before") + F.col("row") - F.col("first") + 1).alias("pos")) \
        .withColumn("block", F.floor((F.col("pos") - 1) / BLOCK_TURNS))

    def turn_hash(seed: int) -> F.Column:
        # 60 bits, so that sums of any realistic length stay exact in a decimal
        return F.pmod(F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text"),
                      F.lit(1 << 60))
    return rows.select("conv", "block", "pos", "role", "text", turn_hash(11).alias("h1"), turn_hash(23).alias("h2"))


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """(conv, block, pos, p1, p2): the prefix hashes at every turn of ``numbered_turns``;
    roles and texts take no part in it, so they are not moved."""
    key = ["conv", "block"]
    rows = rows.select(*key, "pos", *(F.col(f"h{k}").cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)))
    upto = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key).agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    carried = sums.select("conv", "block", *(F.coalesce(F.sum(f"s{k}").over(upto), F.lit(0)).alias(f"c{k}")
                                             for k in (1, 2)))
    running = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("r1", F.sum("h1").over(running)).withColumn("r2", F.sum("h2").over(running))
    same = [F.col("rows.conv").eqNullSafe(F.col("carried.conv")), F.col("rows.block") == F.col("carried.block")]
    return rows.alias("rows").join(carried.alias("carried"), same).select(
        "rows.conv", "rows.block", "pos",
        (F.col("r1") + F.col("c1")).cast("string").alias("p1"),
        (F.col("r2") + F.col("c2")).cast("string").alias("p2"))


def maximal_conversations(rows: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies) of the conversations that are no prefix of a
    longer one, from ``prefix_hashes``; the smallest id of equal ones."""
    full = rows.groupBy("conv").agg(F.max("pos").alias("n"),
                                    F.max(F.struct("pos", "p1", "p2")).alias("end"))
    whole = (full.groupBy("n", F.col("end.p1").alias("p1"), F.col("end.p2").alias("p2"))
             .agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies")))
    last = full.select("conv", "n")
    proper = (rows.select("conv", "pos", "p1", "p2").alias("r")
              .join(last.alias("l"), F.col("r.conv").eqNullSafe(F.col("l.conv")) & (F.col("pos") < F.col("n")))
              .select(F.col("pos").alias("n"), "p1", "p2").distinct())
    return whole.join(proper, ["n", "p1", "p2"], "left_anti").select("conv", F.col("n").alias("n_turns"), "n_copies")


def rendered_turn(role: str = "role", text: str = "text") -> F.Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"),
                    F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text): the maximal conversations, rendered."""
    rows = materialise(numbered_turns(turns), "turns")
    kept = materialise(maximal_conversations(materialise(prefix_hashes(rows), "prefixes")), "maximal")
    lines = rows.alias("r").join(kept.alias("k"), F.col("r.conv").eqNullSafe(F.col("k.conv"))).select(
        F.col("r.conv").alias("conv_id"), "block", "n_turns", "n_copies",
        F.struct("pos", rendered_turn().alias("line")).alias("line"))
    parts = lines.groupBy("conv_id", "block", "n_turns", "n_copies").agg(
        F.array_sort(F.collect_list("line")).alias("lines"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("block")) - 1
    return parts.select("conv_id", number.cast("int").alias("part"), "n_turns", "n_copies",
                        F.array_join(F.transform("lines", lambda s: s["line"]), "").alias("text"))


QUERY_NAME = "op4_chat_snapshots"
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), r AS (
  SELECT conv_id, (pos - 1) // 128 AS block, pos, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line,
         coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2) AS mark
  FROM t
), p AS (
  SELECT conv_id, pos, md5(string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h,
         max(pos) OVER (PARTITION BY conv_id) AS n
  FROM r
), kept AS (
  SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies
  FROM p WHERE pos = n AND (pos, h) NOT IN (SELECT (pos, h) FROM p WHERE pos < n)
  GROUP BY n, h
)
SELECT r.conv_id, CAST(row_number() OVER (PARTITION BY r.conv_id ORDER BY r.block) - 1 AS INTEGER) AS part,
       n_turns, n_copies, string_agg(line, '' ORDER BY pos) AS text
FROM r JOIN kept USING (conv_id)
GROUP BY r.conv_id, r.block, n_turns, n_copies
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return format_chats(open_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
