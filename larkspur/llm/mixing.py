"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words.  Among all document rates between 0
and ``cap`` that meet the targets, the ones nearest to "each document once" in
relative entropy are exponentially tilted by size: rate = min(cap, exp(lambda *
size / mean size)), with one multiplier per source.  The multipliers are the
optimum of a convex dual whose gradient is the words a source would give less
its target.  Newton steps, kept within a bracket, solve it for all sources at
once; a step is one join and one grouped sum over the written counts of
(source, size), so its cost does not depend on how a source's documents are
spread, and neither rows nor sources are collected.

Rounding: rates become whole copies size by size, from the longest documents
to the shortest, and what one size takes too much or too little is made good
by the next; one exchange between two sizes closes most of what is left.  Within one (source, size) all documents get the same number of copies
or one more, in the order of a hash of the id, so reruns agree.  The fold over
sizes sees one row per distinct size of a source (at most the square root of
twice its words), never its documents.

Ranks within a (source, size) come from one range partitioning whose last key
is the row's place, so a source, a size or a repeated doc_id with a third of
all rows is spread over many tasks.

Defined cases: null text and wordless text have size 0, are taken 0 words and
any number of copies would change nothing (one is reported); a null source is
a source of its own, last in order; repeated rows are documents of their own;
a null doc_id is carried along; no rows or no words give targets of 0; further
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import map_batches, materialise, open_table
from larkspur.sources.generators import number_list

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
#: A source's words at the optimum may differ from its target by this part of it.
TOLERANCE = 1e-9
MAX_STEPS = 80
#: Sources that one task of the small per-source tables holds.
SOURCES_PER_TASK = 50_000


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words between ASCII white space, per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).cast("string").alias("text"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = [len(t.encode().split()) if t else 0 for t in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(size, pa.int64())],
                               names=["doc_id", "source", "size"])
    return map_batches(rows, fn, "doc_id long, source string, size long")


def _source_key() -> F.Column:
    """Never null, in the order of code points with the null source last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """(key, source, source_size, target) from (source, size) rows.

    Targets are in proportion to the weights (given to the sources in order,
    repeating) and add up to ``share`` of all sizes; none is above ``cap``
    times its source's size, and the excess goes to the others by weight.
    Only the two sums behind the common level come to the driver."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("key", _source_key())
    sums = materialise(sums, "sources")
    placed = number_list(sums, "key", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    tasks = 1 + sums.count() // SOURCES_PER_TASK
    spec = materialise(placed.coalesce(tasks).select("key", "source", "source_size", weight.alias("weight"),
                                     (F.col("source_size") * F.lit(float(cap))).alias("most")), "weights")
    total = spec.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("most") <= F.col("weight") * F.lit(level)
        row = spec.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("most"))).alias("fixed"),
                       F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if row.n == full or not row.open:
            break
        full = row.n
        level = (share * total - (row.fixed or 0.0)) / row.open
    target = F.when(F.lit(float(share) >= float(cap)), F.col("most")) \
        .otherwise(F.least("most", F.col("weight") * F.lit(level)))
    return spec.select("key", "source", "source_size", target.alias("target"))


def _rate(lam: str, cap: float) -> F.Column:
    return F.least(F.lit(float(cap)), F.exp(F.col(lam) * F.col("size") / F.col("mean")))


def solve_dual(cells: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE,
               max_steps: int = MAX_STEPS) -> DataFrame:
    """(key, lam, mean): the multiplier of every source with a target between
    0 and ``cap`` times its size; sources at either end have none.

    ``cells`` (key, size, n) counts the documents.  Each step evaluates the
    dual's gradient and curvature for all sources, moves by Newton (on the
    logarithm of the words, which is nearly straight) and falls back to the
    middle of the bracket when the step would leave it."""
    cells = cells.where("size > 0")
    mean = cells.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    inside = targets.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(float(cap))))
    nothing = F.lit(None).cast("double")
    # one row per source: few files, whatever the number of shuffle partitions
    tasks = 1 + targets.count() // SOURCES_PER_TASK
    state = materialise(inside.select("key", "target").join(mean, "key").coalesce(tasks).select(
        "key", "target", "mean", F.lit(0.0).alias("lam"), nothing.alias("lo"), nothing.alias("hi"),
        F.lit(1.0).alias("off")), "dual")
    for _ in range(max_steps):
        given = F.col("n") * F.col("size") * _rate("lam", cap)
        slope = F.when(_rate("lam", cap) < F.lit(float(cap)), given * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = cells.join(state, "key").groupBy("key").agg(F.sum(given).alias("words"), F.sum(slope).alias("slope"))
        now = state.join(sums, "key").coalesce(tasks)
        short = F.col("words") < F.col("target")
        now = now.withColumns({"lo": F.when(short, F.col("lam")).otherwise(F.col("lo")),
                               "hi": F.when(short, F.col("hi")).otherwise(F.col("lam")),
                               "off": F.abs(F.col("words") / F.col("target") - 1)})
        step = F.col("lam") + F.log(F.try_divide("target", "words")) * F.try_divide("words", "slope")
        within = (step > F.coalesce("lo", F.lit(float("-inf")))) & (step < F.coalesce("hi", F.lit(float("inf"))))
        middle = (F.coalesce("lo", F.col("hi") - 2 * F.abs("hi") - 1)
                  + F.coalesce("hi", F.col("lo") + 2 * F.abs("lo") + 1)) / 2
        moved = F.when(F.col("off") <= tolerance, F.col("lam")).when(within, step).otherwise(middle)
        state = materialise(now.select("key", "target", "mean", moved.alias("lam"), "lo", "hi", "off"), "dual")
        if not (state.agg(F.max("off")).first()[0] or 0.0) > tolerance:
            break
    return state.select("key", "lam", "mean")


def whole_copies(size: np.ndarray, n: np.ndarray, rate: np.ndarray, target: float, cap: int) -> np.ndarray:
    """Copies of all documents of each size (descending), with the words left
    over at one size handed to the next."""
    out = np.zeros(len(size), np.int64)
    carry = target - float((n * size * rate).sum())
    for k, (z, many, r) in enumerate(zip(size.tolist(), n.tolist(), rate.tolist())):
        if z == 0:
            out[k] = many
            continue
        want = many * r * z + carry
        out[k] = min(max(int(want / z + 0.5), 0), cap * many)
        carry = want - float(out[k]) * z
    # one copy more of one size against one less of another closes the rest
    more = np.flatnonzero((out < cap * n) & (size > 0))
    less = np.flatnonzero((out > 0) & (size > 0))[::-1]
    plus, minus = np.append(size[more], 0), np.insert(size[less], 0, 0)
    at = np.searchsorted(minus, plus - carry)
    best = min(((abs(carry - plus[k] + minus[j]), k, j) for k in range(len(plus))
                for j in (at[k] - 1, at[k]) if 0 <= j < len(minus)), default=(abs(carry), -1, 0))
    if best[0] < abs(carry):
        if best[1] < len(more):
            out[more[best[1]]] += 1
        if best[2]:
            out[less[best[2] - 1]] -= 1
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) per row."""
    # the row's place is written with it, so it is the same in every later pass
    sizes = materialise(document_sizes(docs, id_col, text_col, source_col)
                        .withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = materialise(source_targets(sizes, weights, share, cap), "targets")

    order = ["key", "size", F.xxhash64("doc_id"), "doc_id", "row"]
    keyed = sizes.withColumn("key", _source_key())
    placed = materialise(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .select("doc_id", "key", "size", F.shiftright("at", 33).alias("part"),
                F.col("at").bitwiseAND((1 << 33) - 1).alias("at")), "placed")
    # a (source, size) may lie in several ranges: documents of it before each range
    pieces = materialise(placed.groupBy("key", "size", "part")
                         .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "pieces")
    cells = materialise(pieces.groupBy("key", "size").agg(F.sum("n").alias("n")), "cells")
    dual = solve_dual(cells, targets, cap)
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("lam").isNull(), float(cap)).otherwise(_rate("lam", cap))
    rated = (cells.join(targets.select("key", "target"), "key").join(dual, "key", "left")
             .select("key", "size", "n", "target", F.when(F.col("size") == 0, 1.0).otherwise(rate).alias("rate")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        copies = whole_copies(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy(),
                              float(pdf["target"].iloc[0]), cap)
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "rate": pdf["rate"], "n": pdf["n"], "m": copies})
    given = materialise(rated.groupBy("key").applyInPandas(
        fold, "key string, size long, rate double, n long, m long"), "copies")

    # per range: how many documents of the (source, size) came before it
    before = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    plan = materialise(
        starts.select("key", "size", "part", "before").join(given, ["key", "size"])
        .join(targets, "key").select("key", "size", "part", "before", "source", "source_size", "target", "rate",
                                     F.expr("m div n").alias("each"),
                                     F.expr("m % n").alias("more")), "plan")
    copies = F.col("each") + F.when(F.col("at") + F.col("before") < F.col("more"), 1).otherwise(0)
    return (placed.join(plan, ["part", "key", "size"])
            .select("doc_id", "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))


QUERY_NAME = "op11_entropy_mix"
#: Newton iterations and rounding; tested against a plain solver.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = open_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")
