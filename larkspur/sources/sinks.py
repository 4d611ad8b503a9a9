"""K1-K4: writers.  Every write is a Spark job with its own commit protocol;
paths are expected on shared storage (see ``session.shared_dir``)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_COLUMNS = ["timestamp", "run_id", "node", "service", "stage", "metric", "value"]


def write_documents_once(df: DataFrame, path: str, buckets: int | None = None,
                         table: str | None = None) -> None:
    """K1: create the document table only if absent (``ignore`` mode).

    With ``buckets``/``table`` the table is bucketed by doc_id so later id
    fetches join it without shuffling the table side.
    """
    w = df.write.mode("ignore")
    if buckets and table:
        w.bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", path).saveAsTable(table)
    else:
        w.parquet(path)


#: Bytes of documents one bucket is meant to hold.
BUCKET_BYTES = 128 * 1024 * 1024


def write_documents_bucketed(df: DataFrame, path: str, table: str, buckets: int | None = None) -> DataFrame:
    """K1: a document table bucketed and sorted by doc_id, registered as
    ``table`` (once; a second write changes nothing).  As many buckets as hold
    about ``BUCKET_BYTES`` of text each, 8 at least."""
    if buckets is None:
        size = df.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        buckets = max(8, -(-int(size) // BUCKET_BYTES))
    # rows come together by bucket first, so every bucket is one file
    spread = df.repartition(buckets, "doc_id")
    write_documents_once(spread, path, buckets, table)
    return df.sparkSession.table(table)


@F.pandas_udf(T.DoubleType())
def _py_round2(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if pd.isna(x) else round(float(x), 2))


def report_round(c) -> Column:
    """Presentation rounding to 2 places with Python's rule (the exact binary
    value, ties to even): round(2.675, 2) == 2.67, which SQL round/bround on
    the decimal text do not give.  Used only in report sinks."""
    return _py_round2(F.col(c) if isinstance(c, str) else c)


def write_summary_csv(df: DataFrame, path: str, partition_by: str | None = None,
                      round_report: bool = False) -> bool:
    """K2: header + rows; nothing is written when there is no row.

    ``round_report`` applies the 2-place presentation rounding to every
    double column (the analytics themselves stay unrounded)."""
    if df.isEmpty():
        return False
    if round_report:
        df = df.select(*[report_round(f.name).alias(f.name)
                         if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                         for f in df.schema.fields])
    w = df.write.mode("overwrite").option("header", True)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)
    return True


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """K3: long metric rows sorted by time, fixed column order (the global
    sort is a range-partitioned sort; part files are in time order)."""
    (df.orderBy("_ts" if "_ts" in df.columns else "timestamp").select(*METRIC_COLUMNS)
     .write.mode("overwrite").option("header", True).csv(path))


def write_vectors_ivf(assigned: DataFrame, centroids: DataFrame, path: str) -> None:
    """K4: vectors partitioned by cell (a probe reads only its cells'
    directories) plus the centroid table.  Rows are brought together by cell,
    and a cell beyond the advised partition size is split over several tasks."""
    assigned.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell") \
        .parquet(f"{path}/vectors")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")


def read_vectors_ivf(spark, path: str, cells: list[int] | None = None):
    v = spark.read.parquet(f"{path}/vectors")
    if cells is not None:
        v = v.where(F.col("cell").isin(cells))
    return v, spark.read.parquet(f"{path}/centroids")
