"""Scans of the base tables and their mapping onto the engine's model.

All readers go through ``spark.read.parquet`` so Catalyst can prune columns
and push filters into the scan; nothing is cached or collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.constants import CATEGORIES, CORPUS_TITLE
from larkspur.functions.timeutil import as_instant, epoch_seconds

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan for work on whole texts that costs more than moving them.

    A table in fewer splits than cores (so smaller than ``maxPartitionBytes`` a
    core; often one row group, read by one task) is dealt to all cores; any
    larger table is read in place.  Same rows either way.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def category_of(doc_id) -> F.Column:
    """Category chosen by ``doc_id % 4`` from the fixed category list."""
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    return F.element_at(cats, (F.pmod(doc_id, F.lit(len(CATEGORIES))) + 1).cast("int"))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document table as (doc_id, title, content, category).

    title/content null -> "", category "" -> null (row mapping of the store).
    """
    d = table(spark, sf_dir, "documents")
    title_prefix = CORPUS_TITLE.split("{")[0]
    return d.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit(title_prefix), F.col("doc_id").cast("string")),
                   F.lit("")).alias("title"),
        F.coalesce(F.col("text"), F.lit("")).alias("content"),
        F.nullif(category_of(F.col("doc_id")), F.lit("")).alias("category"),
    )


def normalise_document_row(df: DataFrame) -> DataFrame:
    """S1 mapping for any (doc_id, title, content, category) frame."""
    return df.select(
        "doc_id",
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("content"), F.lit("")).alias("content"),
        F.nullif(F.col("category"), F.lit("")).alias("category"),
    )


def scan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector corpus as (vec_id, embedding array<float>)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def vector_corpus_stats(vectors: DataFrame) -> DataFrame:
    """S2 size report: count and dimension range, one aggregate pass."""
    return vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
    )


def requests_from_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: requests (request_id string, query string) from the benchmark table."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("request_id"),
                    F.col("text").alias("query"))


def requests_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: user turns of conversations as requests, id = conv_id:turn."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("request_id"),
        F.col("text").alias("query"),
        "conv_id", "turn",
    )


def request_log_from_events(spark: SparkSession, sf_dir: str, n_runs: int = 8) -> DataFrame:
    """The events table read as a request-result log.

    request_id = event_id, timestamp = ts (epoch seconds, double),
    success = event_type <> 'error', latency_ms = value, run = user_id % n_runs.
    """
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("request_id"),
        "event_id",
        as_instant("ts").alias("ts"),
        epoch_seconds("ts").alias("timestamp"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("latency_ms"),
        F.pmod(F.col("user_id"), F.lit(n_runs)).alias("run"),
        "user_id", "event_type",
    )
