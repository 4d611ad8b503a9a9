"""Envelopes and the file formats around a run.

Every reader takes an explicit schema (no inference pass over the data) and
keeps provenance from ``_metadata.file_path`` where the directory layout
carries meaning (one directory per run).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.constants import UNKNOWN_LABEL
from larkspur.functions.timeutil import iso_utc

REQUEST_ITEM = T.StructType([T.StructField("request_id", T.StringType()),
                             T.StructField("query", T.StringType())])
ENVELOPE = T.StructType([T.StructField("batch_id", T.LongType()),
                         T.StructField("items", T.ArrayType(REQUEST_ITEM))])

RESULT_LOG = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("response", T.StructType([
        T.StructField("generated_response", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("is_toxic", T.StringType())])),
    T.StructField("error", T.StringType()),
])

SUMMARY = T.StructType([
    T.StructField("total_requests", T.LongType()),
    T.StructField("successful", T.LongType()),
    T.StructField("failed", T.LongType()),
    T.StructField("success_rate", T.DoubleType()),
    T.StructField("throughput_req_per_min", T.DoubleType()),
    T.StructField("latency_avg_ms", T.DoubleType()),
    T.StructField("latency_p50_ms", T.DoubleType()),
    T.StructField("latency_p95_ms", T.DoubleType()),
    T.StructField("latency_p99_ms", T.DoubleType()),
    T.StructField("latency_min_ms", T.DoubleType()),
    T.StructField("latency_max_ms", T.DoubleType()),
    T.StructField("batch_size", T.LongType()),
])

PROCESS_STATS = T.StructType([
    T.StructField("pid", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("cmdline", T.ArrayType(T.StringType())),
    T.StructField("cpu_percent", T.DoubleType()),
    T.StructField("memory_info", T.StructType([
        T.StructField("rss", T.LongType()), T.StructField("vms", T.LongType())])),
])

METRIC_MATRIX = T.StructType([
    T.StructField("metric", T.MapType(T.StringType(), T.StringType())),
    T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
])

EVENT_PROFILE = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("batch_size", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("stage", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
])


# --- S4 --------------------------------------------------------------------

def explode_batch_envelope(envelopes: DataFrame) -> DataFrame:
    """{batch_id, items[]} -> one row per item with its position."""
    return (envelopes.select("batch_id", F.posexplode("items").alias("pos", "item"))
            .select("batch_id", "pos", "item.*"))


def collect_batch_envelope(items: DataFrame, fields: list[str]) -> DataFrame:
    """S4 inverse: item rows -> envelope, order by pos kept, batch id echoed.

    Envelopes are batches, bounded by the batch size that formed them.
    """
    agg = items.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("_i"))
    return agg.select("batch_id", F.transform("_i", lambda s: s.dropFields("pos"))
                      .alias("items"))


# --- S3 --------------------------------------------------------------------

def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """S3: request records (request_id, query) from JSON lines, schema fixed;
    ``validate.validate_requests`` then splits accepted from rejected."""
    return spark.read.schema(REQUEST_ITEM).json(path)


def request_stream(spark: SparkSession, path: str,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """S3 as a stream: new JSON files in ``path`` are new requests."""
    r = spark.readStream.schema(REQUEST_ITEM)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


# --- S5 --------------------------------------------------------------------

def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per request result."""
    return spark.read.schema(RESULT_LOG).json(path)


def write_result_log(df: DataFrame, path: str) -> None:
    """S5 sink: append JSON lines (results arrive out of order)."""
    df.write.mode("append").json(path)


# --- S6 --------------------------------------------------------------------

def read_run_summaries(spark: SparkSession, pattern: str,
                       run_dir_regex: str = r"([^/]+)/profile_data/") -> DataFrame:
    """Every run's summary CSV; the run id is its directory name.

    A run without a summary contributes no row (the glob simply does not
    match it).  ``pattern`` is e.g. ``base/*/profile_data/summary.csv``.
    """
    df = spark.read.option("header", True).schema(SUMMARY).csv(pattern)
    return df.withColumn("full_run_id",
                         F.regexp_extract(F.col("_metadata.file_path"), run_dir_regex, 1))


# --- S7 --------------------------------------------------------------------

def read_process_stats(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Nested process snapshots (a JSON array per file when multiline)."""
    return (spark.read.option("multiLine", multiline).schema(PROCESS_STATS).json(path)
            .withColumn("rss", F.col("memory_info.rss")))


# --- S8 --------------------------------------------------------------------

def flatten_metric_matrix(matrix: DataFrame, run_id: str, family: str) -> DataFrame:
    """Range-query series -> long rows (timestamp ISO, run_id, node,
    service, stage, metric, value); a missing label becomes "unknown".

    ``family`` is "service" (stage column empty) or "stage" (service empty).
    """
    m = F.col("metric")

    def lab(name):
        return F.coalesce(F.element_at(m, F.lit(name)), F.lit(UNKNOWN_LABEL))

    rows = matrix.select(m.alias("metric"), F.explode("values").alias("v"))
    ts = F.col("v")[0].cast("double")
    out = rows.select(
        iso_utc(ts).alias("timestamp"),
        F.lit(run_id).alias("run_id"),
        lab("node").alias("node"),
        (lab("service") if family == "service" else F.lit("")).alias("service"),
        (lab("stage") if family == "stage" else F.lit("")).alias("stage"),
        F.coalesce(F.element_at(m, F.lit("__name__")), F.lit(UNKNOWN_LABEL)).alias("metric"),
        F.col("v")[1].cast("double").alias("value"),
        ts.alias("_ts"),
    )
    return out


def read_metric_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_MATRIX).json(path)


# --- S9 --------------------------------------------------------------------

LOG_LINE = r"^(\S+ \S+) - (\S+) - (\S+) - (.*)$"


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Structured JSON events embedded in ``time - name - level - message``
    log lines; lines whose message is not a JSON event are dropped."""
    lines = spark.read.text(path)
    parsed = lines.select(
        F.regexp_extract("value", LOG_LINE, 1).alias("time"),
        F.regexp_extract("value", LOG_LINE, 2).alias("logger"),
        F.regexp_extract("value", LOG_LINE, 3).alias("level"),
        F.regexp_extract("value", LOG_LINE, 4).alias("message"))
    ev = parsed.withColumn("e", F.from_json("message", EVENT_PROFILE))
    return (ev.where(F.col("e.event").isNotNull())
            .select("time", "logger", "level", "e.*"))
