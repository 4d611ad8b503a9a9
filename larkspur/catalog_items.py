"""Registered queries, second part: readers and writers on derived files,
reject paths, post-processing helpers, metric families and stage profiles.

Same conventions as ``catalog``; every query covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import constants as C
from larkspur.catalog import _CONSOLIDATED_SQL, _DOCS_SQL, _MISSING_ID, _SUMMARY_SQL, N_RUNS
from larkspur.catalog import ORACLES, _consolidated, _fetched, _id_requests, _manifest, _rss, r6, register
from larkspur.functions.timeutil import as_instant, epoch_micros
from larkspur.operators import fetch, payload, postprocess, runs, telemetry, validate
from larkspur.session import shared_dir
from larkspur.sources import files, sinks
from larkspur.sources import tables as T

# --------------------------------------------------------------------------
# Records as JSON, and rows that fail validation
# --------------------------------------------------------------------------


@register("scan_request_records", """
WITH r AS (
  SELECT CASE WHEN conv_id % 7 = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) END
           AS request_id,
         CASE conv_id % 7 WHEN 1 THEN NULL WHEN 2 THEN '' ELSE text END AS query
  FROM conversations)
SELECT request_id, query,
       CASE WHEN length(request_id) = 0 THEN 'empty request_id'
            WHEN query IS NULL THEN 'missing query'
            WHEN length(query) < 1 THEN 'empty query' END AS reason
FROM r
""")
def q_scan_request_records(spark, sf_dir):
    """S3 from JSON lines: some records have no id, no query or an empty one."""
    c = T.table(spark, sf_dir, "conversations")
    kind = F.pmod("conv_id", F.lit(7))
    records = c.select(
        F.when(kind == 0, F.lit("")).otherwise(F.concat_ws(":", "conv_id", "turn")).alias("request_id"),
        F.when(kind == 1, F.lit(None)).when(kind == 2, F.lit("")).otherwise(F.col("text")).alias("query"))
    path = shared_dir(spark, "request_records")
    records.write.json(path)
    return validate.validate_requests(files.read_requests(spark, path)).select("request_id", "query", "reason")


@register("reject_vectors", """
SELECT vec_id,
       CASE vec_id % 5 WHEN 0 THEN 'Missing embedding in batch'
                       WHEN 1 THEN 'Embedding dimension mismatch: expected 64, got 32' END AS vector_error
FROM embeddings
""")
def q_reject_vectors(spark, sf_dir):
    """P8 on vectors of which some are missing and some cut to 32 components."""
    kind = F.pmod("vec_id", F.lit(5))
    v = T.scan_vectors(spark, sf_dir).withColumn(
        "embedding", F.when(kind == 1, F.slice("embedding", 1, 32)).when(kind != 0, F.col("embedding")))
    return validate.validate_vectors(v, 64).select("vec_id", "vector_error")


@register("non_empty_batches", """
SELECT conv_id * 1000 + turn // 4 AS batch_id, count(*) FILTER (WHERE role = 'user') AS n_items,
       CASE WHEN count(*) FILTER (WHERE role = 'user') = 0 THEN 'empty batch' END AS reason
FROM conversations GROUP BY 1
""")
def q_non_empty_batches(spark, sf_dir):
    """The user turns of every block of four turns; blocks without any are rejected."""
    c = T.table(spark, sf_dir, "conversations")
    batches = c.groupBy((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 4)).alias("batch_id")).agg(
        F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).alias("items"))
    good, bad = validate.non_empty_batch(batches)
    every = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return every.select("batch_id", F.size("items").cast("long").alias("n_items"), "reason")


@register("l2_normalise_elements", """
WITH s AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN list_transform(embedding, lambda x: 0.0::DOUBLE)
                  ELSE list_transform(embedding, lambda x: x::DOUBLE * (vec_id + 1)) END AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM s)
SELECT vec_id, unnest(range(len(e)))::INTEGER AS pos,
       round(unnest(list_transform(e, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)), 6) AS value
FROM n
""")
def q_l2_normalise_elements(spark, sf_dir):
    """P10, element by element, on stretched vectors and zero vectors."""
    from larkspur.functions.vectors import l2_normalise
    stretch = F.when(F.pmod("vec_id", F.lit(10)) == 3, F.lit(0)).otherwise(F.col("vec_id") + 1)
    v = T.scan_vectors(spark, sf_dir).select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * stretch).alias("e"))
    return v.select("vec_id", F.posexplode(l2_normalise("e")).alias("pos", "value")) \
        .withColumn("value", r6("value"))


@register("vector_classes", """
SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS first_same FROM embeddings
""")
def q_vector_classes(spark, sf_dir):
    """P6 by its equality classes: the smallest id with the same fingerprint."""
    from larkspur.functions.vectors import vector_fingerprint
    v = T.scan_vectors(spark, sf_dir).select("vec_id", vector_fingerprint("embedding").alias("fp"))
    return v.join(v.groupBy("fp").agg(F.min("vec_id").alias("first_same")), "fp").select("vec_id", "first_same")


# --------------------------------------------------------------------------
# K1, P2, P16, P21, J7, U1, U2
# --------------------------------------------------------------------------

@register("documents_written_once", _DOCS_SQL)
def q_documents_written_once(spark, sf_dir):
    """K1: the second write finds the table and changes nothing."""
    path = shared_dir(spark, "documents_once")
    docs = T.scan_documents(spark, sf_dir)
    sinks.write_documents_once(docs, path)
    sinks.write_documents_once(docs.withColumn("content", F.lit("overwritten")), path)
    return spark.read.parquet(path)


@register("fetch_bucketed", ORACLES["fetch_documents"])
def q_fetch_bucketed(spark, sf_dir):
    """J1 against a document table bucketed by id."""
    path = shared_dir(spark, "documents_bucketed")
    docs = sinks.write_documents_bucketed(T.scan_documents(spark, sf_dir), path, "docs_" + path.rsplit("/", 1)[1])
    return _fetched(fetch.fetch_bucketed(_id_requests(spark, sf_dir), docs))


@register("docs_in_large_id_set", """
SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT page_id * 3 FROM pages)
""")
def q_docs_in_large_id_set(spark, sf_dir):
    """J3 behind a Bloom filter: every third document, by the ids of pages."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    ids = T.table(spark, sf_dir, "pages").select((F.col("page_id") * 3).alias("doc_id"))
    return fetch.docs_in_large_id_set(d, ids)


@register("document_structs", f"""
SELECT doc_id, title, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE category END AS category,
       'doc_id,title,content' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ',category' END AS fields
FROM ({_DOCS_SQL})
""")
def q_document_structs(spark, sf_dir):
    """Documents as JSON; a null category has no field."""
    d = T.scan_documents(spark, sf_dir).withColumn(
        "category", F.when(F.pmod("doc_id", F.lit(4)) != 0, F.col("category")))
    j = d.select("doc_id", payload.document_json().alias("j"))
    return j.select("doc_id", F.get_json_object("j", "$.title").alias("title"),
                    F.get_json_object("j", "$.category").alias("category"),
                    F.array_join(F.json_object_keys("j"), ",").alias("fields"))


_STARS = "CASE n_chars % 7 WHEN 1 THEN '1 star' ELSE CAST(n_chars % 7 AS VARCHAR) || ' stars' END"
_SENTIMENT_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SENTIMENT_LABELS.items())


@register("postprocess_if_missing", f"""
SELECT CAST(doc_id AS VARCHAR) AS request_id,
       CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE
         CASE {_STARS} {_SENTIMENT_CASES} ELSE '{C.SENTIMENT_DEFAULT}' END END AS sentiment
FROM documents
""")
def q_postprocess_if_missing(spark, sf_dir):
    """A sentiment that is there stays, the others are computed."""
    d = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("request_id"), "n_chars",
        F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("given")).alias("sentiment"))
    k = F.pmod("n_chars", F.lit(7))
    stars = F.when(k == 1, F.lit("1 star")).otherwise(F.concat(k.cast("string"), F.lit(" stars")))
    return postprocess.postprocess_if_missing(
        d, "sentiment", lambda rows: rows.select("request_id", postprocess.map_sentiment(stars).alias("sentiment"))
    ).select("request_id", "sentiment")


@register("default_scores", f"""
SELECT e.vec_id AS request_id, d.doc_id, CAST(1.0 AS DOUBLE) AS score
FROM (SELECT vec_id, unnest([vec_id, vec_id + 1, {_MISSING_ID}]) AS doc_id FROM embeddings) e
JOIN documents d ON d.doc_id = e.doc_id
""")
def q_default_scores(spark, sf_dir):
    """Documents that no rerank stage scored get 1.0."""
    e = T.table(spark, sf_dir, "embeddings")
    req = e.select(F.col("vec_id").alias("request_id"),
                   F.array("vec_id", F.col("vec_id") + 1, F.lit(_MISSING_ID).cast("long")).alias("doc_ids"))
    got = fetch.fetch_documents(req, T.scan_documents(spark, sf_dir))
    return got.select("request_id", F.explode(payload.strip_missing_scores(F.col("docs"))).alias("d")) \
        .select("request_id", F.col("d.doc_id").alias("doc_id"), F.col("d.score").alias("score"))


@register("pair_responses", """
SELECT CAST(q.conv_id AS VARCHAR) || ':' || CAST(q.turn AS VARCHAR) AS request_id, q.text AS query,
       a.text AS answer
FROM conversations q
LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user'
""")
def q_pair_responses(spark, sf_dir):
    """Every user turn with the assistant's next turn, by key."""
    c = T.table(spark, sf_dir, "conversations")
    req = T.requests_from_conversations(spark, sf_dir).select("request_id", "query")
    res = c.where("role = 'assistant'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("request_id"),
        F.col("text").alias("answer"))
    return fetch.pair_responses(req, res)


@register("append_runs", f"""
SELECT full_run_id, throughput, CASE WHEN right(full_run_id, 1) IN ('0', '2', '4', '6') THEN latency_p95 END
         AS latency_p95, total_rss_mb
FROM ({_CONSOLIDATED_SQL})
""")
def q_append_runs(spark, sf_dir):
    """Rows of two groups of runs, one without a p95 column."""
    c = _consolidated(spark, sf_dir).select("full_run_id", "throughput", "latency_p95", "total_rss_mb")
    even = F.substring("full_run_id", -1, 1).isin("0", "2", "4", "6")
    return runs.append_runs(c.where(even), c.where(~even).drop("latency_p95"))


@register("distinct_ids", "SELECT DISTINCT user_id FROM events")
def q_distinct_ids(spark, sf_dir):
    return fetch.distinct_ids(T.table(spark, sf_dir, "events"), "user_id")


# --------------------------------------------------------------------------
# Metric capture
# --------------------------------------------------------------------------

@register("capture_metrics", f"""
WITH h AS (SELECT event_type, user_id % {N_RUNS} AS run, date_trunc('hour', ts) AS hour, count(*) AS n,
                  max(value) AS m FROM events GROUP BY ALL),
t AS (SELECT *, strftime(hour, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, 'node_' || CAST(run AS VARCHAR) AS node
      FROM h)
SELECT timestamp, 'capture' AS run_id, node, event_type AS service, '' AS stage, 'request_count' AS metric,
       CAST(n AS DOUBLE) AS value FROM t
UNION ALL SELECT timestamp, 'capture', '{C.UNKNOWN_LABEL}', event_type, '', 'latency_max', m FROM t
UNION ALL SELECT timestamp, 'capture', node, '', event_type, 'stage_latency_max', m FROM t
""")
def q_capture_metrics(spark, sf_dir):
    """Hourly series of three metric families, one JSON series per day and label
    set (24 points at most), flattened, sorted and written as CSV."""
    hour = (F.floor(epoch_micros("ts") / F.lit(3600 * 10 ** 6)) * 3600).cast("long")
    points = T.table(spark, sf_dir, "events").groupBy(
        "event_type", F.pmod("user_id", F.lit(N_RUNS)).alias("run"), hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("m"))
    series = points.groupBy("event_type", "run", F.floor(F.col("hour") / 86400).alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("hour", "n", "m"))).alias("p"))
    node = F.concat(F.lit("node_"), F.col("run").cast("string"))
    families = [("service", "request_count", "n", [F.lit("node"), node, F.lit("service"), F.col("event_type")]),
                ("service", "latency_max", "m", [F.lit("service"), F.col("event_type")]),
                ("stage", "stage_latency_max", "m", [F.lit("node"), node, F.lit("stage"), F.col("event_type")])]
    rows = []
    for family, name, value, labels in families:
        path = shared_dir(spark, "metric_matrix", name)
        series.select(
            F.create_map(F.lit("__name__"), F.lit(name), *labels).alias("metric"),
            F.arrays_zip(F.col("p.hour").cast("array<string>").alias("t"),
                         F.col(f"p.{value}").cast("array<string>").alias("v")).alias("z")) \
            .select("metric", F.transform("z", lambda s: F.array(s["t"], s["v"])).alias("values")).write.json(path)
        rows.append(files.flatten_metric_matrix(files.read_metric_matrix(spark, path), "capture", family))
    path = shared_dir(spark, "metrics_csv")
    sinks.write_metrics_csv(runs.append_runs(*rows), path)
    back = spark.read.option("header", True).schema(
        ", ".join(f"{c} {'double' if c == 'value' else 'string'}" for c in sinks.METRIC_COLUMNS)).csv(path)
    return runs.metrics_by_time(back.fillna("", ["service", "stage"]))


# --------------------------------------------------------------------------
# A5 with stages, A6 families, W8 over readings, C5, R5 with histograms
# --------------------------------------------------------------------------

@register("stage_profiles", """
SELECT event_id // 5 AS request_id, round(sum(value), 6) AS total_duration_ms,
       max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS peak_memory_mb, count(*) AS stage_count,
       string_agg(event_type, ',' ORDER BY event_id) AS stage_names
FROM events GROUP BY 1
UNION ALL SELECT -1 - item_id, 0.0, 0, 0, '' FROM benchmark
""")
def q_stage_profiles(spark, sf_dir):
    """A5: five stages per request in order; requests without stages get zeros."""
    e = T.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    stages = e.select(F.floor(F.col("event_id") / 5).alias("request_id"), "event_id",
                      F.col("event_type").alias("stage_name"), F.col("value").alias("duration_ms"),
                      (k / 10.0).alias("memory_delta_mb"), k.alias("peak_memory_mb"))
    requests = stages.select("request_id").distinct().unionByName(
        T.table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("request_id")))
    s = telemetry.stage_profile_summary(stages, with_stages=True, order="event_id", requests=requests)
    return s.select("request_id", r6("total_duration_ms").alias("total_duration_ms"), "peak_memory_mb",
                    "stage_count", F.array_join(F.transform("stages", lambda x: x["stage_name"]), ",")
                    .alias("stage_names"))


#: family -> (bounds, SQL of the observed value, which both engines read alike)
_FAMILIES = {
    "batch_size": (C.BATCH_SIZE_BUCKETS, "value / 8"),
    "rpc_seconds": (C.RPC_BUCKETS, "value / 50"),
    "compression_ratio": (C.RATIO_BUCKETS, "value / 25"),
    "gateway_batch_size": (C.GATEWAY_BATCH_BUCKETS, "value / 16"),
    "gateway_latency_seconds": (C.GATEWAY_LATENCY_BUCKETS, "value / 8"),
    "gateway_rpc_seconds": (C.GATEWAY_RPC_BUCKETS, "value / 50"),
}


def _families_sql() -> str:
    parts = []
    for name, (bounds, expr) in _FAMILIES.items():
        for b in bounds:
            parts.append(f"SELECT '{name}' AS family, event_type, '{telemetry.bucket_label(b)}' AS le, "
                         f"count(*) FILTER (WHERE {expr} <= {float(b)!r}) AS cumulative_count, "
                         f"round(sum({expr}), 6) AS sum, count(value) AS count FROM events GROUP BY event_type")
        parts.append(f"SELECT '{name}', event_type, '+Inf', count(value), round(sum({expr}), 6), count(value) "
                     "FROM events GROUP BY event_type")
    return "\nUNION ALL\n".join(parts)


@register("histogram_families", _families_sql())
def q_histogram_families(spark, sf_dir):
    """A6 for the batch-size, call-time and ratio families."""
    e = T.table(spark, sf_dir, "events")
    out = [telemetry.histogram_buckets(e.select("event_type", F.expr(expr).alias("v")), ["event_type"], "v", bounds)
           .withColumn("family", F.lit(name)) for name, (bounds, expr) in _FAMILIES.items()]
    return runs.append_runs(*out).withColumn("sum", r6("sum"))


_HALF_DAY_US = 43200 * 10 ** 6


@register("counter_rate_readings", f"""
WITH s AS (SELECT event_type, ts, event_id, floor(value) AS v,
                  lag(floor(value)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events),
d AS (SELECT event_type, ts, event_id, CASE WHEN p IS NULL THEN 0.0 WHEN v >= p THEN v - p ELSE v END AS delta FROM s),
w AS (
  SELECT *, (epoch_us(ts) // {_HALF_DAY_US}) * 43200 AS ws FROM d
  UNION ALL SELECT *, (epoch_us(ts) // {_HALF_DAY_US}) * 43200 - 43200 FROM d)
SELECT event_type, CAST(ws AS BIGINT) AS window_start,
       round((sum(delta) - arg_min(delta, struct_pack(t := ts, i := event_id))) / 86400.0, 6) AS rate
FROM w GROUP BY event_type, ws
""")
def q_counter_rate_readings(spark, sf_dir):
    """W8 over raw readings; a reading below the one before is a reset."""
    e = T.table(spark, sf_dir, "events").select(
        "event_type", "event_id", as_instant("ts").alias("t"), epoch_micros("ts").alias("us"),
        F.floor("value").cast("double").alias("v"))
    r = telemetry.counter_rate(e, ["event_type"], "t", "v", "1 day", "12 hours", 86400, ["us", "event_id"])
    return r.withColumn("rate", r6("rate"))


_SUMMARY_METRICS = runs.SUMMARY_COLUMNS
_RUN_METRICS = ["throughput", "latency_p50", "latency_p95", "success_rate", "total_rss_mb"]


def _tables_sql() -> str:
    run = "'run_' || CAST(run AS VARCHAR)"
    parts = [f"SELECT 'summaries' AS tbl, {run} AS full_run_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM s"
             for m in _SUMMARY_METRICS]
    parts += [f"SELECT 'consolidated', full_run_id, '{m}', {m} FROM c" for m in _RUN_METRICS]
    parts.append("SELECT 'ranked', full_run_id, 'throughput', throughput FROM c")
    parts.append("SELECT 'top3', full_run_id, 'throughput', throughput FROM "
                 "(SELECT * FROM c ORDER BY throughput DESC, full_run_id LIMIT 3)")
    parts += [f"SELECT 'percentiles', run_id, '{p}', {m} FROM c" for p, m in
              (("P50", "latency_p50"), ("P95", "latency_p95"))]
    return (f"WITH s AS ({_SUMMARY_SQL}), c AS ({_CONSOLIDATED_SQL})\n" + "\nUNION ALL\n".join(parts))


@register("run_analytics_tables", _tables_sql())
def q_run_analytics_tables(spark, sf_dir):
    """All five tables of the run analytics as (tbl, full_run_id, metric, value)."""
    from larkspur.plans.analytics import run_analytics
    log = T.request_log_from_events(spark, sf_dir, N_RUNS).withColumn(
        "full_run_id", F.concat(F.lit("run_"), F.col("run").cast("string")))
    ra = run_analytics(log, _manifest(spark, sf_dir), _rss(spark, sf_dir))

    def long(df, tbl, metrics):
        d = df.select("full_run_id", *[F.col(m).cast("double").alias(m) for m in metrics])
        return d.unpivot("full_run_id", metrics, "metric", "value").withColumn("tbl", F.lit(tbl))
    percentiles = ra.percentiles.select(F.col("run_id").alias("full_run_id"), F.col("percentile").alias("metric"),
                                        F.col("latency").alias("value"), F.lit("percentiles").alias("tbl"))
    every = runs.append_runs(long(ra.summaries, "summaries", _SUMMARY_METRICS),
                             long(ra.consolidated, "consolidated", _RUN_METRICS),
                             long(ra.ranked, "ranked", ["throughput"]), long(ra.top3, "top3", ["throughput"]),
                             percentiles)
    return every.select("tbl", "full_run_id", "metric", r6("value").alias("value"))


def _stream_histogram_sql() -> str:
    cnts = ", ".join(f"count(*) FILTER (WHERE value <= {float(b)!r}) AS b{i}"
                     for i, b in enumerate(C.LATENCY_BUCKETS))
    cols = "event_type, window_start"
    parts = [f"SELECT {cols}, '{telemetry.bucket_label(b)}' AS le, b{i} AS cumulative_count, count, rate FROM g"
             for i, b in enumerate(C.LATENCY_BUCKETS)] + [f"SELECT {cols}, '+Inf', count, count, rate FROM g"]
    return (f"""WITH g AS (
  SELECT event_type, CAST((epoch_us(ts) // 86400000000) * 86400 AS BIGINT) AS window_start, count(*) AS count, {cnts},
         round((sum(value) - arg_min(value, struct_pack(t := ts, i := event_id))) / 86400.0, 6) AS rate
  FROM events GROUP BY 1, 2
  HAVING window_start + 86400 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) / 1000.0 - 3600)
""" + "\nUNION ALL\n".join(parts))


@register("stream_metric_histograms", _stream_histogram_sql())
def q_stream_metric_histograms(spark, sf_dir):
    """Cumulative counts and rate of every window the watermark has closed."""
    from larkspur.streaming import streams
    ev = streams.table_stream(spark, sf_dir, "events").withColumn("t", as_instant("ts"))
    out = streams.stream_metric_histograms(ev, ["event_type"], "t", "value", C.LATENCY_BUCKETS, "event_id",
                                           "1 day", 86400, "1 hour")
    return spark.read.parquet(streams.run_to_sink(out, "histograms")).withColumn("rate", r6("rate"))
