"""Second part of the catalog: every query against its SQL on the smallest
tables, the stored vector index and windowed histograms over micro-batches."""

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from larkspur import catalog
from larkspur.operators import knn, payload
from larkspur.session import shared_dir
from larkspur.sources import sinks, tables
from larkspur.streaming import streams

NAMES = ["scan_request_records", "reject_vectors", "non_empty_batches", "l2_normalise_elements", "vector_classes",
         "documents_written_once", "document_structs", "postprocess_if_missing", "default_scores", "pair_responses",
         "append_runs", "distinct_ids", "capture_metrics", "stage_profiles", "histogram_families",
         "counter_rate_readings", "run_analytics_tables", "generate_vectors", "given_cell_stats", "knn_ivf_recall", "knn_ivf_full"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in tables.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 5) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert _norm(df.collect(), df.columns) == _norm(got.fetchall(), columns)


def test_assign_cells_is_nearest_centre(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(60, 5)), rng.normal(size=(7, 5))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)],
                                   "vec_id long, embedding array<double>")
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, center array<double>")
    got = {r.vec_id: r.cell for r in knn.assign_cells(corpus, centres).collect()}
    want = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert got == dict(enumerate(want.tolist()))           # a null vector is in no cell


def test_stored_cells_prune_the_scan(spark):
    e = tables.scan_vectors(spark, SF).withColumn("cell", F.pmod("vec_id", F.lit(8)).cast("int"))
    centres = e.where("vec_id < 8").select("cell", F.col("embedding").cast("array<double>").alias("center"))
    path = shared_dir(spark, "stored_index")
    sinks.write_vectors_ivf(e, centres, path)
    some, _ = sinks.read_vectors_ivf(spark, path, [2, 5])
    assert {r.cell for r in some.select("cell").distinct().collect()} == {2, 5}
    assert some.select("_metadata.file_path").distinct().count() < \
        spark.read.parquet(f"{path}/vectors").select("_metadata.file_path").distinct().count()


def test_document_json_leaves_out_null_category(spark):
    d = spark.createDataFrame([(1, "t", "c", None), (2, "", "", "x")],
                              "doc_id long, title string, content string, category string")
    got = [r.j for r in d.orderBy("doc_id").select(payload.document_json().alias("j")).collect()]
    assert got == ['{"doc_id":1,"title":"t","content":"c"}',
                   '{"doc_id":2,"title":"","content":"","category":"x"}']


def test_windowed_histograms_over_micro_batches(spark):
    """Rows out of order across files, within the watermark, count once each."""
    rows = [(i, (i * 37) % 300, float(i % 9)) for i in range(300)] + [(302, 900, 1.0)]    # (id, minute, value)
    df = spark.createDataFrame(rows, "id long, minute long, v double") \
        .withColumn("t", F.timestamp_seconds(F.col("minute") * 60)).withColumn("k", F.lit("a"))
    path = shared_dir(spark, "events_in_parts")
    for part in range(3):
        df.where(F.pmod("id", F.lit(3)) == part).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = streams.stream_metric_histograms(src, ["k"], "t", "v", [2.0, 5.0], "id", "1 hour", 3600, "5 hours")
    got = {(r.window_start, r.le): (r.cumulative_count, r["count"], round(r.rate, 9))
           for r in spark.read.parquet(streams.run_to_sink(out, "histograms")).collect()}
    last = max(m for _, m, _ in rows) * 60 - 5 * 3600
    want = {}
    for w in range(0, 300 * 60, 3600):
        own = sorted((m, i, v) for i, m, v in rows if w <= m * 60 < w + 3600)
        if w + 3600 <= last:
            rate = round(sum(v for *_, v in own[1:]) / 3600, 9)
            for le, bound in (("2.0", 2.0), ("5.0", 5.0), ("+Inf", float("inf"))):
                want[w, le] = (sum(v <= bound for *_, v in own), len(own), rate)
    assert len(want) == 15 and got == want
