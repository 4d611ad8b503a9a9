"""Document payload modes, packing and compression statistics.

Packing is JSON -> zlib -> base64.  JSON and base64 are Spark built-ins;
zlib runs in an Arrow UDF, called once per batch, that takes up one value at a
time: beside the batch and its result no text is held.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_STRUCT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("category", T.StringType()),
])
DOCS_ARRAY = T.ArrayType(DOC_STRUCT)


def _one_by_one(values: pa.Array, do, kind: pa.DataType) -> pa.Array:
    return pa.array((do(v.as_py()) if v.is_valid else None for v in values), kind)


@F.arrow_udf(T.BinaryType())
def _zlib_compress(s: pa.Array) -> pa.Array:
    return _one_by_one(s, lambda x: zlib.compress(x.encode("utf-8")), pa.binary())


@F.arrow_udf(T.StringType())
def _zlib_decompress(b: pa.Array) -> pa.Array:
    def one(x):
        try:
            return zlib.decompress(x).decode("utf-8")
        except (zlib.error, UnicodeDecodeError):
            return None
    return _one_by_one(b, one, pa.string())


def document_json() -> Column:
    """A document row as JSON text; a null category has no field."""
    return F.to_json(F.struct(*DOC_STRUCT.fieldNames()))


def pack_docs(docs: Column) -> Column:
    """Docs array -> base64(zlib(json)).  ``to_json`` omits null fields,
    so a null category is simply absent (P2)."""
    return F.base64(_zlib_compress(F.to_json(docs)))


def unpack_docs(payload: Column, schema: T.DataType = DOCS_ARRAY) -> Column:
    """Inverse of pack_docs; null when the payload is unreadable.
    Decoding into the 4-field document struct drops any extra field (score)."""
    return F.from_json(_zlib_decompress(F.try_to_binary(payload, F.lit("base64"))), schema)


def apply_payload_mode(df: DataFrame, mode: str, docs: str = "docs") -> DataFrame:
    """Full keeps docs; id_only blanks title/content; compressed packs the
    docs into ``compressed_docs`` and empties the array."""
    if mode == "full":
        return df.withColumn("compressed_docs", F.lit(None).cast("string"))
    if mode == "id_only":
        blank = F.transform(docs, lambda d: d.withField("title", F.lit(""))
                            .withField("content", F.lit("")))
        return df.withColumn(docs, blank).withColumn("compressed_docs",
                                                     F.lit(None).cast("string"))
    if mode == "compressed":
        empty = F.array().cast(df.schema[docs].dataType)
        return df.withColumn("compressed_docs", pack_docs(F.col(docs))).withColumn(docs, empty)
    raise ValueError(f"unknown payload mode {mode!r}")


def restore_payload(df: DataFrame, docs: str = "docs") -> DataFrame:
    """Generation side of P19 + quirk q: unpack when a payload is present; an
    unreadable payload keeps the previous docs and sets ``payload_error``."""
    decoded = unpack_docs(F.col("compressed_docs"))
    has = F.col("compressed_docs").isNotNull()
    prev = F.transform(docs, lambda d: F.struct(d["doc_id"].cast("long").alias("doc_id"),
                                                d["title"].alias("title"),
                                                d["content"].alias("content"),
                                                d["category"].alias("category")))
    return (df.withColumn("_dec", F.when(has, decoded))
            .withColumn("payload_error", has & F.col("_dec").isNull())
            .withColumn(docs, F.coalesce(F.col("_dec"), prev))
            .drop("_dec"))


def strip_missing_scores(docs: Column, score: float = 1.0) -> Column:
    """With no rerank stage every document scores 1.0."""
    return F.transform(docs, lambda d: d.withField("score", F.lit(score)))


def compression_stats(df: DataFrame, original: str, compressed: str,
                      labels: list[str]) -> DataFrame:
    """Byte totals and ratio = original / compressed (1.0 when compressed is 0)."""
    o, c = F.octet_length(original), F.octet_length(compressed)
    g = df.groupBy(*labels).agg(F.sum(o).alias("original_bytes"),
                                F.sum(c).alias("compressed_bytes"),
                                F.count(F.lit(1)).alias("payloads"))
    ratio = F.when(F.col("compressed_bytes") == 0, F.lit(1.0)).otherwise(
        F.col("original_bytes") / F.col("compressed_bytes"))
    return g.withColumn("ratio", ratio)
