"""Row-level validation that splits accepted from rejected rows.

A rejected row carries a reason instead of failing its whole batch; the
split is two filters over one reason column, so both sides share one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_reason(request_id="request_id", query="query") -> F.Column:
    rid, q = F.col(request_id), F.col(query)
    return (F.when(rid.isNull() | (F.length(rid) == 0), F.lit("empty request_id"))
            .when(q.isNull(), F.lit("missing query"))
            .when(F.length(q) < 1, F.lit("empty query")))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``ok`` and ``reason`` (null when accepted).

    request_id must be a non-empty string; query must have at least one
    character (whitespace-only passes, as a min-length rule does).
    """
    reason = request_reason()
    return requests.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where("ok"), validated.where("NOT ok")


def validate_vectors(df: DataFrame, dim: int, col: str = "embedding",
                     strict: bool = False) -> DataFrame:
    """Null vector or wrong dimension -> reason; ``strict`` raises instead."""
    v = F.col(col)
    reason = (F.when(v.isNull(), F.lit("Missing embedding in batch"))
              .when(F.size(v) != dim,
                    F.concat(F.lit("Embedding dimension mismatch: expected "),
                             F.lit(str(dim)), F.lit(", got "), F.size(v).cast("string"))))
    out = df.withColumn("vector_error", reason)
    if strict:
        out = out.withColumn(
            "vector_error",
            F.when(F.col("vector_error").isNotNull(), F.raise_error(F.col("vector_error"))))
    return out


def non_empty_batch(batches: DataFrame, items: str = "items") -> tuple[DataFrame, DataFrame]:
    """Envelopes with zero items are rejected (accepted, rejected)."""
    ok = F.coalesce(F.size(F.col(items)) > 0, F.lit(False))
    return batches.where(ok), batches.where(~ok).withColumn("reason", F.lit("empty batch"))
