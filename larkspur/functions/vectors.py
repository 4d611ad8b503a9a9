"""Vector column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x * x))


def l2_normalise(v) -> Column:
    """P10: x / ||x||; the zero vector stays zero."""
    v = _c(v)
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)) \
        .otherwise(F.transform(v, lambda x: x.cast("double")))


def vector_fingerprint(v) -> Column:
    """SHA-256 of a canonical text form of the vector (float32 values).

    Equal vectors get equal keys (the equality classes of a hash over the raw
    float32 bytes); the digests themselves are this engine's own.
    """
    return F.sha2(F.to_json(F.transform(_c(v), lambda x: x.cast("float"))), 256)
