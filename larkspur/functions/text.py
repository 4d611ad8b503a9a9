"""Column-level text helpers (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.constants import TOKEN_PATTERN, SENTENCE_PATTERN


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def normalise_query(c) -> Column:
    """Lower-case, collapse whitespace runs to one space, strip the ends."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"\s+", " "))


def token_sort_key(norm) -> Column:
    """Sort the space-separated tokens of a normalised query and rejoin."""
    return F.array_join(F.array_sort(F.split(_c(norm), " ")), " ")


def text_fingerprint(c) -> Column:
    """P5: SHA-256 hex of the stripped text (case kept)."""
    return F.sha2(py_strip(c), 256)


def truncate_text(c, n: int) -> Column:
    """First ``n`` characters; null becomes the empty string."""
    return F.substring(F.coalesce(_c(c), F.lit("")), 1, n)


def tokens(c) -> Column:
    """Lower-cased runs of letters/digits, in text order (duplicates kept)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))),
                                F.lit(TOKEN_PATTERN), 0)


def sentences(c) -> Column:
    """Sentence-like spans: text up to and including a terminator."""
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(SENTENCE_PATTERN), 0)
