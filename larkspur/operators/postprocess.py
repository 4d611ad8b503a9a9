"""Prompt assembly and answer post-processing (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.constants import (CONTEXT_CHARS, CONTEXT_DOCS, SENTIMENT_DEFAULT, SENTIMENT_LABELS,
                                SYSTEM_PROMPT, TOXIC_DEFAULT, TOXIC_MASK, TOXIC_THRESHOLD)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def context_text(docs: Column, n_docs: int = CONTEXT_DOCS,
                 n_chars: int = CONTEXT_CHARS) -> Column:
    """Lines ``- {title}: {content[:n_chars]}`` of the first n docs, joined by newline."""
    top = F.slice(docs, 1, n_docs)
    lines = F.transform(top, lambda d: F.concat(
        F.lit("- "), F.coalesce(d["title"], F.lit("")), F.lit(": "),
        F.substring(F.coalesce(d["content"], F.lit("")), 1, n_chars)))
    return F.array_join(lines, "\n")


def build_prompt(query, docs, n_docs: int = CONTEXT_DOCS, n_chars: int = CONTEXT_CHARS) -> Column:
    """P12 -> array<struct<role, content>>: fixed system message, user message
    ``Context:\\n{context}\\n\\nQuestion: {query}\\n\\nAnswer:``."""
    user = F.concat(F.lit("Context:\n"), context_text(_c(docs), n_docs, n_chars),
                    F.lit("\n\nQuestion: "), _c(query), F.lit("\n\nAnswer:"))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")))


def map_sentiment(label) -> Column:
    """Star label -> sentiment; unknown or null -> neutral."""
    m = F.create_map(*[F.lit(x) for kv in SENTIMENT_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(label)), F.lit(SENTIMENT_DEFAULT))


def flag_toxic(score, threshold: float = TOXIC_THRESHOLD) -> Column:
    """P14: "true" when score > threshold (strictly), else "false"; null stays null."""
    s = _c(score)
    return F.when(s.isNull(), F.lit(None).cast("string")) \
        .when(s > F.lit(float(threshold)), F.lit("true")).otherwise(F.lit("false"))


def mask_toxic(text, is_toxic) -> Column:
    """Toxic text is replaced by the fixed filter message."""
    return F.when(_c(is_toxic) == "true", F.lit(TOXIC_MASK)).otherwise(_c(text))


def postprocess_if_missing(df: DataFrame, column: str, compute) -> DataFrame:
    """Run a scorer only for rows where ``column`` is still null.

    ``compute(df_subset) -> DataFrame(request_id, column)``; only the null
    subset is scored and the result is merged by key.
    """
    todo = df.where(F.col(column).isNull())
    done = compute(todo.drop(column)).withColumnRenamed(column, "_new")
    return (df.join(done, "request_id", "left")
            .withColumn(column, F.coalesce(F.col(column), F.col("_new"))).drop("_new"))


def default_answer(df: DataFrame, sentiment: str = "sentiment",
                   is_toxic: str = "is_toxic") -> DataFrame:
    """null/empty sentiment -> neutral, null/empty is_toxic -> false."""
    return (df.withColumn(sentiment, F.coalesce(F.nullif(F.col(sentiment), F.lit("")),
                                                F.lit(SENTIMENT_DEFAULT)))
            .withColumn(is_toxic, F.coalesce(F.nullif(F.col(is_toxic), F.lit("")),
                                             F.lit(TOXIC_DEFAULT))))
