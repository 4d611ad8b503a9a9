"""Fetching documents by id lists.

The id lists are exploded to (request_id, pos, doc_id[, score]) rows and
joined to the document table once for all requests.  Scores ride on the row
through the join, so a missing document can never shift another's score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.bloom import BloomFilter
from larkspur.functions.text import truncate_text

DOC_FIELDS = ("doc_id", "title", "content", "category")


def explode_ids(requests: DataFrame, ids_col: str = "doc_ids",
                scores_col: str | None = None, key: str = "request_id") -> DataFrame:
    """(key, ids[, scores]) -> (key, pos, doc_id[, score]); pos keeps input order."""
    if scores_col is None:
        return requests.select(key, F.posexplode(ids_col).alias("pos", "doc_id"))
    z = F.arrays_zip(F.col(ids_col).alias("doc_id"), F.col(scores_col).alias("score"))
    return (requests.select(key, F.posexplode(z).alias("pos", "p"))
            .select(key, "pos", F.col("p.doc_id").alias("doc_id"),
                    F.col("p.score").alias("score")))


def fetch_rows(id_rows: DataFrame, docs: DataFrame, truncate: int | None = None,
               small_id_side: bool = False) -> DataFrame:
    """J1/J2 relational form: inner join drops unknown ids, keeps duplicates.

    ``small_id_side`` marks the id side as bounded (k ids per request for a
    counted request batch): it is then broadcast and the document table is
    scanned in place without a shuffle.
    """
    d = docs.select(*DOC_FIELDS)
    if truncate is not None:
        d = d.select("doc_id", truncate_text("title", truncate).alias("title"),
                     truncate_text("content", truncate).alias("content"), "category")
    if small_id_side:
        return d.join(F.broadcast(id_rows), "doc_id", "inner")
    return id_rows.join(d, "doc_id", "inner")


def collect_docs(rows: DataFrame, requests: DataFrame | None = None,
                 key: str = "request_id", order: str = "pos",
                 fields: tuple[str, ...] = DOC_FIELDS + ("score",)) -> DataFrame:
    """One row per request with its documents as an ordered array.

    Groups are bounded by the id-list length (k).  With ``requests`` given,
    requests with no hit keep an empty array (left join back).
    """
    present = [f for f in fields if f in rows.columns]
    agg = (rows.groupBy(key)
           .agg(F.sort_array(F.collect_list(F.struct(order, *present))).alias("_d"))
           .select(key, F.transform("_d", lambda s: s.dropFields(order)).alias("docs")))
    if requests is None:
        return agg
    empty = F.array().cast(agg.schema["docs"].dataType)
    return (requests.select(key).join(agg, key, "left")
            .select(key, F.coalesce("docs", empty).alias("docs")))


def fetch_documents(requests: DataFrame, docs: DataFrame, ids_col: str = "doc_ids",
                    truncate: int | None = None, scores_col: str | None = None,
                    small_id_side: bool = False) -> DataFrame:
    """Per request, documents in input order with duplicates kept.

    Missing ids are dropped, an empty list gives an empty array; scores are
    paired by key (J6) when ``scores_col`` is given.
    """
    rows = explode_ids(requests, ids_col, scores_col)
    hits = fetch_rows(rows, docs, truncate, small_id_side)
    return collect_docs(hits, requests)


def docs_in_id_set(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents whose id is in the id table (semi join; duplicates of the
    id table never duplicate a document)."""
    return docs.join(ids.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")


def docs_in_large_id_set(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """J3 for id tables too large to broadcast: a Bloom filter keeps nearly all
    other documents at the scan, the exact semi join sees the rest."""
    wanted = ids.select(F.col(id_col).alias("doc_id"))
    chance = BloomFilter(wanted, "doc_id")
    return docs_in_id_set(docs.where(chance.might_contain(F.col("doc_id"))), wanted)


def fetch_bucketed(requests: DataFrame, docs: DataFrame, ids_col: str = "doc_ids",
                   truncate: int | None = None) -> DataFrame:
    """J1 against a document table bucketed by doc_id (``sinks``): only the id
    rows are shuffled, to the table's buckets; the table is read in place."""
    rows = explode_ids(requests, ids_col)
    return collect_docs(fetch_rows(rows, docs.hint("merge"), truncate), requests)


def distinct_ids(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """De-duplicated id table (insert-or-ignore semantics)."""
    return ids.select(id_col).distinct()


def pair_responses(requests: DataFrame, responses: DataFrame,
                   key: str = "request_id") -> DataFrame:
    """Request <-> response by key, not by position."""
    return requests.join(responses, key, "left")


def fetch_if_blank(requests: DataFrame, docs: DataFrame, docs_col: str = "docs") -> DataFrame:
    """Refetch a row's documents only when its first document has blank
    content (the id-only hand-off); other rows pass through untouched."""
    first_blank = F.coalesce((F.size(docs_col) > 0) &
                             (F.col(docs_col)[0]["content"] == ""), F.lit(False))
    todo = requests.where(first_blank)
    rest = requests.where(~first_blank)
    ids = todo.select("request_id",
                      F.transform(docs_col, lambda d: d["doc_id"]).alias("_ids"),
                      F.transform(docs_col, lambda d: d["score"]).alias("_scores"))
    fetched = fetch_documents(ids, docs, "_ids", scores_col="_scores")
    refilled = (todo.drop(docs_col).join(fetched, "request_id", "left")
                .select(*requests.columns))
    return rest.unionByName(refilled)
