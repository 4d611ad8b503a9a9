"""Token counts as rollups maintained by signed deltas.

Totals by (source, lang, version) are sums of signed rows: an insert adds a
document and its tokens, a delete takes them away, a revised count takes the
old version's row away and adds the new one.  A batch is reduced to its totals
(partial sums before the shuffle, so a hot source is no hot task) and written
under its batch id; the id is committed by a marker written last.  Committing
an id again changes nothing, a half-written batch is overwritten by its retry,
and readers only see committed batches.  ``compact`` folds committed batches
into one snapshot; ids folded in stay known.

Counts come from ``tiktoken`` vocabularies in an Arrow-batched map; special
strings in a text are ordinary text.

Defined cases: null and empty texts have 0 tokens; null source or lang is a
group of its own; repeated rows count each time; groups whose documents and
tokens are all taken away disappear; an empty batch commits and adds nothing;
further columns are not read.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import map_batches, materialise, open_table
from larkspur.session import shared_dir

KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, docs long, tokens long"


def default_vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(f"{name}.tiktoken")


@functools.lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, versions: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with one count column per tokenizer version."""
    rest = [c for c in docs.columns if c != text_col]
    ordered = docs.select(*rest, F.col(text_col).cast("string").alias(text_col))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(len(rest)).to_pylist()]
        columns = [batch.column(k) for k in range(len(rest))]
        for path in versions.values():
            encode = _encoding(path).encode_ordinary
            columns.append(pa.array([len(encode(t)) for t in texts], pa.int64()))
        return pa.record_batch(columns, names=[*rest, *versions])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.drop(text_col).schema]
                       + [f"`{v}` long" for v in versions])
    return map_batches(ordered, fn, schema)


def signed(rows: DataFrame, sign: int, version: str, tokens: str) -> DataFrame:
    """Signed delta rows of documents counted under ``version``."""
    return rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       F.lit(version).alias("version"), F.lit(sign).cast("long").alias("docs"),
                       (F.col(tokens) * sign).cast("long").alias("tokens"))


def revised(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Deltas that move documents from one version's count to another's."""
    return signed(rows, -1, old, old).unionByName(signed(rows, 1, new, new))


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class RollupStore:
    """Committed batches under one shared folder; one writer per batch id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self, kind: str) -> set[str]:
        folder = self._at(f"{self.path}/{kind}")
        if not self._fs.exists(folder):
            return set()
        return {s.getPath().getName() for s in self._fs.listStatus(folder)}

    def _mark(self, kind: str, name: str) -> None:
        self._fs.create(self._at(f"{self.path}/{kind}/{name}"), True).close()

    def committed(self) -> set[str]:
        return self._marks("commits")

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch; False (and no change) if its id is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.committed():
            return False
        _sum(deltas).write.mode("overwrite").parquet(f"{self.path}/batches/{batch_id}")
        self._mark("commits", batch_id)
        return True

    def _current(self, committed: set[str]) -> list[str]:
        """Paths that make up the totals of the given batches."""
        snapshots = sorted(self._marks("snapshots"), key=int)
        folded: set[str] = set()
        paths = []
        if snapshots:
            last = snapshots[-1]
            folded = {r.id for r in self.spark.read.parquet(f"{self.path}/folded/{last}").collect()}
            paths = [f"{self.path}/totals/{last}"]
        return paths + [f"{self.path}/batches/{b}" for b in sorted(committed - folded)]

    def totals(self, committed: set[str] | None = None) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches (or
        those among the given ones and in the last snapshot)."""
        paths = self._current(self.committed() if committed is None else committed)
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        return _sum(self.spark.read.schema(DELTA).parquet(*paths)).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Folds the committed batches into a new snapshot; a snapshot counts
        from its marker on, so an interrupted run is simply repeated."""
        ids = sorted(self.committed())              # listed once: later commits stay out of both
        if not ids:
            return
        number = str(max([0, *map(int, self._marks("snapshots"))]) + 1)
        self.totals(set(ids)).write.mode("overwrite").parquet(f"{self.path}/totals/{number}")
        self.spark.createDataFrame([(i,) for i in ids], "id string") \
            .write.mode("overwrite").parquet(f"{self.path}/folded/{number}")
        self._mark("snapshots", number)


def exact_repeats(rows: DataFrame, digest: str = "digest", id_col: str = "doc_id") -> DataFrame:
    """Rows whose digest also belongs to a smaller id."""
    first = materialise(rows.groupBy(digest).agg(F.min(id_col).alias("first"), F.max(id_col).alias("last"))
                        .where(F.col("first") < F.col("last")).select(digest, "first"), "firsts")
    return rows.join(first.hint("merge"), digest).where(F.col(id_col) > F.col("first")).drop("first")


QUERY_NAME = "op7_token_rollup"
#: Tokenizer counts; tested against a plain recount.
ORACLE_SQL = None
OLD, NEW = "byte_bpe_50k", "byte_bpe_multi_50k"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted, exact repeats deleted, the rest revised to a newer
    tokenizer; the last two batches are sent twice."""
    docs = open_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    docs = docs.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    counts = materialise(token_counts(docs, {v: default_vocabulary(v) for v in (OLD, NEW)}), "counts")
    gone = materialise(exact_repeats(counts), "repeats")
    # a doc_id may hold several texts: only the repeated one goes
    stay = counts.join(gone.select("doc_id", "digest").hint("merge"), ["doc_id", "digest"], "left_anti")
    store = RollupStore(spark, shared_dir(spark, "llm", "rollup"))
    store.commit("load", signed(counts, 1, OLD, OLD))
    for _ in range(2):
        store.commit("repeats", signed(gone, -1, OLD, OLD))
        store.commit("recount", revised(stay, OLD, NEW))
    return store.totals()
