"""M1-M6: the scoring stages as distributed table operators.

The neural models of the answering service are re-aimed at default scorers
written with Spark SQL functions (so they run in the JVM, inside whole-stage
codegen, and have an exact SQL twin), plus a registry through which any
external model plugs in as an Arrow-batched ``mapInPandas`` function.

* M1 ``embed_sparse`` - signed hashed bag of tokens, L2-normalised.
* M2 ``overlap_scores`` - IDF-weighted share of query tokens found in the
  document, mapped through a bounded logit and a sigmoid.
* M3 ``extractive_answer`` - best-overlap sentence of the top context docs.
* M4 ``sentiment_label`` - polarity by a given lexicon bucketed to 1..5 stars (the
  learned form is in ``label_models``).
* M5 ``train_token_logodds`` / ``toxicity_scores`` - per-token log-odds fitted
  on the labelled documents (a Bernoulli naive Bayes restricted to present
  tokens); score = P(toxic).
* M6 ``register_scorer`` / ``score_batches`` - pluggable batch scorers.

Every stage is explode -> join -> aggregate over bounded groups (one text,
or one request's k candidates); nothing is collected.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.constants import EMBED_DIM, MAX_NEW_TOKENS, CONTEXT_CHARS, SCORER_INPUT_CHARS
from larkspur.functions.text import sentences, tokens

#: Rows whose vectors are summed in one matrix.
EMBED_ROWS = 256

# ---------------------------------------------------------------------------
# M1: hashed embedding
# ---------------------------------------------------------------------------


def token_bucket(w: Column, dim: int, hashed: bool = False) -> Column:
    """Bucket = first 8 hex digits of md5(token) as an integer, modulo dim.
    With ``hashed`` the column already holds md5(token)."""
    h = w if hashed else F.md5(w)
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"),
                  F.lit(dim)).cast("int")


def token_sign(w: Column, hashed: bool = False) -> Column:
    """+1 when the 9th hex digit of md5(token) is even, else -1."""
    h = w if hashed else F.md5(w)
    digit = F.conv(F.substring(h, 9, 1), 16, 10).cast("int")
    return F.when(F.pmod(digit, F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1))


#: Tokens that an embedding task remembers the place of.
KNOWN_TOKENS = 400_000
#: Every ASCII character as a lower-case letter, a digit or a blank.
_ASCII_TOKENS = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_TOKEN = re.compile(r"[^\W_]+")
#: Characters of which every Unicode version at hand says the same (letter, number or neither).
SETTLED = r"\u0000-\u086F\u1E00-\u2C2E\u3000-\u9FEF\uAC00-\uD7A3"


class _Places(dict):
    """Token (UTF-8) -> 2 * bucket, + 1 where the sign is negative; bounded."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        raw = hashlib.md5(word).digest()
        place = 2 * (int.from_bytes(raw[:4], "big") % self.dim) + (raw[4] >> 4 & 1)
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        if len(word) <= 64:
            self[word] = place
        return place


def _shipped_column(t: Column) -> Column:
    """What a worker needs to find the tokens of a text: the text itself if both
    sides know its characters alike, else its tokens, found in the JVM, with
    blanks between."""
    alike = (F.length(t) == F.octet_length(t)) | ~t.rlike(f"[^{SETTLED}]")
    return F.when(alike, t).otherwise(F.array_join(tokens(t), " "))


def shipped_tokens(text: str) -> list[bytes]:
    """The tokens of ``functions.text.tokens`` as UTF-8, from the shipped text."""
    if text.isascii():
        return text.encode().translate(_ASCII_TOKENS).split()
    return " ".join(_TOKEN.findall(text.lower())).encode().split()


def _signed_counts(texts: list[str | None], places: _Places) -> np.ndarray:
    """(row, bucket) sums of the token signs of a slice of texts."""
    out = np.zeros((len(texts), places.dim))
    for row, text in zip(out, texts):
        if text:
            at = np.fromiter(map(places.__getitem__, shipped_tokens(text)), np.int64)
            both = np.bincount(at, minlength=2 * places.dim)
            row[:] = both[::2] - both[1::2]
    return out


def _embed(df: DataFrame, key: str, text: str, dim: int, field: str, kind: str, pack) -> DataFrame:
    """(key, field) per row with a non-zero vector: the worker tokenises the texts
    of an Arrow batch, ``EMBED_ROWS`` at a time, and looks up every token's place.
    A row's vector depends on that row alone, so nothing is shuffled."""
    rows = df.select(F.col(key).alias(key), _shipped_column(F.col(text).cast("string")).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(dim)
        for batch in batches:
            for lo in range(0, batch.num_rows, EMBED_ROWS):
                part = batch.slice(lo, EMBED_ROWS)
                sums = _signed_counts(part.column(1).to_pylist(), places)
                norm = np.sqrt((sums * sums).sum(axis=1))
                some = norm > 0
                unit = sums[some] / norm[some, None]
                yield pa.record_batch([part.column(0).filter(pa.array(some)), pack(unit)], names=[key, field])
    key_type = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {key_type}, {field} {kind}")


def _pack_sparse(unit: np.ndarray) -> pa.Array:
    row, bucket = np.nonzero(unit)
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(unit)))))
    entries = pa.StructArray.from_arrays([pa.array(bucket, pa.int32()), pa.array(unit[row, bucket])],
                                         ["bucket", "weight"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)


def _pack_dense(unit: np.ndarray) -> pa.Array:
    n, dim = unit.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(unit.ravel()))


def embed_sparse(df: DataFrame, key: str, text: str, dim: int = EMBED_DIM) -> DataFrame:
    """M1 -> (key, vec array<struct<bucket int, weight double>>), one row per
    input row with a non-zero vector, entries by bucket.

    Texts that are null or without tokens, or whose signs cancel, get no row
    (zero vector, kept out of the search).
    """
    return _embed(df, key, text, dim, "vec", "array<struct<bucket:int,weight:double>>", _pack_sparse)


def embed_dense(df: DataFrame, key: str, text: str, dim: int = EMBED_DIM) -> DataFrame:
    """M1 dense form -> (key, embedding array<double>), unit norm."""
    return _embed(df, key, text, dim, "embedding", "array<double>", _pack_dense)


# ---------------------------------------------------------------------------
# M2: IDF overlap scorer, P11 sigmoid, W1 ranking
# ---------------------------------------------------------------------------

def distinct_tokens(df: DataFrame, key_cols: list[str], text: Column | str,
                    max_chars: int | None = None) -> DataFrame:
    t = F.col(text) if isinstance(text, str) else text
    if max_chars is not None:
        t = F.substring(F.coalesce(t, F.lit("")), 1, max_chars)
    return df.select(*key_cols, F.explode(F.array_distinct(tokens(t))).alias("w"))


@dataclass
class IdfModel:
    table: DataFrame   # (w, idf)
    n_docs: int

    def unseen(self) -> float:
        return math.log(1.0 + (self.n_docs + 0.5) / 0.5)


def idf_table(docs: DataFrame, key: str = "doc_id", text: str = "content") -> IdfModel:
    """Document frequencies over the whole texts of the document table.

    idf(w) = ln(1 + (N - df + 0.5) / (df + 0.5)); a token never seen has df 0.
    """
    n = docs.count()
    df_ = distinct_tokens(docs.select(key, text), [key], text).groupBy("w").agg(
        F.count(F.lit(1)).alias("df"))
    idf = F.log(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return IdfModel(df_.select("w", idf.alias("idf")), n)


def sigmoid(x: Column) -> Column:
    """P11."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def query_token_weights(queries: DataFrame, idf: IdfModel, key: str = "request_id",
                        text: str = "query") -> DataFrame:
    qt = distinct_tokens(queries, [key], text)
    # the semi-join moves below the vocabulary's aggregate: only the tokens
    # asked for are counted and shuffled
    asked = idf.table.join(qt.select("w").distinct(), "w", "left_semi")
    return (qt.join(asked, "w", "left")
            .select(key, "w", F.coalesce("idf", F.lit(idf.unseen())).alias("idf")))


def overlap_scores(cands: DataFrame, qweights: DataFrame, key: str = "request_id",
                   doc_key: str = "doc_id", content: str = "content") -> DataFrame:
    """M2 + P11: add ``score`` to candidate rows (key, doc_key, content, ...).

    r = sum idf(shared distinct tokens) / sum idf(distinct query tokens)
    (0 when the query has no token); score = sigmoid(8 (r - 0.5)).
    """
    pairs = cands.select(key, doc_key, content).dropDuplicates([key, doc_key])
    ct = distinct_tokens(pairs, [key, doc_key], content)
    shared = (ct.join(qweights, [key, "w"])
              .groupBy(key, doc_key).agg(F.sum("idf").alias("_shared")))
    qtot = qweights.groupBy(key).agg(F.sum("idf").alias("_qtot"))
    r = F.when(F.col("_qtot") > 0, F.coalesce(F.col("_shared"), F.lit(0.0)) / F.col("_qtot")) \
        .otherwise(F.lit(0.0))
    return (cands.join(qtot, key, "left").join(shared, [key, doc_key], "left")
            .withColumn("score", sigmoid(F.lit(8.0) * (r - F.lit(0.5))))
            .drop("_qtot", "_shared"))


def rerank_topn(scored: DataFrame, top_n: int | None = None, key: str = "request_id",
                score: str = "score", pos: str = "pos", tie_decimals: int = 9) -> DataFrame:
    """Per request, score descending, stable (input position breaks
    ties), first ``top_n`` (all when None).  Scores equal to ``tie_decimals``
    places count as ties, so last-bit summation noise cannot reorder them."""
    w = Window.partitionBy(key).orderBy(F.round(score, tie_decimals).desc(), F.col(pos))
    out = scored.withColumn("rank", F.row_number().over(w))
    if top_n is not None:
        out = out.where(F.col("rank") <= top_n)
    return out


# ---------------------------------------------------------------------------
# M3: extractive answer
# ---------------------------------------------------------------------------

def extractive_answer(context: DataFrame, qtokens: DataFrame, key: str = "request_id",
                      rank: str = "rank", content: str = "content",
                      ctx_chars: int = CONTEXT_CHARS,
                      max_words: int = MAX_NEW_TOKENS) -> DataFrame:
    """M3 -> (key, generated_response).

    Sentences of each context doc's first ``ctx_chars`` characters are
    scored by the number of distinct query tokens they contain; the best
    (ties: better doc rank, then earlier sentence) is the answer, cut to its
    first ``max_words`` blank-separated words.  A request whose context has
    no sentence gets no row here (the plan fills "").
    """
    s = (context.select(key, rank, F.posexplode(
        sentences(F.substring(F.coalesce(F.col(content), F.lit("")), 1, ctx_chars)))
        .alias("spos", "sent"))
        .withColumn("sent", F.trim("sent")).where(F.col("sent") != ""))
    st = distinct_tokens(s, [key, rank, "spos"], "sent")
    ov = (st.join(qtokens.select(key, "w"), [key, "w"])
          .groupBy(key, rank, "spos").agg(F.count(F.lit(1)).alias("overlap")))
    s2 = s.join(ov, [key, rank, "spos"], "left").fillna(0, ["overlap"])
    best = s2.groupBy(key).agg(F.max_by("sent", F.struct(
        F.col("overlap"), -F.col(rank), -F.col("spos"))).alias("_best"))
    words = F.slice(F.split(F.col("_best"), " "), 1, max_words)
    return best.select(key, F.array_join(words, " ").alias("generated_response"))


# ---------------------------------------------------------------------------
# M4: sentiment
# ---------------------------------------------------------------------------

def stars_from_polarity(p: Column) -> Column:
    return (F.when(p <= -0.6, 1).when(p <= -0.2, 2).when(p < 0.2, 3)
            .when(p < 0.6, 4).otherwise(5))


def star_label(stars: Column) -> Column:
    return F.when(stars == 1, F.lit("1 star")).otherwise(
        F.concat(stars.cast("string"), F.lit(" stars")))


def sentiment_label(df: DataFrame, key: str, text: str, lexicon: DataFrame,
                    max_chars: int = SCORER_INPUT_CHARS) -> DataFrame:
    """M4 -> (key, label) with label "1 star".."5 stars".

    polarity p = (pos - neg) / max(1, pos + neg) over lexicon hits (token
    occurrences) in the first ``max_chars`` characters.  ``lexicon`` is a
    (w, polarity) table; it is joined, not collected.
    """
    t = df.select(key, F.explode(tokens(F.substring(F.coalesce(F.col(text), F.lit("")), 1,
                                                    max_chars))).alias("w"))
    t = t.join(lexicon.select("w", F.col("polarity").alias("pol")), "w", "left")
    g = t.groupBy(key).agg(F.count_if(F.col("pol") > 0).alias("_pos"),
                           F.count_if(F.col("pol") < 0).alias("_neg"))
    all_keys = df.select(key).join(g, key, "left").fillna(0, ["_pos", "_neg"])
    p = (F.col("_pos") - F.col("_neg")) / F.greatest(F.lit(1), F.col("_pos") + F.col("_neg"))
    return all_keys.select(key, star_label(stars_from_polarity(p)).alias("label"))


# ---------------------------------------------------------------------------
# M5: toxicity
# ---------------------------------------------------------------------------

@dataclass
class TokenLogOdds:
    weights: DataFrame  # (w, weight)
    prior: float


def train_token_logodds(labelled: DataFrame, text: str = "text", label: str = "toxic",
                        key: str = "doc_id") -> TokenLogOdds:
    """Fit per-token log-odds on whole labelled texts (distributed counting).

    weight(w) = ln((c1+1)/(n1+2)) - ln((c0+1)/(n0+2)), prior = ln((n1+1)/(n0+1)),
    where c1/c0 count positive/negative texts containing w.
    """
    row = labelled.agg(F.count_if(F.col(label) == 1).alias("n1"),
                       F.count_if(F.col(label) == 0).alias("n0")).first()
    n1, n0 = int(row["n1"] or 0), int(row["n0"] or 0)
    dt = distinct_tokens(labelled, [key, label], text)
    c = dt.groupBy("w").agg(F.count_if(F.col(label) == 1).alias("c1"),
                            F.count_if(F.col(label) == 0).alias("c0"))
    weight = (F.log((F.col("c1") + 1.0) / F.lit(n1 + 2.0))
              - F.log((F.col("c0") + 1.0) / F.lit(n0 + 2.0)))
    return TokenLogOdds(c.select("w", weight.alias("weight")),
                        math.log((n1 + 1.0) / (n0 + 1.0)))


def toxicity_scores(df: DataFrame, key: str, text: str, model: TokenLogOdds,
                    max_chars: int = SCORER_INPUT_CHARS) -> DataFrame:
    """M5 -> (key, toxicity) = P(toxic) for every row of df."""
    t = distinct_tokens(df, [key], text, max_chars)
    asked = model.weights.join(t.select("w").distinct(), "w", "left_semi")
    s = t.join(asked, "w").groupBy(key).agg(F.sum("weight").alias("_s"))
    return (df.select(key).join(s, key, "left")
            .select(key, sigmoid(F.lit(model.prior) + F.coalesce("_s", F.lit(0.0)))
                    .alias("toxicity")))


def train_toxicity_lr(labelled: DataFrame, text: str = "text", label: str = "toxic",
                      num_features: int = 4096):
    """M5, ML variant: HashingTF + LogisticRegression (a pyspark.ml Pipeline)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    data = labelled.select(tokens(text).alias("tokens"), F.col(label).cast("double").alias("label"))
    pipe = Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="features",
                                      numFeatures=num_features),
                            LogisticRegression(maxIter=50, regParam=0.01)])
    return pipe.fit(data)


def toxicity_scores_lr(df: DataFrame, key: str, text: str, model,
                       max_chars: int = SCORER_INPUT_CHARS) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    data = df.select(key, tokens(F.substring(F.coalesce(F.col(text), F.lit("")), 1, max_chars))
                     .alias("tokens"))
    out = model.transform(data)
    return out.select(key, vector_to_array("probability")[1].alias("toxicity"))


# ---------------------------------------------------------------------------
# M6: pluggable batch scorers
# ---------------------------------------------------------------------------

@dataclass
class ScorerSpec:
    name: str
    factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    schema: str
    aliases: tuple[str, ...] = field(default_factory=tuple)


_SCORERS: dict[str, ScorerSpec] = {}
_ALIASES: dict[str, str] = {}


def register_scorer(name: str, factory, schema: str, aliases: tuple[str, ...] = ()) -> None:
    """Register a scorer; a duplicate name or an alias conflict is an error."""
    if name in _SCORERS or name in _ALIASES:
        raise ValueError(f"scorer {name!r} already registered")
    for a in aliases:
        if a in _SCORERS or a in _ALIASES:
            raise ValueError(f"alias {a!r} conflicts with a registered scorer")
    _SCORERS[name] = ScorerSpec(name, factory, schema, tuple(aliases))
    for a in aliases:
        _ALIASES[a] = name


def unregister_scorer(name: str) -> None:
    spec = _SCORERS.pop(name, None)
    if spec:
        for a in spec.aliases:
            _ALIASES.pop(a, None)


def resolve_scorer(name: str) -> ScorerSpec:
    real = _ALIASES.get(name, name)
    if real not in _SCORERS:
        raise KeyError(f"unknown scorer type {name!r}")
    return _SCORERS[real]


def score_batches(df: DataFrame, name: str) -> DataFrame:
    """M6: apply a registered scorer to Arrow batches of ``df``.

    The model is built by the factory at most once per Python worker
    (module-level cache); batches are length-preserving and an empty batch
    yields nothing.  Batch size = spark.sql.execution.arrow.maxRecordsPerBatch.
    """
    spec = resolve_scorer(name)
    factory, sname = spec.factory, spec.name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from larkspur.operators import scorers as mod  # the worker's module-level cache
        fn = mod._worker_models.get(sname)
        if fn is None:
            fn = mod._worker_models[sname] = factory()
        for pdf in batches:
            if len(pdf) == 0:
                continue
            out = fn(pdf)
            if len(out) != len(pdf):
                raise ValueError(f"scorer {sname!r} changed the batch length")
            yield out

    return df.mapInPandas(run, spec.schema)


_worker_models: dict[str, Callable] = {}
