"""Quality classifier: a sparse ensemble of rules.

Statistics of the whole text (lengths, character classes, repetition) are
measured in an Arrow-batched map.  Shallow boosted trees grown on them give
rules: every path from a root is a conjunction of comparisons.  A logistic
model with an L1 penalty then weighs the rules, most of which get weight zero,
and the rest are compiled into one Spark column expression, so scoring is plain
column arithmetic that anyone can read (``RuleModel.describe``).

The fit uses a bounded sample (``MAX_TRAIN`` labelled rows, those with the
smallest hash of doc_id); everything else covers every row.  The sample's ids
are broadcast (at most MAX_TRAIN of them) and only its statistics reach the
driver.  Rows whose crc32(doc_id as text) mod 5 is 0 are held out of the fit.

Defined cases: null and empty text have all statistics 0 and get the score of
such a row; a null doc_id is never held out nor used in the fit; several
labels of one document count as their mean (a tie counts as good); null labels
are ignored; without any usable label every score is 0.5.  Other columns are
never inputs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import free_name, map_batches, open_table

#: Labelled rows used for the fit.
MAX_TRAIN = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, SHRINK = 24, 3, 32, 0.3
L1, STEPS = 0.001, 400

FEATURES = ("log_chars", "log_words", "mean_word", "distinct_words", "upper", "digits", "spaces",
            "punctuation", "symbols", "non_ascii", "control", "log_lines", "repeated_lines",
            "words_per_line", "top_char", "top_word", "word_tail_symbols", "longest_word")

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[128:] = 6
_CLASS[[c for c in range(32) if c not in (9, 10, 11, 12, 13)]] = 7
_SYMBOL_TAIL = frozenset(b"!#$%&*+/<=>@\\^_|~")


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES for one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=8)
    words = raw.split()
    n_words = len(words)
    lines = [x for x in raw.split(b"\n") if x]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    counts[32] = counts[10] = 0
    per = 1.0 / max(1, n_words)
    return [math.log1p(n), math.log1p(n_words), (n - kinds[3]) * per, len(seen) * per,
            kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n,
            kinds[7] / n, math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
            n_words / max(1, len(lines)), counts.max() / n, max(seen.values(), default=0) * per,
            sum(map(seen.__getitem__, [w for w in seen if w[-1] in _SYMBOL_TAIL])) * per,
            math.log1p(max(map(len, seen), default=0))]


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` with one more column: the array of FEATURES."""
    schema = T.StructType([*docs.schema, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return batch.append_column(name, pa.array([statistics(t) for t in texts], pa.list_(pa.float64())))
    return map_batches(docs, fn, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature number, at most?, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, low, cut in self.terms:
            out &= (x[:, k] <= cut) if low else (x[:, k] > cut)
        return out

    def column(self, stats: str) -> F.Column:
        out = None
        for k, low, cut in self.terms:
            value = F.col(stats)[k]
            term = value <= F.lit(cut) if low else value > F.lit(cut)
            out = term if out is None else out & term
        return out

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[k]} {'<=' if low else '>'} {cut:.6g}" for k, low, cut in self.terms)


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted regression trees on the logistic gradient."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p) + 1e-6
        leaves = [((), np.arange(len(y)))]
        for _ in range(DEPTH):
            grown = []
            for terms, rows in leaves:
                split = _best_split(binned, cuts, grad, hess, rows)
                if split is None:
                    grown.append((terms, rows))
                    continue
                k, b = split
                low = binned[rows, k] <= b
                for side, own in ((True, rows[low]), (False, rows[~low])):
                    path = (*terms, (k, side, float(cuts[k][b])))
                    rules[Rule(path)] = None
                    grown.append((path, own))
            leaves = grown
        for _, rows in leaves:
            margin[rows] += SHRINK * grad[rows].sum() / (hess[rows].sum() + 1.0)
    return list(rules)


def _best_split(binned, cuts, grad, hess, rows):
    best, found = 1e-3, None
    g, h = grad[rows], hess[rows]
    total_g, total_h = g.sum(), h.sum()
    whole = total_g ** 2 / (total_h + 1.0)
    for k, cut in enumerate(cuts):
        if not len(cut):
            continue
        at = binned[rows, k]
        left_g = np.cumsum(np.bincount(at, g, len(cut) + 1))[:-1]
        left_h = np.cumsum(np.bincount(at, h, len(cut) + 1))[:-1]
        gain = (left_g ** 2 / (left_h + 1.0) + (total_g - left_g) ** 2 / (total_h - left_h + 1.0)) - whole
        gain[(left_h < 1e-2) | (total_h - left_h < 1e-2)] = 0
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, found = gain[b], (k, b)
    return found


def lasso_logistic(r: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(intercept, weights) by accelerated proximal gradient steps."""
    n, m = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    step = 4.0 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = z = np.zeros(m + 1)
    w[0] = math.log((y.sum() + 1) / (n - y.sum() + 1))
    t = 1.0
    for _ in range(STEPS):
        new = z - step * (a.T @ (1 / (1 + np.exp(-(a @ z))) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * L1, 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / s * (new - w)
        w, t = new, s
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self, stats: str) -> F.Column:
        """Probability of label 1 as an expression over the statistics array."""
        margin = F.lit(self.intercept)
        for weight, rule in self.rules:
            margin = margin + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            margin = margin + np.where(rule.holds(x), weight, 0.0)
        return 1 / (1 + np.exp(-margin))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if {r}" for w, r in sorted(self.rules, key=lambda p: -abs(p[0]))]


def fit_arrays(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not len(y):
        return RuleModel(0.0, ())
    rules = grow_rules(x, y)
    if not rules:
        return RuleModel(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), ())
    held = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    bias, weights = lasso_logistic(held, y)
    return RuleModel(bias, tuple((float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-4))


def is_held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", max_train: int = MAX_TRAIN) -> RuleModel:
    """Model from the labelled documents that are not held out."""
    key = F.col(id_col).cast("long")
    sample = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(key))
              .groupBy(key.alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(max_train))
    texts = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = with_statistics(texts.join(F.broadcast(sample), "id")).select("id", "y", "stats").toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    x = np.array(rows.column("stats").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, rows.column("id").to_numpy()))
    return fit_arrays(x[order], y[order])


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches the threshold."""
    name = free_name(docs, "quality_stats")
    return with_statistics(docs, text_col, name).where(model.score(name) >= threshold).drop(name)


QUERY_NAME = "op3_quality_rules"
#: Fitted model; tested on held-out accuracy instead.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = open_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, open_table(spark, sf_dir, "labels"))
    scored = with_statistics(docs).withColumn("score", model.score("stats"))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
