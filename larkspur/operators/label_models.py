"""M4, M5: sentiment and toxicity learned from labelled texts, and calibrated.

``fit_labels`` learns all labels in one pass: a text's raw score for a label is
its prior plus the log-odds of its distinct tokens (counted with map-side
combine over the texts that are not held out).  The held-out texts (by the md5
of their id) are scored as production texts are, counted per score bin, and
pooled into the best non-decreasing fit (pool adjacent violators): the
calibrated score of a bin is the share of labelled texts it stands for.  Weights
stay a table; priors and the at most ``BINS`` pooled shares are all that the
driver sees.

Texts without a known token get the calibrated prior.  Null labels are left out
of counts and bins; null texts have no tokens; without held-out labels the
score stays the uncalibrated probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.constants import SCORER_INPUT_CHARS
from larkspur.operators.scorers import distinct_tokens, sigmoid
from larkspur.session import cut_lineage

#: Score bins of a calibration: BINS of BIN_WIDTH on the logit scale, around 0.
BINS, BIN_WIDTH = 32, 2.0
#: First md5 digits of the ids that are held out of the counts.
HELD_OUT = ("0", "1", "2")


@dataclass
class Label:
    prior: float
    shares: list[float] | None        # calibrated share per bin


@dataclass
class LabelModels:
    weights: DataFrame                # (w, one weight column per label)
    labels: dict[str, Label]


def held_out(key: str) -> Column:
    return F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 1).isin(*HELD_OUT)


def score_bin(raw: str) -> Column:
    at = F.floor(F.col(raw) / BIN_WIDTH) + BINS // 2
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at)).cast("int")


def pooled_shares(bins: list[tuple[int, int, int]]) -> list[float] | None:
    """Non-decreasing shares of positives for all bins, from (bin, rows,
    positives); a bin without rows takes the share of the one below it (the
    lowest: of the one above)."""
    blocks: list[list] = []                               # [first bin, rows, positives]
    for b, n, pos in sorted(bins):
        blocks.append([b, n, pos])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, n, pos = blocks.pop()
            blocks[-1][1] += n
            blocks[-1][2] += pos
    if not blocks:
        return None
    shares, at = [], 0
    for b in range(BINS):
        while at + 1 < len(blocks) and blocks[at + 1][0] <= b:
            at += 1
        shares.append(blocks[at][2] / blocks[at][1])
    return shares


def fit_labels(labelled: DataFrame, labels: tuple[str, ...], text: str = "text", key: str = "doc_id",
               max_chars: int = SCORER_INPUT_CHARS) -> LabelModels:
    """Weights and calibrations of every 0/1 label column."""
    rows = labelled.select(key, text, *labels).withColumn("_held", held_out(key))
    seen, held = rows.where(~F.col("_held")), rows.where("_held")
    n = seen.agg(*[F.count_if(F.col(c) == v).alias(f"{c}{v}") for c in labels for v in (0, 1)]).first()
    # a row is a text of its own also when ids repeat
    counts = seen.select(*labels, F.explode(F.array_distinct(_tokens(text))).alias("w")).groupBy("w") \
        .agg(*[F.count_if(F.col(c) == v).alias(f"_{c}{v}") for c in labels for v in (0, 1)])
    weights = cut_lineage(counts.select("w", *[
        (F.log((F.col(f"_{c}1") + 1.0) / F.lit(n[f"{c}1"] + 2.0))
         - F.log((F.col(f"_{c}0") + 1.0) / F.lit(n[f"{c}0"] + 2.0))).alias(c) for c in labels]))
    models = LabelModels(weights, {c: Label(math.log((n[f"{c}1"] + 1.0) / (n[f"{c}0"] + 1.0)), None)
                                   for c in labels})
    scored = raw_scores(held, key, text, models, max_chars).join(held.select(key, *labels), key)
    bins = scored.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), score_bin(f"raw_{c}").alias("bin"), F.col(c).cast("int").alias("y"))
        for c in labels])).alias("e")).select("e.*").where("y IN (0, 1)") \
        .groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).collect()
    for c in labels:
        models.labels[c].shares = pooled_shares([(r.bin, r.n, r.pos) for r in bins if r.label == c])
    return models


def _tokens(text: str) -> Column:
    from larkspur.operators.scorers import tokens
    return tokens(F.coalesce(F.col(text), F.lit("")))


def raw_scores(df: DataFrame, key: str, text: str, models: LabelModels,
               max_chars: int = SCORER_INPUT_CHARS) -> DataFrame:
    """(key, raw_<label>...): prior plus summed weights, for every row of df."""
    t = distinct_tokens(df, [key], text, max_chars)
    asked = models.weights.join(t.select("w").distinct(), "w", "left_semi")
    sums = t.join(asked, "w").groupBy(key).agg(*[F.sum(c).alias(f"raw_{c}") for c in models.labels])
    return df.select(key).join(sums, key, "left").select(key, *[
        (F.lit(m.prior) + F.coalesce(f"raw_{c}", F.lit(0.0))).alias(f"raw_{c}") for c, m in models.labels.items()])


def label_scores(df: DataFrame, key: str, text: str, models: LabelModels,
                 max_chars: int = SCORER_INPUT_CHARS) -> DataFrame:
    """(key, <label>...): calibrated probabilities."""
    raw = raw_scores(df, key, text, models, max_chars)

    def calibrated(c: str, m: Label) -> Column:
        if m.shares is None:
            return sigmoid(F.col(f"raw_{c}"))
        return F.element_at(F.array(*[F.lit(float(s)) for s in m.shares]), score_bin(f"raw_{c}") + 1)
    return raw.select(key, *[calibrated(c, m).alias(c) for c, m in models.labels.items()])
