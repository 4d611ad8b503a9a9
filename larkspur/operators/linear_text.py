"""M4, M6: an elastic-net logistic regression over hashed tokens as a plug-in
scorer.

Training is distributed: texts become hashed token features once (a written
table), then every accelerated proximal-gradient step broadcasts the
``DIM`` weights (a fixed 256 kB) and sums the gradient over all partitions; one
dense row per partition comes back.  The soft threshold of the L1 part leaves a
sparse model.  ``save_model`` writes the weights as one ``.npy`` file, which
``sc.addFile`` ships; a worker maps it into memory once (``numpy`` memory map,
shared by the worker's batches) and scores whole Arrow batches.

``polarity_lexicon`` gives the learned weight of every word of a text table.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import scorers
from larkspur.session import cut_lineage

#: Buckets of hashed tokens; the last weight is the intercept.
DIM = 1 << 15


def _bucket(tokens: list[str]) -> np.ndarray:
    import xxhash
    return np.fromiter({xxhash.xxh32_intdigest(t) % DIM for t in tokens}, np.int32)


def features(text: str | None) -> np.ndarray:
    """Buckets of the distinct tokens (letters and digits, lower-cased)."""
    import regex
    return np.sort(_bucket(regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())))


def _margins(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """Intercept plus the mean-free sum of weights, scaled by the root of the
    number of buckets, per text."""
    size = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int32)
    ends = np.append(0, np.cumsum(size))
    sums = np.append(0.0, np.cumsum(np.asarray(w)[flat]))
    return (sums[ends[1:]] - sums[ends[:-1]]) / np.sqrt(np.maximum(size, 1)) + w[DIM]


def train_elastic_net(labelled: DataFrame, text: str = "text", label: str = "quality", l1: float = 2e-4,
                      l2: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """DIM + 1 weights; rows whose label is not 0 or 1 are left out.

    Both classes weigh the same.  Steps of a fixed size (the loss of rows of
    unit length is 1/4-smooth, the intercept adds one) with momentum."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"),
                                                          F.col(text).cast("string").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), ids], names=["y", "ids"])
    data = cut_lineage(rows.mapInArrow(hashed, "y int, ids array<int>"))
    n = data.agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = int(n.p or 0), int(n.n) - int(n.p or 0)
    w = np.zeros(DIM + 1)
    if not pos or not neg:
        return w
    sc = labelled.sparkSession.sparkContext
    look, pace = w, 1.0
    for _ in range(rounds):
        shared = sc.broadcast(look)

        def gradient(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(DIM + 1)
            for batch in batches:
                y = batch.column(0).to_numpy()
                lists = batch.column(1)
                size = lists.value_lengths().to_numpy()
                flat, rows = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), size)
                ids = np.split(flat, np.cumsum(size)[:-1]) if len(y) else []
                p = 1.0 / (1.0 + np.exp(-np.clip(_margins(ids, shared.value), -50, 50)))
                slope = (p - y) * np.where(y == 1, 0.5 / pos, 0.5 / neg)
                total[:DIM] += np.bincount(flat, (slope / np.sqrt(np.maximum(size, 1)))[rows], minlength=DIM)
                total[DIM] += slope.sum()
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["g"])
        grad = np.zeros(DIM + 1)
        for r in data.mapInArrow(gradient, "g binary").toLocalIterator():   # one row per partition
            grad += np.frombuffer(r.g)
        shared.unpersist()
        grad[:DIM] += l2 * look[:DIM]
        step = 1.0 / (0.5 + l2)
        new = look - step * grad
        new[:DIM] = np.sign(new[:DIM]) * np.maximum(np.abs(new[:DIM]) - step * l1, 0.0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look = new + (pace - 1) / faster * (new - w)
        w, pace = new, faster
    return w


def save_model(weights: np.ndarray, path: str | None = None) -> str:
    path = path or os.path.join(tempfile.mkdtemp(prefix="larkspur-"), f"linear-{uuid.uuid4().hex}.npy")
    np.save(path, np.asarray(weights, np.float64))
    return path


def register_linear_scorer(spark: SparkSession, name: str, path: str, on_load=None) -> None:
    """Ships the model file and registers a scorer (doc_id, p) over it.
    ``on_load`` is called when a worker opens the file."""
    spark.sparkContext.addFile(path)
    file = os.path.basename(path)

    def factory():
        from pyspark import SparkFiles
        w = np.load(SparkFiles.get(file), mmap_mode="r")
        if on_load is not None:
            on_load()

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            z = _margins([features(t) for t in pdf["text"]], w)
            return pd.DataFrame({"doc_id": pdf["doc_id"], "p": 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))})
        return score
    scorers.register_scorer(name, factory, "doc_id long, p double")


def polarity_lexicon(texts: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """(w, polarity) of the words with a weight; words of one bucket share it."""
    words = texts.select(F.explode(F.array_distinct(scorers.tokens(F.coalesce(F.col(text), F.lit("")))))
                         .alias("w")).distinct()
    shared = texts.sparkSession.sparkContext.broadcast(np.asarray(weights))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            at = [xxhash.xxh32_intdigest(t.lower()) % DIM for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(shared.value[at] if at else [], pa.float64())],
                                  names=["w", "polarity"])
    return words.mapInArrow(look_up, "w string, polarity double").where("polarity <> 0")
