"""Toxicity: character n-gram linear classifier on naive Bayes log-count ratios (operator 8).

A text is the set of its hashed character 3-, 4- and 5-grams (case folded, one
space at each end).  Each feature is scaled by its log-count ratio
``log((p / |p|) / (q / |q|))`` of toxic and clean training texts and an
L2-regularised logistic regression is fitted on the scaled features.

The fit uses a bounded sample of labelled rows: the ``max_rows`` first by a
hash of doc_id, as far as their features fit in ``max_features``.  Scoring
runs over whole texts of every row; weights are a fixed ``2**BITS`` vector.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buyerlens.llm.labelled import collect_bounded, held_out, no_model_score, training_texts
from buyerlens.llm.text import column_bytes, row_groups
from buyerlens.session import ship_package

BITS = 18
SIZES = (3, 4, 5)
MAX_ROWS = 6000
MAX_FEATURES = 16_000_000
#: Bytes of text that a task turns into Python strings at a time.
SLICE_BYTES = 1 << 20
#: Features that the fit works on at a time.
CHUNK = 500_000
#: Parameters of the fit.
SMOOTHING, L2, STEPS, RATE = 1.0, 1e-2, 100, 0.05
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


@dataclass
class LinearModel:
    weights: np.ndarray  # float32, already multiplied by the log-count ratios
    bias: float
    n_rows: int
    n_positive: int


def text_features(texts: list[str | None]):
    """Sorted distinct feature indices of each text."""
    mark = np.zeros(1 << BITS, bool)
    shift = np.uint32(32 - BITS)
    i = 0
    while i < len(texts):
        chunk, size = [], 0
        while i < len(texts) and (size < 1 << 20 or not chunk):
            chunk.append(" " + (texts[i] or "").lower() + " ")
            size += len(chunk[-1])
            i += 1
        codes = np.frombuffer("".join(chunk).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in chunk])
        found = []
        h = np.zeros(len(codes), np.uint32)
        for n in range(1, max(SIZES) + 1):
            h = h[:len(codes) - n + 1] + codes[n - 1:] * _ODD[n - 1]
            if n in SIZES:
                x = h ^ (h >> np.uint32(15))
                x = x * np.uint32(0x2C1B3C6D + 2 * n)
                x ^= x >> np.uint32(12)
                x *= np.uint32(0x297A2D39)
                found.append((n, x >> shift))
        start = 0
        for end in ends:
            for n, x in found:
                mark[x[start:max(end - n + 1, start)]] = True
            u = np.flatnonzero(mark)
            mark[u] = False
            yield u if end - start > 2 else u[:0]  # an empty text is only its two end marks
            start = end


def fit_logistic(rows: list[np.ndarray], y: np.ndarray) -> LinearModel:
    """Log-count ratios and logistic weights of sparse 0/1 rows."""
    dims, n, pos = 1 << BITS, len(y), int(y.sum())
    share = no_model_score(y)
    if share is not None:
        return LinearModel(np.zeros(dims, np.float32), float(np.log(share / (1 - share))), n, pos)
    counts = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(counts)])
    idx = np.concatenate(rows)
    # rows are worked through in chunks, so the driver holds the features once and little else
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(int(np.searchsorted(starts, starts[cuts[-1]] + CHUNK, side="right")) - 1, cuts[-1] + 1))
    chunks = [(i, j, idx[starts[i]:starts[j]]) for i, j in zip(cuts, cuts[1:])]

    def spread(values):
        """Sum over rows of their value, per feature."""
        return sum(np.bincount(part, weights=np.repeat(values[i:j], counts[i:j]), minlength=dims) for i, j, part in chunks)

    p, q = SMOOTHING + spread(y), SMOOTHING + spread(1 - y)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    w, bias = np.zeros(dims), float(np.log(pos / (n - pos)))
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    for step in range(1, STEPS + 1):
        z, scaled = np.full(n, bias), w * ratio
        for i, j, part in chunks:
            filled = np.flatnonzero(counts[i:j])
            if len(filled):
                z[i + filled] += np.add.reduceat(scaled[part], starts[i + filled] - starts[i])
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.empty(dims + 1)
        g[:dims] = spread(err) * ratio / n + L2 * w
        g[dims] = err.mean()
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w -= move[:dims]
        bias -= move[dims]
    return LinearModel((w * ratio).astype(np.float32), float(bias), n, pos)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS,
        max_features: int = MAX_FEATURES) -> LinearModel:
    """Train on ``labels(doc_id, <label> 0/1)``; null labels and ids are ignored, and of several
    labels of one document the largest counts.  Without rows of both classes every
    text scores the smoothed share of label 1, (k + 0.5) / (n + 2)."""
    ship_package(docs.sparkSession)
    rows, y = collect_bounded(training_texts(docs, labels, label, max_rows),
                              lambda col: [u.astype(np.int32) for u in text_features(col.to_pylist())], "int", max_features)
    return fit_logistic(rows, y)


def text_scores(texts, model: LinearModel) -> np.ndarray:
    z = np.array([model.weights[u].sum(dtype=np.float64) for u in text_features(texts)]) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _slices(batch, at: int):
    """Parts of a batch whose texts have at most ``SLICE_BYTES`` together, or one longer text."""
    _, offsets = column_bytes(batch.column(at).cast(pa.string()))
    for i, j in row_groups(offsets, SLICE_BYTES):
        yield batch.slice(i, j - i)


def _score(batches, model):
    for batch in batches:
        for part in _slices(batch, 1):
            s = text_scores(part.column(1).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["doc_id", "score"])


def _pass(batches, model, limit: float):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for part in _slices(batch, at):
            s = text_scores(part.column(at).to_pylist(), model.value)
            yield part.filter(pa.array(s < limit))


def score(docs: DataFrame, model: LinearModel) -> DataFrame:
    """``doc_id, score`` (0 to 1, higher is likelier toxic) for every row of ``docs``,
    repeated rows and null or empty texts included; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, model=sent), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: LinearModel, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``limit``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_pass, model=sent, limit=limit), docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """One row per row of documents; a row without a doc_id is scored and is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = score(docs, model)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))
