"""Document quality from a linear-chain conditional random field over lines (operator 10).

Every line is good or bad.  Its features are shares of byte classes, repeated
words, length and duplicate flags, joined with those of the line before and
after it.  Training gives each line its document's label; forward-backward
marginals are averaged, weighted by line length, into the document's score.

The fit uses a bounded sample of labelled rows: the ``max_rows`` first by a
hash of doc_id, as far as their line features fit in ``max_values``.  Scoring
runs over whole texts of every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buyerlens.llm.labelled import collect_bounded, held_out, no_model_score, training_texts
from buyerlens.llm.text import FOLDED_BYTE, U64, column_bytes, mix, row_groups, span_hashes, word_spans
from buyerlens.session import ship_package

MAX_ROWS, MAX_VALUES = 8000, 16_000_000
L2, STEPS, RATE = 1e-3, 200, 0.08
#: Number of features of a line by itself.
BASE = 14


def _class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], np.uint8)


_LETTER = _class(lambda b: b >= 128 or chr(b).isalpha())
_UPPER = _class(lambda b: 65 <= b <= 90)
_DIGIT = _class(lambda b: 48 <= b <= 57)
_SPACE = _class(lambda b: b in (32, 9, 13, 11, 12))
_PLAIN = _class(lambda b: chr(b) in ".,;:'\"-?()")
_STOP = _class(lambda b: chr(b) in ".?!:")
_ODD = 1 - np.maximum.reduce([_LETTER, _DIGIT, _SPACE, _PLAIN])


def line_features(data: np.ndarray, offsets: np.ndarray):
    """Features and byte length of every line, and each row's range of lines (one line at least)."""
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # a line starts at each row start and after each newline
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n_rows), np.searchsorted(offsets, breaks, side="right") - 1])
    turn = np.lexsort((starts, owner))
    starts, owner = starts[turn], owner[turn]
    ends = np.concatenate([starts[1:] - 1, [len(data)]]) if len(starts) else starts
    last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(starts) else np.zeros(0, bool)
    ends[last] = offsets[1:][owner[last]]
    length = ends - starts
    size = np.maximum(length, 1).astype(float)

    def share(table):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:], dtype=np.int64)
        return (total[ends] - total[starts]).astype(float)

    letters = share(_LETTER)
    ws, we = word_spans(data, offsets)
    h = span_hashes(data, ws, we, FOLDED_BYTE)
    w0, w1 = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    words = (w1 - w0).astype(float)
    line_of = np.searchsorted(starts, ws, side="right") - 1

    def repeats(back):
        same = np.zeros(len(h) + 1, np.int64)
        if len(h) > back:
            hit = (h[back:] == h[:-back]) & (line_of[back:] == line_of[:-back])
            same[back + 1:] = np.cumsum(hit)
        return (same[w1] - same[w0]) / np.maximum(words - back, 1)

    byte_sum = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=byte_sum[1:])
    line_hash = mix((byte_sum[w1] - byte_sum[w0]) ^ mix(owner.astype(np.uint64)))
    order = np.argsort(line_hash, kind="stable")
    again = np.zeros(len(starts), float)
    again[order[1:][line_hash[order][1:] == line_hash[order][:-1]]] = 1
    again[words == 0] = 0
    tail = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(starts), np.uint8)
    f = np.empty((len(starts), BASE), np.float32)
    f[:, 0] = np.log1p(length) / 6
    f[:, 1] = letters / size
    f[:, 2] = share(_UPPER) / np.maximum(letters, 1)
    f[:, 3] = share(_DIGIT) / size
    f[:, 4] = share(_ODD) / size
    f[:, 5] = f[:, 4] > 0.05
    f[:, 6] = share(_PLAIN) / size
    f[:, 7] = repeats(1)
    f[:, 8] = repeats(2)
    f[:, 9] = f[:, 7] > 0.2
    f[:, 10] = np.minimum(letters / np.maximum(words, 1) / 10, 3)
    f[:, 11] = words < 3
    f[:, 12] = again
    f[:, 13] = (_STOP[tail] > 0) & (length > 0)
    return f, length, np.searchsorted(owner, np.arange(n_rows + 1))


def with_neighbours(f: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each line's features, a constant, those of its neighbours in the document, and edge flags."""
    n = len(f)
    out = np.zeros((n, 3 * BASE + 3), np.float64)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[rows[:-1]] = True
    last[rows[1:] - 1] = True
    out[:, :BASE] = f
    out[1:, BASE:2 * BASE] = f[:-1]
    out[first, BASE:2 * BASE] = 0
    out[:-1, 2 * BASE:3 * BASE] = f[1:]
    out[last, 2 * BASE:3 * BASE] = 0
    out[:, -3], out[:, -2], out[:, -1] = 1, first, last
    return out


def marginals(score: np.ndarray, rows: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected transition counts, and the log partition sum of all chains.

    ``score`` is the log-odds a line's features give to good; ``move[i, j]`` the weight of
    going from state i to j (0 bad, 1 good).  All chains advance together, longest first.
    """
    sizes = np.diff(rows)
    turn = np.argsort(-sizes, kind="stable")
    start, sizes = rows[:-1][turn], sizes[turn]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
    emit = np.stack([np.zeros(len(score)), score], axis=1)
    alpha, beta = np.empty((len(score), 2)), np.zeros((len(score), 2))
    if steps:
        alpha[start] = emit[start]
    for t in range(1, steps):
        at = start[:alive[t]] + t
        prev = alpha[at - 1]
        alpha[at] = np.logaddexp(prev[:, :1] + move[0], prev[:, 1:] + move[1]) + emit[at]
    pairs = np.zeros((2, 2))
    end = start + sizes - 1
    z = np.zeros(len(score))
    chain = np.logaddexp(alpha[end, 0], alpha[end, 1])
    z[start] = chain
    for t in range(steps - 1, 0, -1):
        k = alive[t]
        at = start[:k] + t
        after = emit[at] + beta[at]
        beta[at - 1] = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
        joint = alpha[at - 1][:, :, None] + move + after[:, None, :] - chain[:k, None, None]
        pairs += np.exp(joint).sum(axis=0)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs, float(chain.sum())


@dataclass
class Crf:
    weights: np.ndarray
    move: np.ndarray
    share: float | None = None  # the score of every text if training rows lacked a class


def fit_crf(lines: list[np.ndarray], y: np.ndarray) -> Crf:
    """Maximum likelihood with an L2 penalty; each line carries its document's label."""
    share = no_model_score(y)
    if share is not None:
        return Crf(np.zeros(3 * BASE + 3), np.zeros((2, 2)), share)
    rows = np.concatenate([[0], np.cumsum([len(f) for f in lines])]).astype(np.int64)
    x = with_neighbours(np.concatenate(lines), rows)
    gold = np.repeat(y, np.diff(rows))
    steps = np.zeros((2, 2))
    steps[0, 0] = (np.diff(rows) - 1)[y == 0].sum()
    steps[1, 1] = (np.diff(rows) - 1)[y == 1].sum()
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, STEPS + 1):
        p, pairs, _ = marginals(x @ w, rows, move)
        g = np.concatenate([x.T @ (p - gold), (pairs - steps).ravel()]) / len(y)
        g += L2 * np.concatenate([w, move.ravel()])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        d = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w -= d[:len(w)]
        move -= d[len(w):].reshape(2, 2)
    return Crf(w, move)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS,
        max_values: int = MAX_VALUES) -> Crf:
    """Train on ``labels(doc_id, <label> 0/1)``; null labels and ids are ignored, and of several labels
    of one document the largest counts.  Without rows of both classes every text scores the
    smoothed share of label 1, (k + 0.5) / (n + 2)."""
    ship_package(docs.sparkSession)
    flat, y = collect_bounded(training_texts(docs, labels, label, max_rows), _flat_features, "float", max_values)
    return fit_crf([f.reshape(-1, BASE) for f in flat], y)


def _flat_features(col: pa.Array) -> list[np.ndarray]:
    out = []
    data, offsets = column_bytes(col)
    for i, j in row_groups(offsets):
        f, _, rows = line_features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        out += [f[a:b].ravel() for a, b in zip(rows[:-1], rows[1:])]
    return out


def text_scores(col: pa.Array, model: Crf) -> tuple[np.ndarray, list[np.ndarray]]:
    """Quality of each text and P(good) of its lines."""
    scores, lines = [], []
    data, offsets = column_bytes(col)
    for i, j in row_groups(offsets):
        f, length, rows = line_features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        p, _, _ = marginals(with_neighbours(f, rows) @ model.weights, rows, model.move)
        if model.share is not None:
            p[:] = model.share
        weight = length + 1.0  # the line and its newline
        scores.append(np.add.reduceat(p * weight, rows[:-1]) / np.add.reduceat(weight, rows[:-1]))
        lines += np.split(p, rows[1:-1])
    return np.concatenate(scores) if scores else np.zeros(0), lines


def _score(batches, model):
    for batch in batches:
        s, lines = text_scores(batch.column("text"), model.value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()),
                                          pa.array(lines, pa.list_(pa.float64()))], ["doc_id", "score", "line_good"])


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """``doc_id, score, line_good`` for every row of ``docs(doc_id, text)``: quality from 0 to 1 and P(good) of
    each line.  A null text is an empty one, which is a single empty line.  Repeated rows are
    scored each; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, model=sent), "doc_id long, score double, line_good array<double>")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """One row per row of documents; a row without a doc_id is scored and is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted"))
