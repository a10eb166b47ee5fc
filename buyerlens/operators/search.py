"""Sequential model-based hyper-parameter search.

A Gaussian process with a Matern 5/2 kernel models the score over the unit cube
of the search space; each step fits it to the trials so far and takes the batch
of candidates with the largest expected improvement (every chosen candidate is
assumed to reach its predicted score before the next one is chosen).

Every trial is fitted and scored on all labelled rows.  Up to ``boosting.TASK_ROWS`` rows, the
trials of a batch run as one Spark job, a task for each trial and fold, on the broadcast table: bins
of one byte a feature.  The folds of a trial on a larger table are grown in shared passes over its rows
(``boosting.boost``), some trials at a time.  A fold stops once ``PATIENCE`` rounds brought too little progress,
so the number of rounds is searched up to the limit that the trial draws.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buyerlens import params
from buyerlens.operators import boosting as bo
from buyerlens.session import ship_package

TRIALS = 100
#: Random trials before the model is used, and trials of one Spark job.
FIRST, BATCH = 10, 10
#: Candidates whose expected improvement is compared in a step.
CANDIDATES = 2000
#: Bins of a feature, and trials on a large table that are grown at a time.
BINS, AT_ONCE = 63, 4
#: A trial stops a fold once that many rounds lowered its held-out loss by less than this share.
PATIENCE, MIN_PROGRESS = 10, 0.005

# Search spaces of the reference, by the names of ``BoostSpec``: kind, lowest, highest (fixed values).
CLASSIFIER_SPACE = {
    "rate": ("log", 0.01, 1.0), "rounds": ("int", 100, 10000), "leaves": ("int", 2, 100), "depth": ("int", 1, 16),
    "min_rows": ("int", 10, 100), "row_share": ("real", 0.01, 1.0), "sample_every": ("int", 0, 10),
    "feature_share": ("real", 0.5, 1.0), "l1": ("real", 0.0, 0.5), "l2": ("real", 0.0, 0.5)}
REGRESSOR_SPACE = {**CLASSIFIER_SPACE, "rate": ("log", 0.01, 0.1)}
BOOSTED_REGRESSOR_SPACE = {
    "rate": ("log", 0.01, 1.0), "rounds": ("int", 50, 1000), "depth": ("int", 2, 10), "row_share": ("real", 0.1, 1.0),
    "feature_share": ("real", 0.1, 1.0), "l2": ("log", 1e-9, 1000.0), "l1": ("log", 1e-9, 1.0), "min_gain": ("log", 1e-9, 0.5),
    "min_hess": ("int", 1, 10)}


def decode(space: dict, u: np.ndarray) -> dict:
    """Parameters at a point of the unit cube."""
    out = {}
    for (name, (kind, lo, hi)), x in zip(space.items(), u.tolist()):
        if kind == "log":
            out[name] = math.exp(math.log(lo) + x * (math.log(hi) - math.log(lo)))
        elif kind == "int":
            out[name] = min(int(lo + x * (hi - lo + 1)), hi)
        else:
            out[name] = lo + x * (hi - lo)
    return out


# ------------------------------------------------------------------ surrogate
def _matern(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    d = np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0.0)) * (math.sqrt(5.0) / length)
    return (1 + d + d * d / 3) * np.exp(-d)


class Surrogate:
    """Gaussian process on standardised scores; length and noise maximise the likelihood over a small grid."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.mean, self.scale = x, float(y.mean()), float(y.std()) or 1.0
        self.y = (y - self.mean) / self.scale
        best = None
        for length in (0.2, 0.4, 0.8, 1.6, 3.2):
            base = _matern(x, x, length)
            for noise in (1e-6, 1e-3, 1e-2, 1e-1):
                chol = np.linalg.cholesky(base + (noise + 1e-9) * np.eye(len(x)))
                z = np.linalg.solve(chol, self.y)
                fit = -0.5 * float(z @ z) - float(np.log(np.diag(chol)).sum())
                if best is None or fit > best[0]:
                    best = (fit, length, chol, z)
        _, self.length, self.chol, self.z = best

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.linalg.solve(self.chol, _matern(self.x, x, self.length))
        mean = v.T @ self.z
        return self.mean + self.scale * mean, self.scale * np.sqrt(np.maximum(1.0 - (v * v).sum(axis=0), 1e-12))


_erf = np.vectorize(math.erf)


def expected_improvement(mean: np.ndarray, sd: np.ndarray, best: float) -> np.ndarray:
    """Expected amount by which a normal score exceeds ``best``."""
    z = (mean - best) / sd
    return (mean - best) * 0.5 * (1 + _erf(z / math.sqrt(2))) + sd * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def propose(x: np.ndarray, y: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """The next ``n`` points of the unit cube; larger scores are better."""
    dims = x.shape[1]
    out = []
    for _ in range(n):
        model = Surrogate(x, y)
        near = np.clip(x[np.argmax(y)] + rng.normal(0, 0.1, (CANDIDATES // 4, dims)), 0, 1 - 1e-9)
        at = np.concatenate([rng.random((CANDIDATES, dims)), near])
        mean, sd = model.predict(at)
        pick = int(np.argmax(expected_improvement(mean, sd, float(y.max()))))
        out.append(at[pick])
        x, y = np.concatenate([x, at[pick:pick + 1]]), np.append(y, mean[pick])
    return np.array(out)


# ------------------------------------------------------------------ trials
def fit_in_memory(bins, y, fold, w, keys, spec: bo.BoostSpec, folds: Sequence[int], n_bins: int, first: int = 0) -> list[bo.Ensemble]:
    """One ensemble for each left-out fold, on rows in memory; ``first`` numbers the first of them."""
    return [bo.fit_alone(bins, y, fold, w, keys, spec, k, n_bins, m) for m, k in enumerate(folds, first)]


def fold_score(metric: str, e: bo.Ensemble, bins, y) -> float:
    """Score on the left-out rows, larger is better: recall, negative mean squared error or R2."""
    prediction, _ = e.outcome(bins)
    if metric == "recall":
        positive = y == 1
        return float((prediction[positive] == 1).mean()) if positive.any() else 0.0
    mse = float(((y - prediction) ** 2).mean()) if len(y) else 0.0
    if metric == "mse":
        return -mse
    var = float(y.var()) if len(y) else 0.0
    return 1 - mse / var if var else 0.0


def _run_trials(batches, specs, sent, metric, folds):
    rows = sent.value
    for batch in batches:
        for task in batch.column("id").to_pylist():
            i, m = divmod(task, len(folds))
            e = rows.fit("trial", specs[i], folds[m], m)
            own = rows.fold == e.fold
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([fold_score(metric, e, rows.bins[own], rows.y[own])]),
                                              pa.array([float(e.rounds)])], ["id", "score", "rounds"])


def _trials_in_tasks(spark, specs, sent, metric: str, folds: Sequence[int]) -> list[tuple]:
    """Score and rounds of each trial and fold, in order, a task for each."""
    n = len(specs) * len(folds)
    done = spark.range(0, n, 1, n).mapInArrow(
        partial(_run_trials, specs=specs, sent=sent, metric=metric, folds=folds), "id long, score double, rounds double").collect()
    return [tuple(r)[1:] for r in sorted(tuple(r) for r in done)]


def _trials_in_passes(specs, df: DataFrame, features, metric: str, folds, label: str, key: str, fold_col: str, weight_col) -> list[tuple]:
    """The same on a table that no task holds: the folds of a trial are grown in shared passes, and scored by an aggregate."""
    y, p = F.col(label).cast("double"), F.col("prediction")
    df = df.filter(F.col(label).isNotNull())

    def trial(spec):
        model = bo.boost(df, features, [("trial", spec, k) for k in folds], label, key, fold_col, weight_col, BINS)
        sums = {r[0]: r for r in model.predict(df, fold_col).groupBy(F.col(fold_col).cast("int").alias("fold")).agg(
            F.count("*").alias("n"), F.count_if(y == 1).alias("positive"), F.count_if((y == 1) & (p == 1)).alias("hit"),
            F.avg((y - p) ** 2).alias("mse"), F.var_pop(y).alias("var")).collect()}
        out = []
        for e in model.ensembles:
            r = sums[e.fold]
            score = {"recall": lambda: r["hit"] / r["positive"] if r["positive"] else 0.0, "mse": lambda: -r["mse"],
                     "r2": lambda: 1 - r["mse"] / r["var"] if r["var"] else 0.0}[metric]()  # noqa: B023
            out.append((score, float(e.rounds)))
        return out
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [x for part in pool.map(trial, specs) for x in part]


def search(df: DataFrame, features: Sequence[str], space: dict, start: bo.BoostSpec, metric: str, fold_col: str, label: str = "label",
           key: str = "ID_BUYER", weight_col: str | None = None, n_trials: int = TRIALS,
           seed: int = params.SEED) -> tuple[bo.BoostSpec, DataFrame]:
    """Best spec, its rounds set to the mean of those its folds kept, and the table of trials.

    ``metric`` is ``recall``, ``mse`` (lowest wins) or ``r2``, averaged over the left-out folds.  The table
    has ``trial, metric, rounds, best`` and the drawn parameters as a map.  A table without labelled rows
    gives ``start`` and no trials.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = bo.labelled(df, features, label, key, fold_col, weight_col)
    schema = "trial int, metric double, rounds double, best boolean, parameters map<string,double>"
    counts = dict(map(tuple, rows.groupBy("__fold").count().collect()))
    folds = sorted(counts)
    if not folds:
        return start, spark.createDataFrame([], schema)
    if sum(counts.values()) <= bo.TASK_ROWS:
        sent = spark.sparkContext.broadcast(bo.rows_in_memory(rows, features, bo.quantile_edges(rows, features, BINS)))
        run = partial(_trials_in_tasks, spark, sent=sent, metric=metric, folds=folds)
    else:
        sent = None
        run = partial(_trials_in_passes, df=df, features=features, metric=metric, folds=folds, label=label, key=key, fold_col=fold_col,
                      weight_col=weight_col)
    rng = np.random.default_rng(seed)
    x, y, rounds = np.zeros((0, len(space))), np.zeros(0), np.zeros(0)
    while len(x) < n_trials:
        n = min(BATCH, n_trials - len(x))
        at = rng.random((min(FIRST, n_trials), len(space))) if not len(x) else propose(x, y, n, rng)
        specs = [replace(start, patience=PATIENCE, min_progress=MIN_PROGRESS, **decode(space, u)) for u in at]
        by = np.array(run(specs), float).reshape(len(specs), len(folds), 2).mean(axis=1)
        x = np.concatenate([x, at])
        y, rounds = np.append(y, by[:, 0]), np.append(rounds, by[:, 1])
    if sent is not None:
        sent.destroy()
    best = int(np.argmax(y))
    chosen = replace(start, **{**decode(space, x[best]), "rounds": max(1, round(rounds[best]))})
    sign = -1.0 if metric == "mse" else 1.0
    rows = [(i, sign * float(y[i]), float(rounds[i]), i == best, {k: float(v) for k, v in decode(space, x[i]).items()}) for i in range(len(x))]
    return chosen, spark.createDataFrame(rows, schema)


def search_classifier(df: DataFrame, features: Sequence[str], fold_col: str, **kwargs):
    """Boosted classifier with balanced weights, best recall of the positive class over the folds."""
    return search(df, features, CLASSIFIER_SPACE, bo.BoostSpec("logistic", weighted="weight" in df.columns, min_hess=1e-3), "recall", fold_col,
                  weight_col="weight" if "weight" in df.columns else None, **kwargs)


def search_regressor(df: DataFrame, features: Sequence[str], fold_col: str, **kwargs):
    """Boosted regressor, lowest mean squared error over the folds."""
    return search(df, features, REGRESSOR_SPACE, bo.BoostSpec("squared"), "mse", fold_col, **kwargs)


def search_boosted_regressor(df: DataFrame, features: Sequence[str], fold_col: str, **kwargs):
    """Boosted regressor, highest R2 over the folds."""
    return search(df, features, BOOSTED_REGRESSOR_SPACE, bo.BoostSpec("squared"), "r2", fold_col, **kwargs)
