"""Metrics (V1-V8) against brute force."""

import random

import numpy as np

from buyerlens.operators.metrics import (binary_metrics, classification_report, confusion_matrix,
                                         one_vs_rest, optimal_threshold, precision_recall_curve,
                                         regression_metrics)


def _f1(y, p):
    tp = int(((y == 1) & (p == 1)).sum()); fp = int(((y == 0) & (p == 1)).sum())
    fn = int(((y == 1) & (p == 0)).sum())
    return 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)


def test_threshold_search_matches_brute_force(spark):
    random.seed(11)
    rows = [(i, int(random.random() < 0.3), round(random.random(), 3) if i % 5 else random.random())
            for i in range(3000)]
    df = spark.createDataFrame(rows, "ID_BUYER long, label int, score double")
    y = np.array([r[1] for r in rows]); s = np.array([r[2] for r in rows])
    grid = np.arange(0, 1, 0.001)
    scores = [_f1(y, (s >= t).astype(int)) for t in grid]
    best = grid[int(np.argmax(scores))]
    r = optimal_threshold(df).first()
    assert r["optimal_threshold"] == best
    assert abs(r["f1"] - max(scores)) < 1e-12


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    r = binary_metrics(df).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_confusion_matrix_full_grid(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    got = {(r[0], r[1]): r[2] for r in confusion_matrix(df).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_one_vs_rest(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 3)], "target_class int, prediction_target_class int")
    got = {r["cls"]: (r["tn"], r["fp"], r["fn"], r["tp"]) for r in one_vs_rest(df).collect()}
    assert got[2] == (2, 1, 0, 1) and got[1] == (3, 0, 1, 0)


def test_classification_report_rows(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "label int, prediction int")
    classes = {r["class"] for r in classification_report(df).collect()}
    assert classes == {"0", "1", "macro avg", "weighted avg", "accuracy"}


def test_pr_curve_closing_point(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.1)], "label int, score double")
    pts = precision_recall_curve(df).collect()
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in pts}
    assert got[None] == (1.0, 0.0) and got[0.9] == (1.0, 0.5) and got[0.1] == (2 / 3, 1.0)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "label double, prediction double")
    r = regression_metrics(df).first()
    assert abs(r["MSE"] - 1 / 6) < 1e-12 and abs(r["MAE"] - 1 / 3) < 1e-12
    assert abs(r["R2"] - (1 - 0.5 / 2.0)) < 1e-12
