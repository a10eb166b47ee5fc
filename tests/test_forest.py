"""Trees and forests grown in tasks against Spark ML's."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from buyerlens.operators import forest as fo
from buyerlens.operators import models as mo

FEATS = ["a", "b", "c", "d"]


def table(spark, n=900):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        a, b, c, d = rng.randint(0, 20) / 4, float(rng.randint(0, 4)), rng.randint(0, 25) / 7, float(rng.randint(0, 1))
        y = 3 * (a > 2) + b * (d > 0) + c * (a > 4) + rng.gauss(0, 0.4)
        rows.append((i, a, b, c, d, y, float(y > 3), i % 3))
    return spark.createDataFrame(rows, "ID_BUYER long, a double, b double, c double, d double, y double, flag double, fold int").repartition(4)


def predictions(df, spec, label, fold):
    binned = fo.BinnedTable.of(df, FEATS, label, "ID_BUYER", "fold")
    got = df.select(F.xxhash64("ID_BUYER").alias("h"), "ID_BUYER").join(fo.fold_predictions(binned, spec, fold), "h")
    return {r["ID_BUYER"]: r["prediction"] for r in got.collect()}


@pytest.mark.parametrize("label,spec,estimator", [
    ("y", fo.ForestSpec(1, 5, bags=False), DecisionTreeRegressor),
    ("flag", fo.ForestSpec(1, 4, bags=False, classify=True), DecisionTreeClassifier)])
def test_tree_equals_spark(spark, monkeypatch, label, spec, estimator):
    df = table(spark)
    feats = mo.assembler(FEATS).transform(df)
    model = estimator(maxDepth=spec.depth, labelCol=label, featuresCol=mo.FEATURES_COL).fit(feats.where("fold != 1"))
    want = {r["ID_BUYER"]: r["prediction"] for r in model.transform(feats.where("fold = 1")).collect()}
    whole = predictions(df, spec, label, 1)
    monkeypatch.setattr(fo, "LOCAL_ROWS", 80)  # the upper levels in shared passes
    parts = predictions(df, spec, label, 1)
    assert set(whole) == set(parts) == set(want)
    assert np.mean([abs(whole[i] - want[i]) < 1e-6 for i in want]) > 0.97  # equal splits may fall differently
    assert np.mean([abs(parts[i] - want[i]) < 1e-6 for i in want]) > 0.97


def test_forest_is_as_good_as_spark(spark, monkeypatch):
    df = table(spark)
    feats = mo.assembler(FEATS).transform(df)
    held = df.where("fold = 0").select("ID_BUYER", "y", "flag").collect()
    for label, spec, estimator in (("y", fo.ForestSpec(40, 20, "third"), RandomForestRegressor(numTrees=40, maxDepth=20, seed=1)),
                                   ("flag", fo.ForestSpec(40, 20, "sqrt", classify=True), RandomForestClassifier(numTrees=40, maxDepth=20, seed=1))):
        model = estimator.setLabelCol(label).setFeaturesCol(mo.FEATURES_COL).fit(feats.where("fold != 0"))
        other = {r["ID_BUYER"]: r["prediction"] for r in model.transform(feats.where("fold = 0")).collect()}
        for rows in (1 << 16, 150):
            monkeypatch.setattr(fo, "LOCAL_ROWS", rows)
            got = predictions(df, spec, label, 0)
            own, theirs = (np.mean([(p[r["ID_BUYER"]] - r[label]) ** 2 for r in held]) for p in (got, other))
            assert set(got) == set(other) and own < theirs * 1.15 + 0.01


def test_no_tree_reaches_the_driver(spark, monkeypatch):
    df = table(spark)
    binned = fo.BinnedTable.of(df, FEATS, "y", "ID_BUYER", "fold")
    monkeypatch.setattr(fo, "LOCAL_ROWS", 200)
    trees, left = fo.split_large(binned, fo.ForestSpec(10, 20, "third"), 2)
    assert all(len(t.feature) < 30 and len(nodes) <= (len(t.feature) + 1) // 2 for t, nodes in zip(trees, left))
