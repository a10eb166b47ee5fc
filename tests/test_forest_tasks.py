"""Whole trees in one task each against trees whose upper levels are grown in shared passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from buyerlens.operators import boosting as bo
from buyerlens.operators import forest as fo

FEATS = ["a", "b", "c"]


def table(spark, n=900):
    u = lambda seed: F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1000)) / 1000
    y = F.when(u(1) > 0.5, 3.0).otherwise(0.0) + F.floor(5 * u(2)) * u(3) + u(4)
    return spark.range(0, n, 1, 4).select(
        F.col("id").alias("ID_BUYER"), u(1).alias("a"), F.floor(5 * u(2)).cast("double").alias("b"), u(3).alias("c"),
        F.when(F.col("id") % 40 > 0, y).alias("y"), (F.col("id") % 3).cast("int").alias("fold")).withColumn("flag", (F.col("y") > 3).cast("double"))


@pytest.mark.parametrize("spec,label,near", [
    (fo.ForestSpec(1, 6, bags=False), "y", 1e-9), (fo.ForestSpec(1, 6, bags=False, classify=True), "flag", 1e-9),
    (fo.ForestSpec(60, 8, "third"), "y", 0.35)])
def test_whole_trees_in_tasks(spark, monkeypatch, spec, label, near):
    df, found, passes, real = table(spark), [], [], bo.best_of_pass
    monkeypatch.setattr(bo, "best_of_pass", lambda *args: passes.append(args) or real(*args))
    for bound in (1 << 20, 0):
        monkeypatch.setattr(bo, "TASK_ROWS", bound)
        monkeypatch.setattr(fo, "LOCAL_ROWS", 100)
        rows = fo.fold_predictions(fo.BinnedTable.of(df, FEATS, label, "ID_BUYER", "fold"), spec, 1).collect()
        found.append({r["h"]: r["prediction"] for r in rows})
        assert bool(passes) == (bound == 0)
    assert len(found[0]) == 300 and set(found[0]) == set(found[1])
    difference = np.array([abs(found[0][h] - found[1][h]) for h in found[0]])
    assert np.mean(difference < near) > 0.97  # equal splits may fall differently


def test_tables_without_fitted_or_left_out_rows(spark, monkeypatch):
    monkeypatch.setattr(fo, "LOCAL_ROWS", 10)
    df = table(spark, 60)
    for rows, n in ((df.where("fold = 1"), 20), (df.where("fold <> 1"), 0)):
        got = fo.fold_predictions(fo.BinnedTable.of(rows, FEATS, "y", "ID_BUYER", "fold"), fo.ForestSpec(3, 4), 1).collect()
        assert len(got) == n and all(r["prediction"] == 0 for r in got)
