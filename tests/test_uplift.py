"""Uplift (L2, L4, L6) against a brute-force evaluation of the definitions."""

import random

import numpy as np
import pandas as pd

from buyerlens.operators.uplift import (qini_coefficient, qini_curve, qini_from_scores,
                                        sorting_data, target_class, uplift_score)


def _brute_qini(pdf: pd.DataFrame) -> pd.DataFrame:
    """Qini by definition: percentile rank (desc, average ties) as n, rows in
    (n, key) order, cumulative class-1 / control and class-3 / treatment."""
    d = pdf.copy()
    d["n"] = d["score"].rank(pct=True, ascending=False)
    d = d.sort_values(["n", "ID_BUYER"], na_position="last").reset_index(drop=True)
    C, T = (d.target_class <= 1).sum(), (d.target_class >= 2).sum()
    d["uplift"] = (d.target_class == 3).cumsum() / T - (d.target_class == 1).cumsum() / C
    d["random"] = d["n"] * d["uplift"].iloc[-1]
    return d


def test_target_class_conventions(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 0)], "treatment int, REPEATER int")
    assert [r[0] for r in target_class(df).select("target_class").collect()] == [0, 1, 2, 3]
    assert [r[0] for r in target_class(df, "corrected").select("target_class").collect()] == [1, 0, 3, 2]


def test_uplift_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.5, 0.5)], "proba_CN double, proba_CR double, proba_TN double, proba_TR double")
    assert uplift_score(df).first()["score_etu"] is None


def test_qini_matches_brute_force(spark):
    random.seed(4)
    rows = [(i, random.randint(0, 3), float(random.randint(0, 40)) / 40) for i in range(2000)]
    pdf = pd.DataFrame(rows, columns=["ID_BUYER", "target_class", "score"])
    df = spark.createDataFrame(pdf)
    exp = _brute_qini(pdf).set_index("ID_BUYER")
    for curve in (qini_from_scores(df, "score"),
                  qini_curve(sorting_data(df, "score", "x").drop("model"))):
        got = curve.where("ID_BUYER IS NOT NULL").toPandas().set_index("ID_BUYER").sort_index()
        assert np.allclose(got["uplift"], exp.loc[got.index, "uplift"], atol=1e-12)
        assert np.allclose(got["n"], exp.loc[got.index, "n"], atol=1e-12)
        coef = qini_coefficient(curve).first()[0]
        # exact sums round each term to 1e-10 (see aggregate.exact_sum)
        assert abs(coef - (exp["uplift"].sum() - exp["random"].sum())) < 2 * len(pdf) * 0.5e-10
        assert curve.where("ID_BUYER IS NULL").first()["uplift"] == 0.0
