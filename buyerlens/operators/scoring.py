"""Composite scoring and the targeting report.

Min-max normalisation inside the scored set needs two scalars; they come
from a one-row aggregate joined by broadcast (size 1 by construction), so
the scored rows never leave their partitions.  A constant column scales to 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from buyerlens import params


def minmax_scaled(df: DataFrame, col: str, out: str | None = None,
                  lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(x - min) / (max - min) over the whole table; 0 when max == min.

    ``lo``/``hi`` apply a stored range instead of the in-batch one.
    """
    out = out or col
    if lo is None or hi is None:
        rng = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
        df = df.crossJoin(F.broadcast(rng))
        lo_c, hi_c = F.col("__lo"), F.col("__hi")
    else:
        lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    span = hi_c - lo_c
    scaled = F.when(span == 0, F.lit(0.0)).otherwise((F.col(col) - lo_c) / span)
    return df.withColumn(out, scaled).drop("__lo", "__hi")


def weighted_sum(a: str, wa: float, b: str, wb: float) -> Column:
    return F.lit(wa) * F.col(a) + F.lit(wb) * F.col(b)


def composite_score(scored: DataFrame, values: DataFrame, proba_col: str = "score",
                    value_col: str = "CLTV", key: str = "ID_BUYER",
                    weight_repeater: float = params.WEIGHT_REPEATER,
                    weight_cv: float = params.WEIGHT_CURRENT_VALUE) -> DataFrame:
    """C1 ``calculate_composite_score``: current value looked up by key (J7),
    min-max scaled inside the scored set, weighted with the repeat probability.

    Output ``(ID_BUYER, REPEATER_pred_proba, CLTV, COMPOSITE_SCORE)`` sorted by
    score descending (ties by key).
    """
    joined = (scored.select(F.col(key), F.col(proba_col).alias("REPEATER_pred_proba"))
              .join(values.select(key, F.col(value_col).alias("CLTV")), key, "inner"))
    scaled = minmax_scaled(joined, "CLTV")
    return (scaled.withColumn("COMPOSITE_SCORE",
                              weighted_sum("REPEATER_pred_proba", weight_repeater, "CLTV", weight_cv))
            .orderBy(F.desc("COMPOSITE_SCORE"), F.asc(key)))


def wa_scoring(df: DataFrame, proba_col: str = "repeater_pred_proba",
               value_pred_col: str = "cltv_pred_lgbm", key: str = "ID_BUYER",
               weight_repeater: float = params.WA_WEIGHT_REPEATER,
               weight_cltv: float = params.WA_WEIGHT_CLTV, lo=None, hi=None) -> DataFrame:
    """C2 ``WA_Scoring``: the same kernel on a *predicted* value column.

    Output ``(ID_BUYER, repeater_pred_proba, cltv_pred_lgbm, Composite_Score)``.
    """
    base = df.select(F.col(key), F.col(proba_col).alias("repeater_pred_proba"),
                     F.col(value_pred_col).alias("cltv_pred_lgbm"))
    scaled = minmax_scaled(base, "cltv_pred_lgbm", lo=lo, hi=hi)
    return (scaled.withColumn("Composite_Score",
                              weighted_sum("repeater_pred_proba", weight_repeater,
                                           "cltv_pred_lgbm", weight_cltv))
            .orderBy(F.desc("Composite_Score"), F.asc(key)))


def targeting_report(scores: DataFrame, min_score: float = params.MIN_SCORE,
                     top_k: int = params.TOP_K, score_col: str = "Composite_Score",
                     key: str = "ID_BUYER"):
    """C4: all buyers at or above ``min_score`` (P9) and the top ``k`` of them (O2).

    Returns ``(report, top)``.  ``top`` is an ``orderBy().limit(k)``, which Spark
    plans as a per-partition top-k plus a k-row merge (TakeOrderedAndProject).
    """
    report = scores.select(key, score_col).where(F.col(score_col) >= F.lit(min_score))
    top = report.orderBy(F.desc(score_col), F.asc(key)).limit(top_k)
    return report, top
