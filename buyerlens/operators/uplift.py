"""Uplift modelling evaluation.

The Qini curve needs running counts in score order; they come from the
distributed ordered scan, so no step moves the scored table into one task.
Totals (C, T, the final uplift) are one-row aggregates joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buyerlens import params
from buyerlens.functions.hashing import key_bit
from buyerlens.functions.maps import swap_binary
from buyerlens.functions.numeric import safe_ratio_expr
from buyerlens.operators.aggregate import exact_sum
from buyerlens.operators.window import ordered_scan, pct_rank_desc, tie_rank

def assign_treatment(df: DataFrame, key: str = "ID_BUYER", seed=params.SEED,
                     out: str = "treatment") -> DataFrame:
    """L1: 50/50 treatment flag from the key hash (stable, reproducible)."""
    return df.withColumn(out, key_bit(key, f"treat{seed}"))


def invert_treatment(df: DataFrame, col: str = "treatment") -> DataFrame:
    """Swap treatment and control."""
    return df.withColumn(col, swap_binary(col))


def target_class(df: DataFrame, convention: str = "as_coded", treatment: str = "treatment",
                 outcome: str = "REPEATER", out: str = "target_class") -> DataFrame:
    """L2 ``declare_target_class``.

    ``as_coded`` reproduces the reference code: (t0,R1)->0, (t0,R0)->1,
    (t1,R1)->2, (t1,R0)->3.  ``corrected`` follows its comments: CN=0, CR=1,
    TN=2, TR=3.  Rows matching no rule keep the default 0, as in the code.
    """
    mapping = (params.UPLIFT_CLASS_AS_CODED if convention == "as_coded"
               else params.UPLIFT_CLASS_CORRECTED)
    t, r = F.col(treatment), F.col(outcome)
    expr = None
    for (tv, rv), cls in mapping.items():
        cond = (t == tv) & (r == rv)
        expr = F.when(cond, F.lit(cls)) if expr is None else expr.when(cond, F.lit(cls))
    return df.withColumn(out, expr.otherwise(F.lit(0)))


def uplift_score(df: DataFrame, out: str = "score_etu") -> DataFrame:
    """L4: uplift from four class probabilities; a zero denominator gives NULL."""
    return df.withColumn(out, safe_ratio_expr(params.UPLIFT_EXPRESSION))


def treatment_correlation(df: DataFrame, treatment: str = "treatment",
                          outcome: str = "REPEATER") -> DataFrame:
    """A15 ``correlation_treatment``: Pearson r x 100, two decimals (half-even);
    NULL when either column is constant."""
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    agg = df.agg(F.var_pop(t).alias("vt"), F.var_pop(y).alias("vy"),
                 F.covar_pop(t, y).alias("c"))
    r = F.when((F.col("vt") == 0) | (F.col("vy") == 0), F.lit(None).cast("double")) \
        .otherwise(F.col("c") / F.sqrt(F.col("vt") * F.col("vy")))
    return agg.select(F.bround(r * 100, 2).alias("corr_treatment_x100"))


def sorting_data(df: DataFrame, score: str, model: str, key: str = "ID_BUYER") -> DataFrame:
    """L5 ``sorting_data`` for one model: percentile rank of the score,
    descending with average ties (W2); rows ordered by it, key as tie-break."""
    ranked = pct_rank_desc(df.select(key, "target_class", F.col(score).alias("score")),
                           "score", out="n", key=key)
    return (ranked.withColumn("model", F.lit(model))
            .orderBy(F.asc_nulls_last("n"), F.asc(key)))


def qini_curve(df: DataFrame, key: str = "ID_BUYER", model: str | None = None) -> DataFrame:
    """L6 ``calculating_qini`` on a sorted-data table ``(key, target_class, n, score)``.

    Adds cr, tr, cr/c, tr/t, uplift, random and the origin row (n=0, uplift=0).
    Control C = rows with class <= 1, treatment T = class >= 2; ``cr`` marks
    class 1 and ``tr`` class 3, exactly as the reference counts them.
    Rows whose score is NULL have a NULL ``n`` and come last.
    """
    base = df.withColumn("cr", (F.col("target_class") == 1).cast("long")) \
             .withColumn("tr", (F.col("target_class") == 3).cast("long"))
    totals = base.agg(F.count_if(F.col("target_class") <= 1).alias("__C"),
                      F.count_if(F.col("target_class") >= 2).alias("__T"),
                      F.sum("cr").alias("__CR"), F.sum("tr").alias("__TR"))
    # Total order: n ascending (NULLs last), then key.
    base = base.withColumn("__nord", F.coalesce(F.col("n"), F.lit(float("inf"))))
    scan = ordered_scan(base, [("__nord", True), (key, True)], sum_cols=["cr", "tr"],
                        pos_col="__pos", cum_prefix="cum_")
    c, t = F.col("__C"), F.col("__T")
    curve = scan.crossJoin(F.broadcast(totals)).select(
        key, "target_class", "n", "score", "cr", "tr",
        (F.col("cum_cr") / c).alias("cr_c"), (F.col("cum_tr") / t).alias("tr_t"),
        (F.col("cum_tr") / t - F.col("cum_cr") / c).alias("uplift"),
        (F.col("n") * (F.col("__TR") / t - F.col("__CR") / c)).alias("random"))
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("long").alias(key), F.lit(None).cast("int").alias("target_class"),
        F.lit(0.0).alias("n"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("long").alias("cr"), F.lit(None).cast("long").alias("tr"),
        F.lit(None).cast("double").alias("cr_c"), F.lit(None).cast("double").alias("tr_t"),
        F.lit(0.0).alias("uplift"), F.lit(None).cast("double").alias("random"))
    out = origin.unionByName(curve)
    if model is not None:
        out = out.withColumn("model", F.lit(model))
    return out


def qini_from_scores(df: DataFrame, score: str, key: str = "ID_BUYER",
                     model: str | None = None) -> DataFrame:
    """L5 + L6 fused: Qini curve straight from a score column with one
    distributed ordered scan.

    Rows are scanned in (score descending, NULLs last, key) order, which is
    the order of the descending percentile rank with the key as tie-break;
    the scan also gives each tie's first position and size, from which the rank follows.
    """
    base = (df.select(F.col(key), F.col("target_class"), F.col(score).alias("score"))
            .withColumn("cr", (F.col("target_class") == 1).cast("long"))
            .withColumn("tr", (F.col("target_class") == 3).cast("long")))
    scan = ordered_scan(base, [("score", False), (key, True)], sum_cols=["cr", "tr"],
                        pos_col="__pos", cum_prefix="cum_", tie_cols=["score"])
    totals = scan.agg(F.count_if(F.col("target_class") <= 1).alias("__C"),
                      F.count_if(F.col("target_class") >= 2).alias("__T"),
                      F.sum("cr").alias("__CR"), F.sum("tr").alias("__TR"),
                      F.count("score").alias("__N"))
    c, t = F.col("__C"), F.col("__T")
    n = F.when(F.col("score").isNotNull(), tie_rank(F.col("__N")))
    curve = (scan.crossJoin(F.broadcast(totals))
             .withColumn("n", n)
             .select(key, "target_class", "n", "score", "cr", "tr",
                     (F.col("cum_cr") / c).alias("cr_c"), (F.col("cum_tr") / t).alias("tr_t"),
                     (F.col("cum_tr") / t - F.col("cum_cr") / c).alias("uplift"),
                     (F.col("n") * (F.col("__TR") / t - F.col("__CR") / c)).alias("random")))
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("long").alias(key), F.lit(None).cast("int").alias("target_class"),
        F.lit(0.0).alias("n"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("long").alias("cr"), F.lit(None).cast("long").alias("tr"),
        F.lit(None).cast("double").alias("cr_c"), F.lit(None).cast("double").alias("tr_t"),
        F.lit(0.0).alias("uplift"), F.lit(None).cast("double").alias("random"))
    out = origin.unionByName(curve)
    if model is not None:
        out = out.withColumn("model", F.lit(model))
    return out.orderBy(F.asc_nulls_last("n"), F.asc_nulls_first(key))


def qini_coefficient(curve: DataFrame) -> DataFrame:
    """sum(uplift) - sum(random) over the curve rows (origin excluded),
    with exact sums."""
    rows = curve.where(F.col("cr").isNotNull())
    return rows.agg((exact_sum("uplift").cast("double")
                     - F.coalesce(exact_sum("random").cast("double"), F.lit(0.0)))
                    .alias("qini_coefficient"))


def evaluation_qini(pred: DataFrame, key: str = "ID_BUYER") -> DataFrame:
    """L7 ``evaluation_qini`` / ``merging_data``: both models' curves stacked
    with a ``model`` label (ETU = uplift score, ETP = outcome probability)."""
    c = qini_from_scores(pred, "proba_REPEATER", key, "ETP")
    u = qini_from_scores(pred, "score_etu", key, "ETU")
    return u.unionByName(c).orderBy(F.asc_nulls_last("n"), "model", F.asc_nulls_first(key))
