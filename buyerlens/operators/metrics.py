"""Evaluation metrics on a scored table (V1-V9).

Inputs are ``(ID_BUYER, label, score, prediction)``-style tables, so every
metric is a single aggregate over the rows (plus bounded side tables:
the class list, the 1000-point threshold grid).  Sums of fractional values
use exact decimal sums, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buyerlens import params
from buyerlens.functions.numeric import threshold_grid
from buyerlens.operators.aggregate import exact_sum
from buyerlens.operators.window import ordered_scan


def _ratio0(num, den):
    """num / den, 0 when den == 0 (sklearn's zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """V1: accuracy, precision, recall, F1 in one aggregate."""
    y, p = F.col(label), F.col(pred)
    agg = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"),
                 F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"),
                 F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(
        _ratio0(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio0(tp, tp + fp).alias("precision"),
        _ratio0(tp, tp + fn).alias("recall"),
        _ratio0(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction",
                     classes=(0, 1)) -> DataFrame:
    """V2: counts for every (actual, predicted) pair of a fixed class list,
    zero cells included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes],
                                 "actual int, predicted int")
    counts = (df.groupBy(F.col(label).cast("int").alias("actual"),
                         F.col(pred).cast("int").alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n")))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")))


def _pair_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Rows of each (label ``y``, prediction ``p``) pair; everything per class follows from it."""
    return (df.groupBy(F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))


def one_vs_rest(df: DataFrame, label: str = "target_class",
                pred: str = "prediction_target_class") -> DataFrame:
    """V3 ``multilabel_confusion_matrix``: tn, fp, fn, tp per class.

    The (label, prediction) pair counts are tiny (classes squared), so they
    are crossed with the class list (bounded by the number of classes).
    """
    return _rates(_pair_counts(df, label, pred))


def _rates(pairs: DataFrame) -> DataFrame:
    classes = pairs.select(F.explode(F.array("y", "p")).alias("cls")).distinct()
    y, p, c, n = F.col("y"), F.col("p"), F.col("cls"), F.col("n")
    return (classes.crossJoin(pairs).groupBy("cls").agg(
        F.sum(F.when((y != c) & (p != c), n).otherwise(0)).alias("tn"),
        F.sum(F.when((y != c) & (p == c), n).otherwise(0)).alias("fp"),
        F.sum(F.when((y == c) & (p != c), n).otherwise(0)).alias("fn"),
        F.sum(F.when((y == c) & (p == c), n).otherwise(0)).alias("tp")))


def classification_report(df: DataFrame, label: str = "label",
                          pred: str = "prediction") -> DataFrame:
    """V4: per-class precision, recall, F1, support plus macro / weighted
    averages and accuracy rows (``class`` column as text)."""
    pairs = _pair_counts(df, label, pred)
    ovr = _rates(pairs)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per = ovr.select(
        F.col("cls").cast("string").alias("class"),
        _ratio0(tp, tp + fp).alias("precision"),
        _ratio0(tp, tp + fn).alias("recall"),
        _ratio0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + fn).cast("long").alias("support"))
    tot = per.agg(F.sum("support").alias("n"))
    avg = per.crossJoin(tot).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.first("n")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.first("n")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.first("n")).alias("wf"),
        F.first("n").alias("n"))
    acc = pairs.agg(_ratio0(F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    macro = avg.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                       F.col("n").cast("long").alias("support"))
    weighted = avg.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"),
                          F.col("n").cast("long").alias("support"))
    accuracy = acc.crossJoin(tot).select(
        F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"),
        F.col("n").cast("long").alias("support"))
    return per.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def binary_accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(_ratio0(F.count_if(F.col(label) == F.col(pred)),
                          F.count(F.lit(1))).alias("accuracy"))


def precision_recall_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """V5: one point per distinct score (threshold), plus the closing point
    (precision 1, recall 0).

    Counts per distinct score are aggregated first, then accumulated in
    descending score order with the distributed ordered scan.
    """
    per = (df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold"))
           .agg(F.count_if(F.col(label) == 1).alias("__tp"),
                F.count_if(F.col(label) != 1).alias("__fp")))
    scan = ordered_scan(per, [("threshold", False)], sum_cols=["__tp", "__fp"],
                        pos_col="__i", cum_prefix="c")
    tot = per.agg(F.sum("__tp").alias("__P"))
    ctp, cfp = F.col("c__tp"), F.col("c__fp")
    pts = scan.crossJoin(F.broadcast(tot)).select(
        F.col("threshold"),
        _ratio0(ctp, ctp + cfp).alias("precision"),
        F.when(F.col("__P") == 0, F.lit(1.0)).otherwise(ctp / F.col("__P")).alias("recall"))
    closing = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return pts.unionByName(closing)


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """V6: MSE, RMSE, MAE, R2 (R2 = 1 - SSE/SST) with exact sums."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    n = df.agg(F.count(F.lit(1)).alias("__n"), exact_sum(y).cast("double").alias("__sy"))
    mean = F.col("__sy") / F.col("__n")
    e = y - p
    d = y - mean
    agg = df.crossJoin(F.broadcast(n)).agg(
        (exact_sum(e * e).cast("double") / F.first("__n")).alias("MSE"),
        (exact_sum(F.abs(e)).cast("double") / F.first("__n")).alias("MAE"),
        exact_sum(e * e).cast("double").alias("__sse"),
        exact_sum(d * d).cast("double").alias("__sst"))
    return agg.select(
        "MSE", F.sqrt("MSE").alias("RMSE"), "MAE",
        F.when(F.col("__sst") == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(1.0) - F.col("__sse") / F.col("__sst")).alias("R2"))


def residuals(df: DataFrame, label: str = "label", pred: str = "prediction",
              key: str = "ID_BUYER") -> tuple[DataFrame, DataFrame]:
    """V7: residual table and the fitted line of prediction on actual
    (``regr_slope`` / ``regr_intercept``)."""
    res = df.select(key, F.col(label).alias("actual"), F.col(pred).alias("predicted"),
                    (F.col(pred) - F.col(label)).alias("residual"))
    line = res.agg(F.regr_slope("predicted", "actual").alias("slope"),
                   F.regr_intercept("predicted", "actual").alias("intercept"))
    return res, line


def threshold_bucket(p, n: int = params.THRESHOLD_COUNT, step: float = params.THRESHOLD_STEP):
    """Index of the largest grid point ``i * step`` that is <= p (-1 if none).

    ``floor(p / step)`` can be off by one at grid points because of rounding,
    so it is corrected against the exact grid values ``i * step``.
    """
    k = F.floor(p / F.lit(step)).cast("long")
    k = F.when((k + 1).cast("double") * F.lit(step) <= p, k + 1).otherwise(k)
    k = F.when(k.cast("double") * F.lit(step) > p, k - 1).otherwise(k)
    return F.least(F.greatest(k, F.lit(-1)), F.lit(n - 1))


def threshold_scores(df: DataFrame, label: str = "label", score: str = "score",
                     n: int = params.THRESHOLD_COUNT,
                     step: float = params.THRESHOLD_STEP) -> DataFrame:
    """F1 (and precision/recall) for every grid threshold without an N x grid join.

    Each row lands in the bucket of the largest threshold it passes; a
    threshold's TP/FP are the suffix sums of bucket counts over the grid.
    The grid has ``n`` rows (bounded), so the suffix sums run on it directly.
    """
    spark = df.sparkSession
    b = (df.select(threshold_bucket(F.col(score), n, step).alias("t_idx"),
                   (F.col(label) == 1).alias("__pos"))
         .groupBy("t_idx").agg(F.count_if("__pos").alias("__tp"),
                               F.count_if(~F.col("__pos")).alias("__fp")))
    tot = b.agg(F.sum("__tp").alias("P"))
    grid = threshold_grid(spark, n, step)
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("t_idx")).rowsBetween(Window.unboundedPreceding, 0)
    g = (grid.join(b, "t_idx", "left")
         .select("t_idx", "threshold", F.coalesce("__tp", F.lit(0)).alias("__tp"),
                 F.coalesce("__fp", F.lit(0)).alias("__fp"))
         # n-row grid table: a single-partition window over n (<= 1000) rows
         .withColumn("tp", F.sum("__tp").over(w)).withColumn("fp", F.sum("__fp").over(w)))
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("P") - tp
    return (g.crossJoin(F.broadcast(tot)).select(
        "t_idx", "threshold", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
        fn.cast("long").alias("fn"),
        _ratio0(tp, tp + fp).alias("precision"), _ratio0(tp, F.col("P")).alias("recall"),
        _ratio0(2 * tp, 2 * tp + fp + fn).alias("f1")))


def optimal_threshold(df: DataFrame, label: str = "label", score: str = "score",
                      n: int = params.THRESHOLD_COUNT,
                      step: float = params.THRESHOLD_STEP) -> DataFrame:
    """V8 ``apply_threshold_optimization``: the F1-maximising grid threshold
    (first wins on ties, O4) and accuracy / precision / recall / F1 after
    relabelling at it.  One row."""
    grid = threshold_scores(df, label, score, n, step)
    best = grid.agg(F.max_by(F.col("threshold"), F.struct(F.col("f1"), -F.col("t_idx")))
                    .alias("optimal_threshold"))
    relabelled = relabel(df, best, score)
    m = binary_metrics(relabelled, label, "prediction_adjusted")
    return best.crossJoin(m)


def relabel(df: DataFrame, best: DataFrame, score: str = "score") -> DataFrame:
    """F10 at a threshold held in a one-row table (broadcast)."""
    return (df.crossJoin(F.broadcast(best.select("optimal_threshold")))
            .withColumn("prediction_adjusted",
                        (F.col(score) >= F.col("optimal_threshold")).cast("int"))
            .drop("optimal_threshold"))


def two_model_accuracy(df: DataFrame) -> DataFrame:
    """V9 ``accuracy_evaluation``: accuracy of the outcome model and of the
    four-class model, in one aggregate."""
    n = F.count(F.lit(1))
    return df.agg(
        _ratio0(F.count_if(F.col("REPEATER") == F.col("prediction_REPEATER")), n).alias("accuracy_etp"),
        _ratio0(F.count_if(F.col("target_class") == F.col("prediction_target_class")), n)
        .alias("accuracy_etu"))

