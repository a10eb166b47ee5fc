"""Registered queries: model table, composite scoring, metrics, uplift."""

from __future__ import annotations

from pyspark.sql import functions as F

from buyerlens.functions.hashing import key_fraction
from buyerlens.operators import metrics as mx
from buyerlens.operators import scoring as sc
from buyerlens.operators import uplift as up
from buyerlens.operators.split import mark_test
from buyerlens.operators.window import running_sum
from buyerlens.plans import scored as s
from buyerlens.plans.registry import register

frac = s.sql_frac


def r0(num: str, den: str) -> str:
    """SQL twin of ``metrics._ratio0``."""
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def xsum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(38,10))) AS DOUBLE)"


# --------------------------------------------------------------------- D5
@register("D5_model_table", sql=s.sql_with_model([], "SELECT * FROM d5"))
def q_d5(spark, sf_dir):
    return s.model_table(spark, sf_dir, materialized=False)


# --------------------------------------------------------------------- C
C1_CTES = [
    ("c1_test", f"""SELECT ID_BUYER, {frac('ID_BUYER', 42)} AS score FROM d5
WHERE {frac('ID_BUYER', 'split42')} < 0.2"""),
    ("c1_j", """SELECT t.ID_BUYER, t.score AS REPEATER_pred_proba, d.CLTV AS CLTV
FROM c1_test t JOIN d5 d ON t.ID_BUYER = d.ID_BUYER"""),
    ("c1", """SELECT ID_BUYER, REPEATER_pred_proba, cl AS CLTV,
       0.8 * REPEATER_pred_proba + 0.2 * cl AS COMPOSITE_SCORE
FROM (SELECT ID_BUYER, REPEATER_pred_proba,
             CASE WHEN mx - mn = 0 THEN 0.0 ELSE (CLTV - mn) / (mx - mn) END AS cl
      FROM c1_j CROSS JOIN (SELECT min(CLTV) AS mn, max(CLTV) AS mx FROM c1_j) r)"""),
]


@register("C1_composite_score", sql=s.sql_with_model(C1_CTES, "SELECT * FROM c1"))
def q_c1(spark, sf_dir):
    m = s.model_table(spark, sf_dir)
    test = mark_test(m).where(F.col("is_test") == 1).withColumn("score", key_fraction("ID_BUYER", 42))
    return sc.composite_score(test, m, "score", "CLTV", weight_repeater=0.8, weight_cv=0.2)


def wa_input(spark, sf_dir):
    m = s.model_table(spark, sf_dir)
    return m.select("ID_BUYER", key_fraction("ID_BUYER", 42).alias("repeater_pred_proba"),
                    (F.col("CLTV") * (F.lit(0.5) + key_fraction("ID_BUYER", "cltv42")))
                    .alias("cltv_pred_lgbm"))


WA_CTES = [
    ("wa_in", f"""SELECT ID_BUYER, {frac('ID_BUYER', 42)} AS repeater_pred_proba,
       CLTV * (0.5 + {frac('ID_BUYER', 'cltv42')}) AS cltv_pred_lgbm FROM d5"""),
    ("c2", """SELECT ID_BUYER, repeater_pred_proba, cl AS cltv_pred_lgbm,
       0.8 * repeater_pred_proba + 0.2 * cl AS Composite_Score
FROM (SELECT ID_BUYER, repeater_pred_proba,
             CASE WHEN mx - mn = 0 THEN 0.0 ELSE (cltv_pred_lgbm - mn) / (mx - mn) END AS cl
      FROM wa_in CROSS JOIN (SELECT min(cltv_pred_lgbm) AS mn, max(cltv_pred_lgbm) AS mx FROM wa_in) r)"""),
]


@register("C2_weighted_scoring", sql=s.sql_with_model(WA_CTES, "SELECT * FROM c2"))
def q_c2(spark, sf_dir):
    return sc.wa_scoring(wa_input(spark, sf_dir))


@register("C4_targeting_report",
          sql=s.sql_with_model(WA_CTES, "SELECT ID_BUYER, Composite_Score FROM c2 WHERE Composite_Score >= 0.5"))
def q_c4(spark, sf_dir):
    report, _ = sc.targeting_report(sc.wa_scoring(wa_input(spark, sf_dir)), 0.5, 10)
    return report


@register("O2_top10_report",
          sql=s.sql_with_model(WA_CTES, """SELECT ID_BUYER, Composite_Score FROM c2
WHERE Composite_Score >= 0.5 ORDER BY Composite_Score DESC, ID_BUYER LIMIT 10"""))
def q_o2(spark, sf_dir):
    _, top = sc.targeting_report(sc.wa_scoring(wa_input(spark, sf_dir)), 0.5, 10)
    return top


# --------------------------------------------------------------------- V
V1_SQL = s.sql_with_model([s.SCORED_CTE], f"""SELECT {r0('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
       {r0('tp', 'tp + fp')} AS precision, {r0('tp', 'tp + fn')} AS recall,
       {r0('2 * tp', '2 * tp + fp + fn')} AS f1
FROM (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
             count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM scored) c""")


@register("V1_binary_metrics", sql=V1_SQL)
def q_v1(spark, sf_dir):
    return mx.binary_metrics(s.scored_binary(spark, sf_dir))


@register("V2_confusion_matrix", sql=s.sql_with_model([s.SCORED_CTE], """
SELECT g.actual, g.predicted, COALESCE(c.n, 0) AS n
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(actual, predicted)) g
LEFT JOIN (SELECT CAST(label AS INTEGER) AS actual, CAST(prediction AS INTEGER) AS predicted,
                  count(*) AS n FROM scored GROUP BY 1, 2) c
  ON g.actual = c.actual AND g.predicted = c.predicted"""))
def q_v2(spark, sf_dir):
    return mx.confusion_matrix(s.scored_binary(spark, sf_dir))


OVR_SQL_BODY = """SELECT k.cls,
  CAST(SUM(CASE WHEN y <> k.cls AND p <> k.cls THEN n ELSE 0 END) AS BIGINT) AS tn,
  CAST(SUM(CASE WHEN y <> k.cls AND p = k.cls THEN n ELSE 0 END) AS BIGINT) AS fp,
  CAST(SUM(CASE WHEN y = k.cls AND p <> k.cls THEN n ELSE 0 END) AS BIGINT) AS fn,
  CAST(SUM(CASE WHEN y = k.cls AND p = k.cls THEN n ELSE 0 END) AS BIGINT) AS tp
FROM (SELECT DISTINCT cls FROM (SELECT CAST({y} AS INTEGER) AS cls FROM {t}
      UNION ALL SELECT CAST({p} AS INTEGER) FROM {t})) k
CROSS JOIN (SELECT CAST({y} AS INTEGER) AS y, CAST({p} AS INTEGER) AS p, count(*) AS n
            FROM {t} GROUP BY 1, 2) pr
GROUP BY k.cls"""


@register("V3_one_vs_rest", sql=s.sql_with_model(
    s.uplift_ctes(), OVR_SQL_BODY.format(y="target_class", p="prediction_target_class", t="upred")))
def q_v3(spark, sf_dir):
    return mx.one_vs_rest(s.uplift_predictions(spark, sf_dir))


V4_CTES = [s.SCORED_CTE,
           ("ovr", OVR_SQL_BODY.format(y="label", p="prediction", t="scored")),
           ("per", f"""SELECT CAST(cls AS VARCHAR) AS class, {r0('tp', 'tp + fp')} AS precision,
       {r0('tp', 'tp + fn')} AS recall, {r0('2 * tp', '2 * tp + fp + fn')} AS f1,
       CAST(tp + fn AS BIGINT) AS support FROM ovr"""),
           ("tot", "SELECT SUM(support) AS n FROM per")]


@register("V4_classification_report", sql=s.sql_with_model(V4_CTES, f"""
SELECT * FROM per
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(max(n) AS BIGINT) FROM per, tot
UNION ALL SELECT 'weighted avg', SUM(precision * support) / max(n), SUM(recall * support) / max(n),
                 SUM(f1 * support) / max(n), CAST(max(n) AS BIGINT) FROM per, tot
UNION ALL SELECT 'accuracy', NULL, NULL,
                 (SELECT {r0('count(*) FILTER (WHERE label = prediction)', 'count(*)')} FROM scored),
                 CAST(n AS BIGINT) FROM tot"""), round_cols=["precision", "recall", "f1"], digits=9)
def q_v4(spark, sf_dir):
    return mx.classification_report(s.scored_binary(spark, sf_dir))


@register("V5_precision_recall_curve", sql=s.sql_with_model([s.SCORED_CTE], f"""
SELECT threshold, {r0('ctp', 'ctp + cfp')} AS precision,
       CASE WHEN P = 0 THEN 1.0 ELSE CAST(ctp AS DOUBLE) / P END AS recall
FROM (SELECT threshold,
             SUM(tp) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS ctp,
             SUM(fp) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cfp,
             SUM(tp) OVER () AS P
      FROM (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS tp,
                   count(*) FILTER (WHERE label <> 1) AS fp
            FROM scored WHERE score IS NOT NULL GROUP BY score) g) c
UNION ALL SELECT NULL, 1.0, 0.0"""))
def q_v5(spark, sf_dir):
    return mx.precision_recall_curve(s.scored_binary(spark, sf_dir))


REG_CTE = ("reg", f"""SELECT ID_BUYER, CLTV AS label, CLTV * (0.5 + {frac('ID_BUYER', 'cltv42')}) AS prediction
FROM d5""")


def reg_input(spark, sf_dir):
    m = s.model_table(spark, sf_dir)
    return m.select("ID_BUYER", F.col("CLTV").alias("label"),
                    (F.col("CLTV") * (F.lit(0.5) + key_fraction("ID_BUYER", "cltv42"))).alias("prediction"))


@register("V6_regression_metrics", sql=s.sql_with_model([REG_CTE], f"""
SELECT MSE, sqrt(MSE) AS RMSE, MAE, CASE WHEN sst = 0 THEN NULL ELSE 1.0 - sse / sst END AS R2
FROM (SELECT {xsum('(label - prediction) * (label - prediction)')} / count(*) AS MSE,
             {xsum('abs(label - prediction)')} / count(*) AS MAE,
             {xsum('(label - prediction) * (label - prediction)')} AS sse,
             {xsum('(label - m) * (label - m)')} AS sst
      FROM reg CROSS JOIN (SELECT {xsum('label')} / count(*) AS m FROM reg) mm) a"""))
def q_v6(spark, sf_dir):
    return mx.regression_metrics(reg_input(spark, sf_dir))


@register("V7_residuals", sql=s.sql_with_model([REG_CTE], """
SELECT ID_BUYER, label AS actual, prediction AS predicted, prediction - label AS residual FROM reg"""))
def q_v7(spark, sf_dir):
    res, _ = mx.residuals(reg_input(spark, sf_dir))
    return res


@register("V7_fit_line", sql=s.sql_with_model([REG_CTE], """
SELECT regr_slope(prediction, label) AS slope, regr_intercept(prediction, label) AS intercept FROM reg"""),
          round_cols=["slope", "intercept"], digits=6)
def q_v7_line(spark, sf_dir):
    _, line = mx.residuals(reg_input(spark, sf_dir))
    return line


def _bucket_sql(p: str) -> str:
    k0 = f"CAST(floor({p} / 0.001) AS BIGINT)"
    k1 = f"(CASE WHEN CAST({k0} + 1 AS DOUBLE) * 0.001 <= {p} THEN {k0} + 1 ELSE {k0} END)"
    k2 = f"(CASE WHEN CAST({k1} AS DOUBLE) * 0.001 > {p} THEN {k1} - 1 ELSE {k1} END)"
    return f"least(greatest({k2}, -1), 999)"


V8_CTES = [s.SCORED_CTE,
           ("b", f"""SELECT {_bucket_sql('score')} AS t_idx, count(*) FILTER (WHERE label = 1) AS btp,
       count(*) FILTER (WHERE label <> 1) AS bfp FROM scored GROUP BY 1"""),
           ("g", """SELECT i AS t_idx, CAST(i AS DOUBLE) * 0.001 AS threshold,
       SUM(COALESCE(btp, 0)) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS tp,
       SUM(COALESCE(bfp, 0)) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS fp
FROM range(1000) r(i) LEFT JOIN b ON r.i = b.t_idx"""),
           ("gf", f"""SELECT t_idx, threshold, {r0('2 * tp', '2 * tp + fp + (P - tp)')} AS f1
FROM g CROSS JOIN (SELECT SUM(btp) AS P FROM b) pp"""),
           ("best", """SELECT threshold AS optimal_threshold FROM gf ORDER BY f1 DESC, t_idx ASC LIMIT 1"""),
           ("relab", """SELECT s.*, CAST(s.score >= best.optimal_threshold AS INTEGER) AS prediction_adjusted
FROM scored s CROSS JOIN best""")]


@register("V8_threshold_optimization", sql=s.sql_with_model(V8_CTES, f"""
SELECT optimal_threshold, {r0('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
       {r0('tp', 'tp + fp')} AS precision, {r0('tp', 'tp + fn')} AS recall,
       {r0('2 * tp', '2 * tp + fp + fn')} AS f1
FROM best CROSS JOIN (
  SELECT count(*) FILTER (WHERE label = 1 AND prediction_adjusted = 1) AS tp,
         count(*) FILTER (WHERE label = 0 AND prediction_adjusted = 1) AS fp,
         count(*) FILTER (WHERE label = 1 AND prediction_adjusted = 0) AS fn,
         count(*) FILTER (WHERE label = 0 AND prediction_adjusted = 0) AS tn FROM relab) c"""))
def q_v8(spark, sf_dir):
    return mx.optimal_threshold(s.scored_binary(spark, sf_dir))


@register("V8_relabel", sql=s.sql_with_model(V8_CTES, "SELECT * FROM relab"))
def q_v8_relabel(spark, sf_dir):
    sb = s.scored_binary(spark, sf_dir)
    grid = mx.threshold_scores(sb)
    best = grid.agg(F.max_by(F.col("threshold"), F.struct(F.col("f1"), -F.col("t_idx")))
                    .alias("optimal_threshold"))
    return mx.relabel(sb, best)


@register("V8_threshold_grid", sql=s.sql_with_model(V8_CTES, "SELECT t_idx, threshold, f1 FROM gf"))
def q_v8_grid(spark, sf_dir):
    return mx.threshold_scores(s.scored_binary(spark, sf_dir)).select("t_idx", "threshold", "f1")


@register("V9_model_accuracy", sql=s.sql_with_model(s.uplift_ctes(), f"""
SELECT {r0('count(*) FILTER (WHERE REPEATER = prediction_REPEATER)', 'count(*)')} AS accuracy_etp,
       {r0('count(*) FILTER (WHERE target_class = prediction_target_class)', 'count(*)')} AS accuracy_etu
FROM upred"""))
def q_v9(spark, sf_dir):
    return mx.two_model_accuracy(s.uplift_predictions(spark, sf_dir))


# --------------------------------------------------------------------- L
@register("L1_treatment_counts", sql=s.sql_with_model(
    s.uplift_ctes(), "SELECT treatment, count(*) AS count FROM upred GROUP BY treatment"))
def q_l1(spark, sf_dir):
    from buyerlens.operators.aggregate import value_counts
    return value_counts(s.uplift_predictions(spark, sf_dir), "treatment")


@register("L2_target_class", sql=s.sql_with_model(
    s.uplift_ctes(), "SELECT ID_BUYER, treatment, REPEATER, target_class FROM upred"))
def q_l2(spark, sf_dir):
    return s.uplift_predictions(spark, sf_dir).select("ID_BUYER", "treatment", "REPEATER", "target_class")


@register("L2_target_class_corrected", sql=s.sql_with_model(
    s.uplift_ctes(convention="corrected"),
    "SELECT ID_BUYER, treatment, REPEATER, target_class FROM upred"))
def q_l2c(spark, sf_dir):
    return (s.uplift_predictions(spark, sf_dir, convention="corrected")
            .select("ID_BUYER", "treatment", "REPEATER", "target_class"))


@register("L4_uplift_score", sql=s.sql_with_model(s.uplift_ctes(), """
SELECT ID_BUYER, proba_CN, proba_CR, proba_TN, proba_TR, proba_REPEATER, prediction_REPEATER,
       prediction_target_class, score_etu FROM upred"""))
def q_l4(spark, sf_dir):
    return s.uplift_predictions(spark, sf_dir).select(
        "ID_BUYER", "proba_CN", "proba_CR", "proba_TN", "proba_TR", "proba_REPEATER",
        "prediction_REPEATER", "prediction_target_class", "score_etu")


def _l5_sql(score: str, model: str) -> str:
    return f"""SELECT ID_BUYER, target_class, {score} AS score,
  CASE WHEN {score} IS NULL THEN NULL ELSE
   ((CAST(count(*) OVER (ORDER BY {score} DESC NULLS LAST RANGE UNBOUNDED PRECEDING) AS DOUBLE)
     - count(*) OVER (PARTITION BY {score})) + (count(*) OVER (PARTITION BY {score}) + 1) / 2.0)
   / count({score}) OVER () END AS n, '{model}' AS model
FROM upred"""


@register("L5_sorting_data", sql=s.sql_with_model(
    s.uplift_ctes() + [("l5", _l5_sql("score_etu", "ETU"))], "SELECT * FROM l5"))
def q_l5(spark, sf_dir):
    return up.sorting_data(s.uplift_predictions(spark, sf_dir), "score_etu", "ETU")


def _l6_ctes(src: str, out: str, model: str | None = None):
    mcol = f", '{model}' AS model" if model else ""
    mnull = f", '{model}' AS model" if model else ""
    return [
        (f"{out}_b", f"""SELECT ID_BUYER, target_class, n, score,
       CAST(target_class = 1 AS BIGINT) AS cr, CAST(target_class = 3 AS BIGINT) AS tr FROM {src}"""),
        (f"{out}_t", f"""SELECT count(*) FILTER (WHERE target_class <= 1) AS tot_c,
       count(*) FILTER (WHERE target_class >= 2) AS tot_t, SUM(cr) AS tot_cr, SUM(tr) AS tot_tr
FROM {out}_b"""),
        (out, f"""SELECT NULL::BIGINT AS ID_BUYER, NULL::INTEGER AS target_class, 0.0 AS n, NULL::DOUBLE AS score,
       NULL::BIGINT AS cr, NULL::BIGINT AS tr, NULL::DOUBLE AS cr_c, NULL::DOUBLE AS tr_t,
       0.0 AS uplift, NULL::DOUBLE AS random{mnull}
UNION ALL
SELECT ID_BUYER, target_class, n, score, cr, tr, ccr / tot_c AS cr_c, ctr / tot_t AS tr_t,
       ctr / tot_t - ccr / tot_c AS uplift,
       n * (CAST(tot_tr AS DOUBLE) / tot_t - CAST(tot_cr AS DOUBLE) / tot_c) AS random{mcol}
FROM (SELECT *, CAST(SUM(cr) OVER w AS DOUBLE) AS ccr, CAST(SUM(tr) OVER w AS DOUBLE) AS ctr
      FROM {out}_b WINDOW w AS (ORDER BY n ASC NULLS LAST, ID_BUYER ROWS UNBOUNDED PRECEDING)) x
CROSS JOIN {out}_t"""),
    ]


L6_CTES = s.uplift_ctes() + [("l5", _l5_sql("score_etu", "ETU"))] + _l6_ctes("l5", "l6")


def _l6_spark(spark, sf_dir, invert=False, score="score_etu"):
    pred = s.uplift_predictions(spark, sf_dir, invert=invert)
    return up.qini_from_scores(pred, score)


@register("L6_qini_curve", sql=s.sql_with_model(L6_CTES, "SELECT * FROM l6"))
def q_l6(spark, sf_dir):
    return _l6_spark(spark, sf_dir)


def _qini_coef_sql(curve: str) -> str:
    return (f"SELECT {xsum('uplift')} - COALESCE({xsum('random')}, 0.0) AS qini_coefficient "
            f"FROM {curve} WHERE cr IS NOT NULL")


@register("L6_qini_coefficient", sql=s.sql_with_model(L6_CTES, _qini_coef_sql("l6")))
def q_l6_coef(spark, sf_dir):
    return up.qini_coefficient(_l6_spark(spark, sf_dir))


L7_CTES = (s.uplift_ctes() + [("l5u", _l5_sql("score_etu", "ETU")),
                              ("l5c", _l5_sql("proba_REPEATER", "ETP"))]
           + _l6_ctes("l5u", "qu", "ETU") + _l6_ctes("l5c", "qc", "ETP"))


@register("L7_qini_both_models", sql=s.sql_with_model(
    L7_CTES, "SELECT * FROM qu UNION ALL SELECT * FROM qc"))
def q_l7(spark, sf_dir):
    return up.evaluation_qini(s.uplift_predictions(spark, sf_dir))


L8_CTES = (s.uplift_ctes(invert=True) + [("l5u", _l5_sql("score_etu", "ETU")),
                                         ("l5c", _l5_sql("proba_REPEATER", "ETP"))]
           + _l6_ctes("l5u", "qu", "ETU") + _l6_ctes("l5c", "qc", "ETP"))


@register("L8_inverted_qini", sql=s.sql_with_model(L8_CTES, f"""
SELECT 'ETU' AS model, ({_qini_coef_sql('qu')}) AS qini_coefficient
UNION ALL SELECT 'ETP', ({_qini_coef_sql('qc')})"""))
def q_l8(spark, sf_dir):
    pred = s.uplift_predictions(spark, sf_dir, invert=True)
    out = None
    for model, score in (("ETU", "score_etu"), ("ETP", "proba_REPEATER")):
        curve = up.qini_from_scores(pred, score)
        row = up.qini_coefficient(curve).select(F.lit(model).alias("model"), "qini_coefficient")
        out = row if out is None else out.unionByName(row)
    return out


@register("A15_treatment_correlation", sql=s.sql_with_model(s.uplift_ctes(), """
SELECT round_even(CASE WHEN var_pop(treatment) = 0 OR var_pop(REPEATER) = 0 THEN NULL
  ELSE covar_pop(treatment, REPEATER) / sqrt(var_pop(treatment) * var_pop(REPEATER)) END * 100, 2)
  AS corr_treatment_x100 FROM upred"""))
def q_a15(spark, sf_dir):
    return up.treatment_correlation(s.uplift_predictions(spark, sf_dir))


@register("L8_inverted_correlation", sql=s.sql_with_model(s.uplift_ctes(invert=True), """
SELECT round_even(CASE WHEN var_pop(treatment) = 0 OR var_pop(REPEATER) = 0 THEN NULL
  ELSE covar_pop(treatment, REPEATER) / sqrt(var_pop(treatment) * var_pop(REPEATER)) END * 100, 2)
  AS corr_treatment_x100 FROM upred"""))
def q_l8_corr(spark, sf_dir):
    return up.treatment_correlation(s.uplift_predictions(spark, sf_dir, invert=True))


# --------------------------------------------------------------------- W3
@register("W3_running_value", sql=s.sql_with_model([s.SCORED_CTE], """
SELECT s.ID_BUYER, s.score, d.CLTV,
       SUM(CAST(d.CLTV AS DECIMAL(38,10))) OVER (ORDER BY s.score DESC, s.ID_BUYER ROWS UNBOUNDED PRECEDING) AS cum_CLTV
FROM scored s JOIN d5 d ON s.ID_BUYER = d.ID_BUYER"""), round_cols=["cum_CLTV"], digits=2)
def q_w3(spark, sf_dir):
    m = s.model_table(spark, sf_dir, columns=["ID_BUYER", "REPEATER", "CLTV"])
    sb = s.scored_binary(spark, sf_dir, m).select("ID_BUYER", "score")
    return running_sum(sb.join(m.select("ID_BUYER", "CLTV"), "ID_BUYER"), [("score", False), ("ID_BUYER", True)],
                       ["CLTV"]).drop("_pos")
