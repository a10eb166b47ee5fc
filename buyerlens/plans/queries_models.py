"""Registered queries: file sources/sinks (round trips), model fitting,
search, interpretation, uplift models and the batch scoring job.

Round trips (S1-S5) write part of a driver-derived table under the shared
checkpoint directory, read it back with an explicit schema and are checked
against SQL on the original.  Model queries (M, E7, L3, S6, D6) are checked
rows-only: their values come from fitted models.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from buyerlens.functions.hashing import key_fraction
from buyerlens.operators import boosting as bo
from buyerlens.operators import metrics as mx
from buyerlens.operators import models as mo
from buyerlens.operators import scoring as sc
from buyerlens.operators import search as se
from buyerlens.operators import uplift as up
from buyerlens.operators.split import mark_test
from buyerlens.plans import modeling as md
from buyerlens.plans import scored as s
from buyerlens.plans.queries_eval import WA_CTES, wa_input
from buyerlens.plans.registry import register
from buyerlens.plans.scoring_job import run_scoring_job, work_dir
from buyerlens.session import materialize
from buyerlens.sources import fixtures as fx
from buyerlens.sources import files
from buyerlens.sources import schemas

PARALLELISM = 8


# ----------------------------------------------------------------- S1-S5
@register("S1_pipe_csv_roundtrip", sql=fx.with_views(["offers"], [], "SELECT * FROM offers"))
def q_s1(spark, sf_dir):
    path = work_dir(spark, "offers-csv")
    files.write_table(fx.offers(spark, sf_dir), path, fmt="csv", sep="|")
    return files.read_pipe_csv(spark, path, schemas.OFFERS)


@register("S2_csv_roundtrip", sql=s.sql_with_model([], "SELECT * FROM d5"))
def q_s2(spark, sf_dir):
    m = s.model_table(spark, sf_dir)
    path = work_dir(spark, "model-csv")
    files.write_table(m, path, fmt="csv")
    return files.read_csv(spark, path, m.schema)


@register("S3_scores_reread", sql=s.sql_with_model(WA_CTES, "SELECT * FROM c2"))
def q_s3(spark, sf_dir):
    scores = sc.wa_scoring(wa_input(spark, sf_dir))
    path = work_dir(spark, "scores-csv")
    with_index = scores.select(F.monotonically_increasing_id().alias("_c0"), "*")
    files.write_table(with_index, path, fmt="csv")
    schema = with_index.schema
    return files.read_scores(spark, path, fmt="csv", schema=schema)


@register("S4_report_sink", sql=s.sql_with_model(
    WA_CTES, "SELECT ID_BUYER, Composite_Score FROM c2 WHERE Composite_Score >= 0.5"))
def q_s4(spark, sf_dir):
    report, _ = sc.targeting_report(sc.wa_scoring(wa_input(spark, sf_dir)))
    path = work_dir(spark, "report-csv")
    files.write_table(report, path, fmt="csv", single_file=False)
    return files.read_csv(spark, path, schemas.SCORES_REPORT)


@register("S5_prediction_store", sql=s.sql_with_model([], f"""
SELECT ID_BUYER, CLTV, {s.sql_frac('ID_BUYER', 42)} AS prediction FROM d5"""))
def q_s5(spark, sf_dir):
    m = s.model_table(spark, sf_dir)
    path = work_dir(spark, "preds")
    files.save_predictions(m.select("ID_BUYER", key_fraction("ID_BUYER", 42).alias("prediction")), path)
    preds = files.load_predictions(spark, path)
    return m.select("ID_BUYER", "CLTV").join(preds, "ID_BUYER", "inner")


# ----------------------------------------------------------------- models
def _train(spark, sf_dir, target, folds=7, stratified=True):
    m = s.model_table(spark, sf_dir)
    train, test, feats = md.training_frame(m, target, folds=folds, stratified=stratified)
    return materialize(train), materialize(test), feats


@register("M8_classifier_leaderboard")
def q_m8(spark, sf_dir):
    train, _, feats = _train(spark, sf_dir, "REPEATER")
    preds = mo.fold_predictions(train, feats, lambda n, sigma: mo.classifier_specs(n), "fold",
                                parallelism=PARALLELISM)
    return mo.classification_leaderboard(preds)


# the leaderboards' aggregate step on fixed predictions: three models, folds and scores from key hashes
_STEP_MODELS = ["first", "second", "third"]
_STEP_FOLD = s.sql_frac("ID_BUYER", "fold")
_STEP_CLASSES = " UNION ALL ".join(
    f"SELECT '{m}' AS model, CAST(floor(7 * {_STEP_FOLD}) AS INTEGER) AS fold, REPEATER AS y, "
    f"CAST({s.sql_frac('ID_BUYER', m)} >= 0.{k + 3} AS INTEGER) AS p FROM d5" for k, m in enumerate(_STEP_MODELS))
_STEP_VALUES = " UNION ALL ".join(
    f"SELECT '{m}' AS model, CAST(floor(7 * {_STEP_FOLD}) AS INTEGER) AS fold, CAST(CLTV AS DOUBLE) AS y, "
    f"CLTV * {s.sql_frac('ID_BUYER', m)} AS p FROM d5" for m in _STEP_MODELS)


def _fixed_predictions(spark, sf_dir, label, predict):
    m = s.model_table(spark, sf_dir, columns=["ID_BUYER", label])
    parts = [m.select(F.lit(name).alias("model"), F.floor(7 * key_fraction("ID_BUYER", "fold")).cast("int").alias("fold"),
                      F.col(label).alias("label"), predict(k, key_fraction("ID_BUYER", name)).alias("prediction"))
             for k, name in enumerate(_STEP_MODELS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("M8_leaderboard_step", sql=s.sql_with_model([
    ("preds", _STEP_CLASSES),
    ("counts", """SELECT model, fold, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
       count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM preds GROUP BY model, fold"""),
    ("scores", """SELECT model, fold, (tp + tn) / (tp + fp + fn + tn) AS a, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p,
       CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f FROM counts""")],
    """SELECT model AS "Model", avg(a) AS "Accuracy", avg(p) AS "Precision", stddev_pop(p) AS "Precision_Std", avg(r) AS "Recall",
       stddev_pop(r) AS "Recall_Std", avg(f) AS "F1", stddev_pop(f) AS "F1_std" FROM scores GROUP BY model"""),
    round_cols=["Accuracy", "Precision", "Precision_Std", "Recall", "Recall_Std", "F1", "F1_std"])
def q_m8_step(spark, sf_dir):
    return mo.classification_leaderboard(_fixed_predictions(
        spark, sf_dir, "REPEATER", lambda k, x: (x >= (k + 3) / 10).cast("int")))


@register("M9_leaderboard_step", sql=s.sql_with_model([
    ("preds", _STEP_VALUES),
    ("scores", """SELECT model, fold, avg(abs(y - p)) AS mae, avg((y - p) ** 2) AS mse,
       1 - sum((y - p) ** 2) / (var_pop(y) * count(y)) AS r2 FROM preds GROUP BY model, fold""")],
    """SELECT model AS "Model", avg(mae) AS "MAE", avg(mse) AS "MSE", sqrt(avg(mse)) AS "RMSE", avg(r2) AS "R2"
       FROM scores GROUP BY model"""), round_cols=["MAE", "MSE", "RMSE", "R2"], digits=2)
def q_m9_step(spark, sf_dir):
    return mo.regression_leaderboard(_fixed_predictions(
        spark, sf_dir, "CLTV", lambda k, x: F.col("CLTV").cast("double") * x))


@register("M9_regressor_leaderboard")
def q_m9(spark, sf_dir):
    train, _, feats = _train(spark, sf_dir, "CLTV", stratified=False)
    preds = mo.fold_predictions(train, feats, lambda n, sigma: mo.regressor_specs(sigma or 1.0, n), "fold",
                                parallelism=PARALLELISM)
    return mo.regression_leaderboard(preds)


@register("M10_random_search")
def q_m10(spark, sf_dir):
    train, _, feats = _train(spark, sf_dir, "REPEATER")
    _, trials = se.search_classifier(train, feats, "fold")
    return trials


@register("M11_regressor_search")
def q_m11(spark, sf_dir):
    train, _, feats = _train(spark, sf_dir, "CLTV", stratified=False)
    _, trials = se.search_regressor(train, feats, "fold")
    return trials


@register("M12_boosted_regressor_search")
def q_m12(spark, sf_dir):
    train, _, feats = _train(spark, sf_dir, "CLTV", folds=5, stratified=False)
    _, trials = se.search_boosted_regressor(train, feats, "fold")
    return trials


@register("M13_early_stopped_boosting")
def q_m13(spark, sf_dir):
    train, test, feats = _train(spark, sf_dir, "CLTV", stratified=False)
    model = mo.early_stopped_boosting(train, feats, "fold", 0, depth=3, min_rows=20)
    pred = model.predict(test).select("ID_BUYER", "label", "prediction")
    return mx.regression_metrics(pred).withColumn("rounds", F.lit(model.ensembles[0].rounds))


@register("M14_feature_importance")
def q_m14(spark, sf_dir):
    train, _, feats = _train(spark, sf_dir, "REPEATER")
    rf = RandomForestClassifier(labelCol="label", featuresCol=mo.FEATURES_COL, numTrees=100, seed=42)
    model = Pipeline(stages=[mo.assembler(feats), rf]).fit(train)
    return mo.feature_importance(model, feats, spark)


@register("M15_permutation_importance")
def q_m15(spark, sf_dir):
    train, test, feats = _train(spark, sf_dir, "REPEATER")
    rf = RandomForestClassifier(labelCol="label", featuresCol=mo.FEATURES_COL, numTrees=100, seed=42)
    model = Pipeline(stages=[mo.assembler(feats), rf]).fit(train)
    test = materialize(test)

    def accuracy(pred):
        return mx.binary_accuracy(pred, "label", "prediction")
    return mo.permutation_importance(model, test, feats, accuracy)


@register("M15_tree_attributions")
def q_m15_attributions(spark, sf_dir):
    train, test, feats = _train(spark, sf_dir, "REPEATER")
    spec = mo.boosted_specs("logistic")["LightGBM"]
    model = bo.boost(train, feats, [("LightGBM", spec, None)], weight_col="weight")
    return bo.mean_attributions(model, test)


@register("E7_recursive_elimination")
def q_e7(spark, sf_dir):
    train, _, feats = _train(spark, sf_dir, "CLTV", stratified=False)
    kept = mo.recursive_elimination(train, feats, "label", 10)
    return spark.createDataFrame([(f, f in kept) for f in feats], "column_name string, selected boolean")


@register("M1_logistic_regression")
def q_m1(spark, sf_dir):
    train, test, feats = _train(spark, sf_dir, "REPEATER")
    lr = mo.classifier_specs(train.count())["Logistic Regression"]
    model = Pipeline(stages=[mo.assembler(feats), lr]).fit(train)
    pred = model.transform(test)
    return pred.select("ID_BUYER", "label", mo.vector_to_array("probability")[1].alias("score"),
                       F.col("prediction").cast("int").alias("prediction"))


@register("M6_stored_ols", sql=s.sql_with_model([
    ("line", "SELECT regr_slope(CLTV, PRICE_SOLD_GMV) AS slope, regr_intercept(CLTV, PRICE_SOLD_GMV) AS intercept FROM d5")],
    "SELECT ID_BUYER, slope, intercept, intercept + slope * PRICE_SOLD_GMV AS prediction FROM d5 CROSS JOIN line"),
    round_cols=["slope", "intercept", "prediction"], digits=4)
def q_m6(spark, sf_dir):
    """Least squares of one feature, predicted by the model as it is read back from the store."""
    m = materialize(s.model_table(spark, sf_dir).select("ID_BUYER", "PRICE_SOLD_GMV", F.col("CLTV").cast("double").alias("label")))
    ols = mo.regressor_specs(1.0, 1)["Linear Regression"]  # without regularisation neither number counts
    model = Pipeline(stages=[mo.assembler(["PRICE_SOLD_GMV"]), ols]).fit(m)
    path = os.path.join(work_dir(spark, "model"), "ols")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    line = loaded.stages[-1]
    return loaded.transform(m).select(
        "ID_BUYER", F.lit(float(line.coefficients[0])).alias("slope"), F.lit(float(line.intercept)).alias("intercept"), "prediction")


# ----------------------------------------------------------------- L3 / V9 on fitted models
def uplift_model_predictions(spark, sf_dir, invert=False):
    """L3 ``predict``: stratified 70/30 split on treatment, an outcome model
    (boosted trees, 2 classes) and a boosted softmax model of the four classes;
    treatment is not a feature."""
    from buyerlens.operators.split import stratified_split
    m = s.model_table(spark, sf_dir)
    feats = md.features_of(m, drop_encoded=True)
    base = up.assign_treatment(m.select("ID_BUYER", "REPEATER", *feats))
    if invert:
        base = up.invert_treatment(base)
    base = up.target_class(base).fillna(-1.0, subset=feats)
    split = materialize(stratified_split(base, "treatment"))
    train, test = split.where("is_test = 0"), split.where("is_test = 1")
    spec = mo.boosted_specs("logistic")["XGBoost"]
    with ThreadPoolExecutor(2) as pool:
        outcome = pool.submit(bo.boost, train, feats, [("outcome", spec, None)], "REPEATER")
        classes = pool.submit(bo.boost, train, feats, [("classes", replace(spec, loss="softmax", classes=4), None)], "target_class")
        etp, etu = outcome.result(), classes.result()
    p1 = etp.predict(test).select(
        "ID_BUYER", "REPEATER", "target_class", "treatment",
        F.col("prediction").cast("int").alias("prediction_REPEATER"), F.col("probability")[1].alias("proba_REPEATER"))
    p2 = etu.predict(test).select(
        "ID_BUYER", F.col("prediction").cast("int").alias("prediction_target_class"),
        *[F.col("probability")[i].alias(n) for i, n in enumerate(["proba_CN", "proba_CR", "proba_TN", "proba_TR"])])
    return up.uplift_score(p1.join(p2, "ID_BUYER"))


@register("L3_uplift_models")
def q_l3(spark, sf_dir):
    return mx.two_model_accuracy(uplift_model_predictions(spark, sf_dir))


@register("L7_qini_fitted_models")
def q_l7_fitted(spark, sf_dir):
    return up.evaluation_qini(materialize(uplift_model_predictions(spark, sf_dir)))


# ----------------------------------------------------------------- S6 / D6
@register("S6_model_store_roundtrip")
def q_s6(spark, sf_dir):
    train, test, feats = _train(spark, sf_dir, "REPEATER")
    rf = RandomForestClassifier(labelCol="label", featuresCol=mo.FEATURES_COL, numTrees=100, seed=42)
    model = Pipeline(stages=[mo.assembler(feats), rf]).fit(train)
    path = os.path.join(work_dir(spark, "model"), "pipeline")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = model.transform(test).select("ID_BUYER", F.col("prediction").alias("p_fit"))
    b = loaded.transform(test).select("ID_BUYER", F.col("prediction").alias("p_loaded"))
    return a.join(b, "ID_BUYER").withColumn("same", F.col("p_fit") == F.col("p_loaded"))


@register("D6_scoring_job")
def q_d6(spark, sf_dir):
    m = mark_test(s.model_table(spark, sf_dir))
    train = materialize(m.where("is_test = 0").drop("is_test"))
    upload = m.where("is_test = 1").drop("is_test")
    _, report, top = run_scoring_job(spark, train, upload, work_dir(spark, "scoring"))
    return report
