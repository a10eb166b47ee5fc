"""Batch scoring job (C3, D6) and the model store.

The reference scores an uploaded buyer table with two stored models and two
stored encoders/scalers.  Here the fitted encoders, scalers and models are
Spark ``PipelineModel``-style artifacts written next to each other, and the
scoring job is: model table -> encode -> scale -> predict twice -> weighted
composite (C2) -> ranked scores (Parquet) -> targeting report (C4).
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from buyerlens import params
from buyerlens.operators import encode as en
from buyerlens.operators import models as mo
from buyerlens.operators import scoring as sc
from buyerlens.plans import model_table as mt
from buyerlens.session import delete_on_exit, ensure_checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory, deleted when the session ends."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "buyerlens-io", f"{name}-{uuid.uuid4().hex[:12]}")
    delete_on_exit(spark, path)
    return path


class ScoringArtifacts:
    """Fitted statistics and models for one target, saved as Parquet tables
    plus a Spark ML PipelineModel."""

    def __init__(self, path: str):
        self.path = path

    def save(self, mapping: DataFrame, prior: DataFrame, scaler: DataFrame,
             model: PipelineModel) -> None:
        mapping.write.mode("overwrite").parquet(os.path.join(self.path, "encoder_mapping"))
        prior.write.mode("overwrite").parquet(os.path.join(self.path, "encoder_prior"))
        scaler.write.mode("overwrite").parquet(os.path.join(self.path, "scaler"))
        model.write().overwrite().save(os.path.join(self.path, "model"))

    def load(self, spark: SparkSession):
        rd = spark.read.parquet
        return (rd(os.path.join(self.path, "encoder_mapping")),
                rd(os.path.join(self.path, "encoder_prior")),
                rd(os.path.join(self.path, "scaler")),
                PipelineModel.load(os.path.join(self.path, "model")))


def fit_target(model_tbl: DataFrame, target: str, path: str, max_iter: int = 100) -> list[str]:
    """Fit encoder, scaler and a boosted model for one target and save them."""
    feats = mt.feature_columns(model_tbl)
    data = model_tbl.select("ID_BUYER", F.col(target).cast("double").alias("label"), *feats)
    mapping, prior = en.fit_target_encoder(data, mt.TARGET_ENCODED, "label")
    enc = en.apply_target_encoder(data, mapping, prior, mt.TARGET_ENCODED)
    scaler = en.fit_minmax(enc, feats)
    scaled = en.apply_minmax(enc, scaler, feats).fillna(-1.0, subset=feats)
    est = (GBTClassifier(labelCol="label", featuresCol=mo.FEATURES_COL, maxIter=max_iter, seed=42)
           if target == "REPEATER" else
           GBTRegressor(labelCol="label", featuresCol=mo.FEATURES_COL, maxIter=max_iter, seed=42))
    model = Pipeline(stages=[mo.assembler(feats), est]).fit(scaled)
    ScoringArtifacts(path).save(mapping, prior, scaler, model)
    return feats


def apply_target(spark: SparkSession, df: DataFrame, path: str, feats: list[str],
                 out: str, probability: bool) -> DataFrame:
    mapping, prior, scaler, model = ScoringArtifacts(path).load(spark)
    enc = en.apply_target_encoder(df.select("ID_BUYER", *feats), mapping, prior, mt.TARGET_ENCODED)
    scaled = en.apply_minmax(enc, scaler, feats).fillna(-1.0, subset=feats)
    pred = model.transform(scaled)
    value = mo.vector_to_array(F.col("probability"))[1] if probability else F.col("prediction")
    return pred.select("ID_BUYER", value.alias(out))


def score_buyers(spark: SparkSession, upload: DataFrame, repeater_path: str, cltv_path: str,
                 feats: list[str], weight_repeater: float = params.WA_WEIGHT_REPEATER,
                 weight_cltv: float = params.WA_WEIGHT_CLTV) -> DataFrame:
    """Predict both targets for an uploaded model table and combine them
    with the weighted composite (C2), keeping ``(ID_BUYER, Composite_Score)``."""
    p = apply_target(spark, upload, repeater_path, feats, "repeater_pred_proba", True)
    v = apply_target(spark, upload, cltv_path, feats, "cltv_pred_lgbm", False)
    wa = sc.wa_scoring(p.join(v, "ID_BUYER"), weight_repeater=weight_repeater,
                       weight_cltv=weight_cltv)
    return wa.select("ID_BUYER", "Composite_Score")


def run_scoring_job(spark: SparkSession, train_tbl: DataFrame, upload: DataFrame, out_dir: str,
                    min_score: float = params.MIN_SCORE, top_k: int = params.TOP_K):
    """Fit + save artifacts, score the upload, write scores and report.

    Returns ``(scores, report, top)`` read back from ``out_dir``.
    """
    rep_path, cltv_path = os.path.join(out_dir, "repeater"), os.path.join(out_dir, "cltv")
    feats = fit_target(train_tbl, "REPEATER", rep_path)
    fit_target(train_tbl, "CLTV", cltv_path)
    scores = score_buyers(spark, upload, rep_path, cltv_path, feats)
    scores.write.mode("overwrite").parquet(os.path.join(out_dir, "scores"))
    scores = spark.read.parquet(os.path.join(out_dir, "scores"))
    report, top = sc.targeting_report(scores, min_score, top_k)
    report.write.mode("overwrite").parquet(os.path.join(out_dir, "final_report"))
    return scores, spark.read.parquet(os.path.join(out_dir, "final_report")), top
