"""Model store round trip, leaderboard mechanics and the streaming scorer."""

import os
import tempfile

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from buyerlens.operators import models as mo
from buyerlens.plans import modeling as md
from buyerlens.plans import scored as s
from buyerlens.plans.scoring_job import fit_target
from buyerlens.streaming import start_scoring_stream


def test_leaderboard_and_store(spark, sf001):
    m = s.model_table(spark, sf001)
    train, test, feats = md.training_frame(m, "REPEATER", folds=3)
    models = {"lr": LogisticRegression(labelCol="label", featuresCol=mo.FEATURES_COL, maxIter=20)}
    preds = mo.fold_predictions(train, feats, lambda n, sigma: models, "fold", parallelism=2)
    board = mo.classification_leaderboard(preds).collect()
    assert len(board) == 1 and 0.0 <= board[0]["F1"] <= 1.0
    model = Pipeline(stages=[mo.assembler(feats), models["lr"]]).fit(train)
    path = os.path.join(tempfile.mkdtemp(), "m")
    model.write().overwrite().save(path)
    a = model.transform(test).select("ID_BUYER", "prediction").collect()
    b = PipelineModel.load(path).transform(test).select("ID_BUYER", "prediction").collect()
    assert sorted(a) == sorted(b)


def test_streaming_scoring(spark, sf001):
    m = s.model_table(spark, sf001)
    root = tempfile.mkdtemp()
    feats = fit_target(m, "REPEATER", os.path.join(root, "rep"), max_iter=3)
    fit_target(m, "CLTV", os.path.join(root, "cltv"), max_iter=3)
    inbox = os.path.join(root, "inbox")
    m.limit(60).write.parquet(os.path.join(inbox, "upload1"))
    q = start_scoring_stream(spark, os.path.join(inbox, "upload1"), m.schema,
                             os.path.join(root, "rep"), os.path.join(root, "cltv"), feats,
                             os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(root, "out"))
    assert out.count() == 60
    assert out.agg(F.max("Composite_Score")).first()[0] <= 1.0 + 1e-9


def test_streaming_scoring_csv_upload(spark, sf001):
    from buyerlens.sources import files
    m = s.model_table(spark, sf001)
    root = tempfile.mkdtemp()
    feats = fit_target(m, "REPEATER", os.path.join(root, "rep"), max_iter=3)
    fit_target(m, "CLTV", os.path.join(root, "cltv"), max_iter=3)
    inbox = os.path.join(root, "inbox")
    files.write_table(m.limit(40), inbox, fmt="csv")
    q = start_scoring_stream(spark, inbox, m.schema, os.path.join(root, "rep"),
                             os.path.join(root, "cltv"), feats, os.path.join(root, "out"),
                             os.path.join(root, "ckpt"), value_range=(0.0, 1e6),
                             file_format="csv")
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(root, "out")).count() == 40
