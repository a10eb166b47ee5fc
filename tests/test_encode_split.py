"""Encoders (E1-E6) and splits."""

import math

from pyspark.sql import functions as F

from buyerlens.operators.encode import (apply_target_encoder, fit_minmax, apply_minmax,
                                        fit_target_encoder, scale, univariate_selection,
                                        variance_threshold)
from buyerlens.operators.split import (class_weights, kfold, mark_test, stratified_kfold,
                                       stratified_split)


def test_target_encoding_formula_unseen_and_single(spark):
    rows = [("a", 1.0)] * 30 + [("a", 0.0)] * 10 + [("b", 1.0)]
    train = spark.createDataFrame(rows, "c string, y double")
    mapping, prior = fit_target_encoder(train, ["c"], "y")
    p = 31 / 41
    w = 1 / (1 + math.exp(-(40 - 20) / 10))
    got = {r["category"]: r["encoded"] for r in mapping.collect()}
    assert abs(got["a"] - (p * (1 - w) + 0.75 * w)) < 1e-12
    assert abs(got["b"] - p) < 1e-12                      # seen once -> prior
    test = spark.createDataFrame([("zzz",), (None,)], "c string")
    enc = [r["c"] for r in apply_target_encoder(test, mapping, prior, ["c"]).collect()]
    assert all(abs(v - p) < 1e-12 for v in enc)           # unseen / NULL -> prior


def test_encoder_ignores_validation_labels(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 0.0)], "c string, y double")
    m1, p1 = fit_target_encoder(train, ["c"], "y")
    test_a = spark.createDataFrame([("a", 1.0)], "c string, y double")
    test_b = spark.createDataFrame([("a", 0.0)], "c string, y double")
    e1 = apply_target_encoder(test_a, m1, p1, ["c"]).first()["c"]
    e2 = apply_target_encoder(test_b, m1, p1, ["c"]).first()["c"]
    assert e1 == e2


def test_minmax_constant_and_invalid_scaler(spark):
    train = spark.createDataFrame([(1.0, 0.0), (1.0, 10.0)], "a double, b double")
    test = spark.createDataFrame([(3.0, 5.0)], "a double, b double")
    out = apply_minmax(test, fit_minmax(train, ["a", "b"]), ["a", "b"]).first()
    assert (out["a"], out["b"]) == (2.0, 0.5)
    try:
        scale(train, test, ["a"], "Robust")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_variance_and_univariate(spark):
    rows = [(float(i), 1.0, float(i % 3), 2.0 * i + 1) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, const double, z double, y double")
    v = {r["column_name"]: r["kept"] for r in variance_threshold(df, ["x", "const", "z"]).collect()}
    assert v == {"x": True, "const": False, "z": True}
    u = univariate_selection(df, ["x", "const", "z"], "y", k=1).collect()
    sel = [r["column_name"] for r in u if r["selected"]]
    assert sel == ["x"]
    assert [r for r in u if r["column_name"] == "const"][0]["f_score"] is None


def test_hash_split_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "ID_BUYER")
    a = {r[0]: r[1] for r in mark_test(df.repartition(1)).collect()}
    b = {r[0]: r[1] for r in mark_test(df.repartition(8)).collect()}
    assert a == b and 300 < sum(a.values()) < 500


def test_stratified_split_exact_counts(spark):
    df = spark.range(1001).select(F.col("id").alias("ID_BUYER"), (F.col("id") % 3 == 0).cast("int").alias("t"))
    out = stratified_split(df, "t", test_share=0.3)
    got = {r["t"]: r["n"] for r in out.where("is_test = 1").groupBy("t").agg(F.count("*").alias("n")).collect()}
    assert got == {1: math.ceil(0.3 * 334), 0: math.ceil(0.3 * 667)}


def test_folds(spark):
    df = spark.range(700).select(F.col("id").alias("ID_BUYER"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    sk = stratified_kfold(df, "y", 7)
    per = sk.groupBy("fold", "y").count().collect()
    assert {r["fold"] for r in per} == set(range(7))
    assert max(r["count"] for r in per if r["y"] == 1) - min(r["count"] for r in per if r["y"] == 1) <= 1
    assert {r[0] for r in kfold(df, 5).select("fold").distinct().collect()} == set(range(5))


def test_class_weights(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "ID_BUYER long, y int")
    got = {r["y"]: r["weight"] for r in class_weights(df, "y").collect()}
    assert got == {1: 4 / (2 * 1), 0: 4 / (2 * 3)}
