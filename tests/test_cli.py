"""Command line: raw pipe-delimited exports -> buyer table -> model table -> scores."""

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from buyerlens.__main__ import main
from buyerlens.sources import files
from buyerlens.sources import fixtures as fx


def _canon(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = df[cols].astype(str).replace({"NaT": "None", "nan": "None", "<NA>": "None"})
    return cols, sorted(map(tuple, out.values.tolist()))


def test_cli_pipeline(spark, sf001):
    root = tempfile.mkdtemp(prefix="cli-")
    paths = {}
    for name, build in (("purchases", fx.purchases), ("offers", fx.offers),
                        ("likes", fx.likes), ("comments", fx.comments)):
        paths[name] = os.path.join(root, name)
        # exports carry columns the pipeline does not keep
        files.write_table(build(spark, sf001).withColumn("UNUSED_COLUMN", F.lit("x")),
                          paths[name], fmt="csv", sep="|")
    buyers, model = os.path.join(root, "buyers"), os.path.join(root, "model")
    assert main(["build-features", "--purchases", paths["purchases"], "--offers", paths["offers"],
                 "--likes", paths["likes"], "--comments", paths["comments"], "--out", buyers,
                 "--cutoff", "2024-01-15", "--check-density"]) == 0
    assert main(["model-table", "--buyers", buyers, "--out", model, "--snapshot", "2024-02-11"]) == 0
    got_b = spark.read.parquet(buyers).toPandas()
    exp_b = entry.queries()["D4_buyer_table"](spark, sf001).toPandas()
    assert _canon(got_b) == _canon(exp_b)
    got_m = spark.read.parquet(model).toPandas()
    exp_m = entry.queries()["D5_model_table"](spark, sf001).toPandas()
    assert _canon(got_m) == _canon(exp_m)
    out = os.path.join(root, "scores")
    assert main(["score", "--train", model, "--upload", model, "--out", out]) == 0
    assert spark.read.parquet(os.path.join(out, "scores")).count() == len(got_m)
