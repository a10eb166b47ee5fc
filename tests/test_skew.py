"""Hot keys: one buyer holds a third of all rows; results stay exact."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from buyerlens.functions.dates import to_timestamp_strict
from buyerlens.plans.buyer_features import likes_features
from buyerlens.sources import fixtures as fx


def test_activity_features_with_hot_buyer(spark, sf01):
    likes = fx.likes(spark, sf01).withColumn(
        "ID_BUYER", F.when(F.col("ID_LIKE") % 3 == 0, F.lit(0)).otherwise(F.col("ID_BUYER")))
    got = likes_features(likes, "2024-01-15").toPandas().set_index("ID_BUYER").sort_index()
    pdf = likes.toPandas()
    g = pdf.groupby("ID_BUYER")
    exp = pd.DataFrame({
        "Total_likes": g["LIKES"].sum(),
        "NB_products_liked": g["ID_PRODUCT"].nunique(),
        "Avg_commision_liked": g["COMMISSION"].mean(),
        "Frequnecy_like_12M": g["DATE_LIKED"].apply(lambda s: (s >= pd.Timestamp("2024-01-15")).sum()),
    }).sort_index()
    hot = (pdf["ID_BUYER"] == 0).mean()
    assert hot > 0.3
    assert (got["Total_likes"] == exp["Total_likes"]).all()
    assert (got["NB_products_liked"] == exp["NB_products_liked"]).all()
    assert (got["Frequnecy_like_12M"] == exp["Frequnecy_like_12M"]).all()
    assert ((got["Avg_commision_liked"] - exp["Avg_commision_liked"]).abs() < 1e-9).all()


def test_invalid_timestamp_raises(spark):
    df = spark.createDataFrame([("not a date",)], "s string")
    with pytest.raises(Exception):
        df.select(to_timestamp_strict("s")).collect()
