"""Buyer table to model table (D5): drop, date features, fills, ordinal encoding.

A single projection over the buyer table - no shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from buyerlens import params
from buyerlens.functions.dates import days_since, floor_days_between
from buyerlens.functions.maps import ordinal_segment
from buyerlens.operators.clean import drop_columns, missing_values_fill

DROP_FOR_MODEL, DROP_DATES, DROP_TOTALS = params.DROP_FOR_MODEL, params.DROP_DATES, params.DROP_TOTALS

TARGETS = ["REPEATER", "CLTV"]
TARGET_ENCODED = ["ID_CATEGORY", "ID_SUBCATEGORY", "ID_BRAND", "ID_PAYMENT_TYPE"]


def drop_model_columns(df: DataFrame) -> DataFrame:
    """``drop_columns(df)``."""
    return drop_columns(df, DROP_FOR_MODEL)


def date_features(df: DataFrame, snapshot: str = params.SNAPSHOT_DATE) -> DataFrame:
    """``date_time_converting(df)``: days from account creation to first order,
    days since last login at the snapshot date; dates and two totals dropped."""
    df = (df.withColumn("days_bf_first_order",
                        floor_days_between("DATE_FIRST_PURCHASE", "DATE_CREATION"))
          .withColumn("days_since_last_login", days_since(snapshot, "DATE_LAST_LOGIN")))
    return drop_columns(df, DROP_DATES + DROP_TOTALS)


def encode_segment(df: DataFrame) -> DataFrame:
    """``encoding(df)``: USER_SEGMENT name -> ordinal 0..10, unknown -> NULL."""
    return df.withColumn("USER_SEGMENT", ordinal_segment("USER_SEGMENT"))


def model_table(buyers: DataFrame, snapshot: str = params.SNAPSHOT_DATE) -> DataFrame:
    """The four preparation steps in the reference's order."""
    df = drop_model_columns(buyers)
    df = date_features(df, snapshot)
    df = missing_values_fill(df, params.FILL_COUNT, params.FILL_RECENCY)
    return encode_segment(df)


def feature_columns(df: DataFrame, drop_encoded: bool = False) -> list[str]:
    """Model features = all columns but the key and the two targets."""
    skip = {"ID_BUYER", *TARGETS}
    if drop_encoded:
        skip |= set(TARGET_ENCODED)
    return [c for c in df.columns if c not in skip]
