"""File-to-file steps of the batch pipeline (used by the command line)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from buyerlens import params
from buyerlens.plans import buyer_features as bf
from buyerlens.plans import model_table as mt
from buyerlens.sources import files, schemas


def build_features(spark: SparkSession, purchases: str, offers: str, likes: str, comments: str,
                   out: str, cutoff: str = params.ACTIVITY_CUTOFF,
                   check_density: bool = False) -> None:
    """S1 reads of the four exports, D1-D4, Parquet sink."""
    ratio = (lambda r: r) if check_density else (lambda r: None)
    p = files.read_logical(spark, purchases, schemas.PURCHASES, null_ratio=ratio(params.NULL_RATIO_PURCHASES))
    o = files.read_logical(spark, offers, schemas.OFFERS)
    lk = files.read_logical(spark, likes, schemas.LIKES, null_ratio=ratio(params.NULL_RATIO_LIKES))
    cm = files.read_logical(spark, comments, schemas.COMMENTS,
                            null_ratio=ratio(params.NULL_RATIO_COMMENTS))
    bf.buyer_table(p, o, lk, cm, cutoff).write.mode("overwrite").parquet(out)


def build_model_table(spark: SparkSession, buyers: str, out: str,
                      snapshot: str = params.SNAPSHOT_DATE) -> None:
    """D5 from a stored buyer table."""
    mt.model_table(spark.read.parquet(buyers), snapshot).write.mode("overwrite").parquet(out)
