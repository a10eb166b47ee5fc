"""Train/test splits, folds and class weights.

Assignments derive from a hash of the key, never from row position, so they
are identical under any partitioning and reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buyerlens import params
from buyerlens.functions.hashing import key_fraction, key_hash32


def split_salt(seed) -> str:
    return f"split{seed}"


def fold_salt(seed) -> str:
    return f"fold{seed}"


def mark_test(df: DataFrame, key: str = "ID_BUYER", test_share: float = params.TEST_SHARE,
              seed=params.SEED, out: str = "is_test") -> DataFrame:
    """Unstratified random split by key hash; ``out`` is 1 for the test side."""
    return df.withColumn(out, (key_fraction(key, split_salt(seed)) < F.lit(test_share)).cast("int"))


def train_test_split(df: DataFrame, key: str = "ID_BUYER",
                     test_share: float = params.TEST_SHARE, seed=params.SEED):
    """E8 as two DataFrames ``(train, test)``."""
    marked = mark_test(df, key, test_share, seed)
    return (marked.where(F.col("is_test") == 0).drop("is_test"),
            marked.where(F.col("is_test") == 1).drop("is_test"))


def kfold(df: DataFrame, k: int, key: str = "ID_BUYER", seed=params.SEED,
          out: str = "fold") -> DataFrame:
    """Shuffled k-fold as a fold column, ``hash(key) mod k``."""
    return df.withColumn(out, (key_hash32(key, fold_salt(seed)) % F.lit(k)).cast("int"))


def stratified_rank_column(df: DataFrame, stratum: str, key: str, seed, out: str) -> DataFrame:
    """Row number of each row within its stratum, in key-hash order.

    Exact at any scale: computed with the distributed ordered scan (range
    partitioning + per-partition counts), not a window over the stratum.
    """
    from buyerlens.operators.window import ordered_scan
    h = "__h"
    with_h = df.withColumn(h, key_hash32(key, split_salt(seed)))
    ranked = ordered_scan(with_h, order_by=[(h, True), (key, True)],
                          partition_by=[stratum], pos_col=out)
    return ranked.drop(h)


def stratified_split(df: DataFrame, stratum: str, key: str = "ID_BUYER",
                     test_share: float = params.UPLIFT_TEST_SHARE, seed=params.SEED,
                     out: str = "is_test") -> DataFrame:
    """Stratified split; in each stratum the ``ceil(share * n)`` rows with
    the smallest key hash form the test side (exact per-stratum counts)."""
    ranked = stratified_rank_column(df, stratum, key, seed, "__rn")
    counts = ranked.groupBy(F.col(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__cnt"))
    # NULL is a stratum like any other
    res = ranked.join(counts, F.col(stratum).eqNullSafe(F.col("__s")), "left").drop("__s")
    res = res.withColumn(out, (F.col("__rn") <= F.ceil(F.lit(test_share) * F.col("__cnt"))).cast("int"))
    return res.drop("__rn", "__cnt")


def stratified_kfold(df: DataFrame, label: str, k: int = params.FOLDS_CLASSIFIER,
                     key: str = "ID_BUYER", seed=params.SEED, out: str = "fold") -> DataFrame:
    """Stratified k-fold - fold = (row number within label, hash order) mod k,
    so each fold gets an equal share of every class."""
    ranked = stratified_rank_column(df, label, key, f"f{seed}", "__rn")
    return ranked.withColumn(out, ((F.col("__rn") - 1) % F.lit(k)).cast("int")).drop("__rn")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``is_unbalance``-style weights ``n / (n_classes * n_class)``.

    NULL counts as a class of its own.
    """
    counts = df.groupBy(F.col(label).alias("__c")).agg(F.count(F.lit(1)).alias("__nc"))
    tot = counts.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    w = counts.crossJoin(tot).select(
        "__c", (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    return df.join(w, F.col(label).eqNullSafe(F.col("__c")), "left").drop("__c")
