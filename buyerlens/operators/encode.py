"""Encoding, scaling and feature selection fitted on a training side.

Every ``fit_*`` returns a small DataFrame of fitted statistics (one row, or
one row per category); ``apply_*`` joins it to any table, so the validation
side never contributes to what is fitted (no label leakage).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from buyerlens import params
from buyerlens.operators.aggregate import exact_mean, exact_sum
from buyerlens.session import materialize


def _q(c: str) -> str:
    return f"`{c}`"


# ---------------------------------------------------------------- E1
def fit_target_encoder(train: DataFrame, cols: Sequence[str], target: str,
                       min_samples_leaf: int = params.TE_MIN_SAMPLES_LEAF,
                       smoothing: float = params.TE_SMOOTHING,
                       single_to_prior: bool = True) -> tuple[DataFrame, DataFrame]:
    """E1 fit: per (column, category) the smoothed target mean.

    ``w = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing))``,
    ``enc = prior * (1 - w) + mean * w``; a category seen once maps to the
    prior (``single_to_prior``).  Returns ``(mapping, prior)``: mapping rows
    ``(column_name, category, encoded)``, prior one row.
    """
    prior = train.agg(exact_mean(target).alias("prior"))
    # one scan: every row unpivots to its (column, category) pairs, reduced map-side
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category"))
                      for c in cols])
    stats = (train.select(F.col(target), F.explode(pairs).alias("__p")).select(target, "__p.*")
             .where(F.col("category").isNotNull()).groupBy("column_name", "category")
             .agg(F.count(F.lit(1)).alias("n"), exact_mean(target).alias("mean")))
    w = 1.0 / (1.0 + F.exp(-(F.col("n") - F.lit(min_samples_leaf)) / F.lit(float(smoothing))))
    enc = F.col("prior") * (1.0 - w) + F.col("mean") * w
    if single_to_prior:
        enc = F.when(F.col("n") == 1, F.col("prior")).otherwise(enc)
    mapping = stats.crossJoin(F.broadcast(prior)).select("column_name", "category",
                                                           enc.alias("encoded"))
    return mapping, prior


def apply_target_encoder(df: DataFrame, mapping: DataFrame, prior: DataFrame,
                         cols: Sequence[str]) -> DataFrame:
    """E1 apply: replace each category by its encoding; unseen or NULL
    categories get the training prior.

    One equi-join per encoded column on (category).  The mapping is as large
    as the column's cardinality; AQE broadcasts it when its measured bytes
    allow and splits the partition of a hot category otherwise.
    """
    out = df.crossJoin(F.broadcast(prior.select(F.col("prior").alias("__prior"))))
    mapping = materialize(mapping)  # read once per column
    for c in cols:
        m = (mapping.where(F.col("column_name") == c)
             .select(F.col("category").alias(f"__cat_{c}"), F.col("encoded").alias(f"__enc_{c}")))
        out = (out.join(m, F.col(c).cast("string") == F.col(f"__cat_{c}"), "left")
               .withColumn(c, F.coalesce(F.col(f"__enc_{c}"), F.col("__prior")))
               .drop(f"__cat_{c}", f"__enc_{c}"))
    return out.drop("__prior")


# ---------------------------------------------------------------- E2 / E3
def fit_minmax(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E2 fit: one row with min and max of every column."""
    return train.agg(*[F.min(_q(c)).cast("double").alias(f"min__{c}") for c in cols],
                     *[F.max(_q(c)).cast("double").alias(f"max__{c}") for c in cols])


def apply_minmax(df: DataFrame, fitted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E2 apply: (x - min) / (max - min); a zero range divides by 1
    (a constant training column maps to x - min)."""
    j = df.crossJoin(F.broadcast(fitted))
    for c in cols:
        rng = F.col(f"max__{c}") - F.col(f"min__{c}")
        j = j.withColumn(c, (F.col(_q(c)).cast("double") - F.col(f"min__{c}"))
                         / F.when(rng == 0, F.lit(1.0)).otherwise(rng))
    return j.drop(*[f"min__{c}" for c in cols], *[f"max__{c}" for c in cols])


def fit_standard(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E3 fit: mean and population std per column (exact two-pass sums)."""
    means = train.agg(*[exact_mean(_q(c)).alias(f"mu__{c}") for c in cols])
    j = train.crossJoin(F.broadcast(means))
    devs = []
    for c in cols:
        d = F.col(_q(c)).cast("double") - F.col(f"mu__{c}")
        devs.append((exact_sum(d * d).cast("double") / F.count(_q(c))).alias(f"var__{c}"))
    var = j.agg(*devs)
    return means.crossJoin(var).select(
        *[F.col(f"mu__{c}") for c in cols], *[F.sqrt(F.col(f"var__{c}")).alias(f"sd__{c}") for c in cols])


def apply_standard(df: DataFrame, fitted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E3 apply: (x - mean) / std, a zero std divides by 1."""
    j = df.crossJoin(F.broadcast(fitted))
    for c in cols:
        sd = F.col(f"sd__{c}")
        j = j.withColumn(c, (F.col(_q(c)).cast("double") - F.col(f"mu__{c}"))
                         / F.when(sd == 0, F.lit(1.0)).otherwise(sd))
    return j.drop(*[f"mu__{c}" for c in cols], *[f"sd__{c}" for c in cols])


def scale(train: DataFrame, test: DataFrame, cols: Sequence[str], scaler: str):
    """E2-E4 ``scaling``: fit on train, apply to both.  An unknown scaler
    name raises instead of silently returning the input."""
    if scaler == "MinMaxScaler":
        f = fit_minmax(train, cols)
        return apply_minmax(train, f, cols), apply_minmax(test, f, cols)
    if scaler == "StandardScaler":
        f = fit_standard(train, cols)
        return apply_standard(train, f, cols), apply_standard(test, f, cols)
    raise ValueError(f"unknown scaler {scaler!r}; use 'MinMaxScaler' or 'StandardScaler'")


# ---------------------------------------------------------------- E5 / E6
def _moments(train: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """One row: n, exact means and exact central second moments (and
    cross-moments with ``target``)."""
    names = list(cols) + ([target] if target else [])
    means = train.agg(F.count(F.lit(1)).alias("__n"),
                      *[exact_mean(_q(c)).alias(f"mu__{c}") for c in names])
    j = train.crossJoin(F.broadcast(means))
    aggs = [F.first("__n").alias("__n")]
    for c in names:
        d = F.col(_q(c)).cast("double") - F.col(f"mu__{c}")
        aggs.append(exact_sum(d * d).cast("double").alias(f"ss__{c}"))
    if target:
        dy = F.col(_q(target)).cast("double") - F.col(f"mu__{target}")
        for c in cols:
            d = F.col(_q(c)).cast("double") - F.col(f"mu__{c}")
            aggs.append(exact_sum(d * dy).cast("double").alias(f"sxy__{c}"))
    return j.agg(*aggs)


def variance_threshold(train: DataFrame, cols: Sequence[str],
                       threshold: float = params.VARIANCE_THRESHOLD) -> DataFrame:
    """E5: population variance per column and whether it exceeds the threshold."""
    m = _moments(train, cols)
    structs = [F.struct(F.lit(c).alias("column_name"),
                        (F.col(f"ss__{c}") / F.col("__n")).alias("variance")) for c in cols]
    return (m.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
            .withColumn("kept", F.col("variance") > F.lit(threshold)))


def univariate_selection(train: DataFrame, cols: Sequence[str], target: str,
                         k: int = params.K_BEST) -> DataFrame:
    """F statistic of a univariate linear regression per feature,
    ``F = r^2 / (1 - r^2) * (n - 2)``, and the top ``k`` (ties by name).
    A constant feature has a NULL F and ranks last; |r| = 1 gives +inf."""
    m = _moments(train, cols, target)
    syy = F.col(f"ss__{target}")
    structs = []
    for c in cols:
        sxx, sxy = F.col(f"ss__{c}"), F.col(f"sxy__{c}")
        r = F.when((sxx == 0) | (syy == 0), F.lit(None).cast("double")) \
             .otherwise(sxy / F.sqrt(sxx * syy))
        # a perfectly correlated feature has an infinite F (ranked first)
        f = F.when(F.lit(1.0) - r * r == 0, F.lit(float("inf"))).otherwise(
            r * r / (F.lit(1.0) - r * r) * (F.col("__n") - 2))
        structs.append(F.struct(F.lit(c).alias("column_name"), r.alias("r"), f.alias("f_score")))
    long = m.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    # one row per feature (bounded by the feature count): a plain window is fine
    from pyspark.sql import Window
    w = Window.orderBy(F.col("f_score").desc_nulls_last(), F.col("column_name"))
    return long.withColumn("rank", F.row_number().over(w).cast("long")).withColumn(
        "selected", F.col("rank") <= F.lit(k))
