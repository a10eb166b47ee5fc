"""Projection, filter and row/column cleaning operators."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


class SchemaContractError(ValueError):
    """A required column is missing or too sparse."""


def select_required(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep a required column list; a missing name raises (plan-time only)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SchemaContractError(f"missing required columns: {missing}")
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Iterable[str], strict: bool = True) -> DataFrame:
    """Drop named columns; like pandas ``drop`` it raises on an unknown name."""
    cols = list(cols)
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise SchemaContractError(f"cannot drop unknown columns: {missing}")
    return df.drop(*cols)


def non_null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One-row table: ``__rows`` plus the non-null count of every column."""
    cols = list(cols or df.columns)
    return df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in cols])


def dense_columns(df: DataFrame, ratio: float) -> list[str]:
    """Columns whose non-null count is >= ratio * row count (one aggregate job)."""
    row = non_null_counts(df).first()
    n = row["__rows"]
    return [c for c in df.columns if row[c] >= ratio * n]


def drop_sparse_columns(df: DataFrame, ratio: float) -> DataFrame:
    """``dropna(thresh=ratio*len(df), axis=1)``.

    The surviving schema depends on the data, so this runs one aggregate job
    (a single row reaches the driver) and returns a lazy projection.
    """
    return df.select(*dense_columns(df, ratio))


def whole_row(cols: Sequence[str]) -> Column:
    """True for a row without NULLs in ``cols``."""
    return functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def check_dense(df: DataFrame, required: Sequence[str], ratio: float, counts: DataFrame | None = None) -> None:
    """Schema-plus-null-ratio contract: every required column must exist and
    survive ``drop_sparse_columns(df, ratio)``.  ``counts`` may give the number of rows ``n`` and of whole
    rows ``whole`` of parts of ``df`` that a caller has counted."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaContractError(f"missing required columns: {missing}")
    # no column has fewer values than there are whole rows, so most tables need one counter instead of one per column
    if counts is None:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(whole_row(required)).alias("whole")).first()
    else:
        row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("whole"), F.lit(0)).alias("whole")).first()
    if row["whole"] >= ratio * row["n"]:
        return
    kept = set(dense_columns(df.select(*required), ratio))
    sparse = [c for c in required if c not in kept]
    if sparse:
        raise SchemaContractError(f"required columns too sparse (ratio {ratio}): {sparse}")


def observe_dense(df: DataFrame, required: Sequence[str], ratio: float):
    """The contract of ``check_dense`` in two steps: ``(required columns, verify)``; call ``verify()`` before the
    result is used.

    The counts are one aggregate of their own.  An ``Observation`` would take them in the main job, but a
    session that has used one can no longer serialise a ``LogisticRegressionModel`` with its summary.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaContractError(f"missing required columns: {missing}")
    return df.select(*required), lambda: check_dense(df, required, ratio)


def sparse_column_profile(df: DataFrame, ratio: float) -> DataFrame:
    """P3 as a table: (column, non_null, rows, kept) for every column, lazily.

    Uses one aggregate and an unpivot, so nothing but the result is collected.
    """
    counts = non_null_counts(df)
    cols = [c for c in df.columns]
    stacked = counts.select(
        F.col("__rows").alias("rows"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                     F.col(f"`{c}`").cast("long").alias("non_null"))
                            for c in cols])).alias("s"))
    return stacked.select(
        F.col("s.column_name").alias("column_name"), F.col("s.non_null").alias("non_null"),
        F.col("rows"),
        (F.col("s.non_null") >= F.lit(ratio) * F.col("rows")).alias("kept"))


def fill_constants(df: DataFrame, fills: dict) -> DataFrame:
    """Fill NULLs per column with constants (``fillna`` on named columns).

    ``na.fill`` skips columns whose type does not match the value, so we cast
    explicitly to keep e.g. 999 in a long column.
    """
    exprs = []
    for c in df.columns:
        if c in fills:
            dtype = df.schema[c].dataType
            exprs.append(F.coalesce(F.col(c), F.lit(fills[c]).cast(dtype)).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def missing_values_fill(df: DataFrame, count_fill=0, recency_fill=999) -> DataFrame:
    """P6 ``missing_values(df)``: counts -> 0, recencies -> 999."""
    fills = {c: count_fill for c in ("NB_products_liked", "NB_categories_liked",
                                     "NB_products_commented", "NB_categories_commented",
                                     "Frequnecy_comment_12M") if c in df.columns}
    fills.update({c: recency_fill for c in ("Recency_comment", "Recency_liked")
                  if c in df.columns})
    return fill_constants(df, fills)


def activity_since(df: DataFrame, date_col: str, cutoff: str) -> DataFrame:
    """Keep rows not before the cutoff: ``~(date < cutoff)``.

    NULL dates are kept, exactly as the negated comparison does in pandas.
    The non-null comparison is written on the bare column so it pushes down.
    """
    c = F.col(date_col)
    return df.where(c.isNull() | (c >= F.to_timestamp_ntz(F.lit(cutoff))))


def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    """One-row table of [Q1 - f*IQR, Q3 + f*IQR] per column, from exact
    linear-interpolated quartiles computed without a single-task merge."""
    from buyerlens.operators.window import exact_quantiles
    q = exact_quantiles(df, cols, [0.25, 0.75])
    aggs = []
    for c in cols:
        is_c = F.col("column_name") == c
        aggs += [F.max(F.when(is_c & (F.col("p") == 0.25), F.col("value"))).alias(f"__q1_{c}"),
                 F.max(F.when(is_c & (F.col("p") == 0.75), F.col("value"))).alias(f"__q3_{c}")]
    qs = q.agg(*aggs)
    out = []
    for c in cols:
        q1, q3 = F.col(f"__q1_{c}"), F.col(f"__q3_{c}")
        iqr = q3 - q1
        out += [(q1 - F.lit(factor) * iqr).alias(f"__lo_{c}"),
                (q3 + F.lit(factor) * iqr).alias(f"__hi_{c}")]
    return qs.select(*out)


def remove_outliers_iqr(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Drop a row if any column lies outside [Q1 - f*IQR, Q3 + f*IQR].

    The bounds are a one-row aggregate joined by broadcast (size 1 by
    construction).  A NULL value never flags a row.
    """
    bounds = iqr_bounds(df, cols, factor)
    flag = F.lit(False)
    for c in cols:
        v = F.col(c).cast("double")
        out = (v < F.col(f"__lo_{c}")) | (v > F.col(f"__hi_{c}"))
        flag = flag | F.coalesce(out, F.lit(False))
    joined = df.crossJoin(F.broadcast(bounds))
    return joined.where(~flag).select(*[F.col(f"`{c}`") for c in df.columns])


def remove_outliers_zscore(df: DataFrame, cols: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Keep a row iff |z| < limit in every column, z with the population
    std (exact two-pass sums).

    As with scipy's default NaN propagation, a column holding any NULL (or a
    constant column) gives NULL z-scores, which fail the test for every row.
    """
    from buyerlens.operators.aggregate import exact_mean, exact_sum
    means = df.agg(F.count(F.lit(1)).alias("__n"),
                   *[exact_mean(f"`{c}`").alias(f"__mu_{c}") for c in cols],
                   *[F.count(f"`{c}`").alias(f"__nn_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(means))
    var = j.agg(*[F.first(f"__mu_{c}").alias(f"__mu_{c}") for c in cols],
                *[F.first(f"__nn_{c}").alias(f"__nn_{c}") for c in cols],
                F.first("__n").alias("__n"),
                *[(exact_sum((F.col(f"`{c}`").cast("double") - F.col(f"__mu_{c}"))
                             * (F.col(f"`{c}`").cast("double") - F.col(f"__mu_{c}"))).cast("double")
                   / F.count(f"`{c}`")).alias(f"__var_{c}") for c in cols])
    stats = var.select(*[F.col(f"__mu_{c}") for c in cols],
                       *[F.when(F.col(f"__nn_{c}") == F.col("__n"), F.sqrt(f"__var_{c}"))
                         .alias(f"__sd_{c}") for c in cols])
    keep = F.lit(True)
    for c in cols:
        sd = F.col(f"__sd_{c}")
        z = F.when(sd == 0, F.lit(None).cast("double")).otherwise(
            (F.col(f"`{c}`").cast("double") - F.col(f"__mu_{c}")) / sd)
        keep = keep & F.coalesce(F.abs(z) < F.lit(limit), F.lit(False))
    return (df.crossJoin(F.broadcast(stats)).where(keep)
            .select(*[F.col(f"`{c}`") for c in df.columns]))


def preview(df: DataFrame, order_by: Sequence, n: int = 5) -> DataFrame:
    """``head(n)`` made deterministic with an explicit total order."""
    return df.orderBy(*order_by).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """``shape`` as a one-row table (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("long"))
