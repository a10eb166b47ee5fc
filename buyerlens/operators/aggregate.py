"""Group aggregates with pandas semantics.

pandas ``sum`` skips NULLs and gives 0 for an all-NULL group, ``mean`` gives
NULL there, ``nunique``/``count`` skip NULLs.  Spark ``sum`` returns NULL for
an all-NULL group, hence the ``coalesce``.

Every aggregate here is partial-aggregation friendly: a hot key is reduced on
the map side before the shuffle, so one buyer holding a third of all rows
does not end up as one giant task.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F


def sum0(c) -> Column:
    """A1: group sum with pandas semantics (all-NULL group -> 0)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0))


EXACT_DECIMAL = "decimal(38,10)"


def exact_sum(c) -> Column:
    """Order-independent sum: every value is rounded to 10 decimals and summed
    exactly as DECIMAL(38,10).  The result does not depend on partitioning or
    row order (a floating-point sum does), so reruns and repartitioned runs
    agree bit for bit.  Precision: at most 0.5e-10 per term; sums up to 1e27.

    A value whose product with 1e10 is certain to round to the same whole number
    (product and decimal text are off by less than ``2**-51`` of it) is summed as
    that number, in two parts of 25 bits; only the others are cast to DECIMAL."""
    c = F.col(c) if isinstance(c, str) else c
    scaled = c.cast("double") * F.lit(1e10)
    size, loss = F.abs(scaled), F.abs(scaled - F.rint(scaled))
    sure = (size < F.lit(2.0 ** 50)) & (F.lit(0.5) - loss > size * F.lit(2.0 ** -51))
    units = F.when(sure, F.rint(scaled)).cast("long")
    high, low = F.sum(F.shiftright(units, 25)), F.sum(units.bitwiseAND(F.lit((1 << 25) - 1)))
    near = ((high.cast("decimal(19,0)") * F.lit(1 << 25).cast("decimal(8,0)") + low).cast("decimal(27,0)")
            * F.lit(Decimal("1e-10")).cast("decimal(10,10)")).cast(EXACT_DECIMAL)
    far = F.sum(F.when(~sure, c.cast(EXACT_DECIMAL)))
    both = (near.cast("decimal(37,10)") + far.cast("decimal(37,10)")).cast(EXACT_DECIMAL)
    return F.when(far.isNull(), near).when(high.isNull(), far).otherwise(both)


def exact_mean(c) -> Column:
    """A2: group mean from an exact sum, converted to double once and divided
    by the non-NULL count (NULL for an all-NULL group, like pandas)."""
    c = F.col(c) if isinstance(c, str) else c
    return exact_sum(c).cast("double") / F.count(c)


def sql_exact_mean(c: str) -> str:
    """The same mean in DuckDB SQL."""
    return f"(CAST(SUM(CAST({c} AS DECIMAL(38,10))) AS DOUBLE) / COUNT({c}))"


def mode_value(c) -> Column:
    """A6 as an aggregate: most frequent non-NULL value as text, ties to the smallest value.

    Its buffer counts the distinct values of a group, whatever the number of rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.mode(c.cast("string"), True)


def group_mode(df: DataFrame, key: str, cols: Sequence[str], weight: str | None = None,
               suffix: str = "") -> DataFrame:
    """Most frequent non-NULL value per group for several columns at once.

    A tie is broken towards the smallest value, deterministically.

    Plan: one partially aggregated aggregate for all columns (``mode_value``), so a
    row is neither multiplied by the columns nor shuffled twice.  ``weight`` lets the
    caller feed pre-aggregated row counts: unpivot to (key, column, value) -> sum of
    the weights -> per key, ``min(struct(-sum, value))`` per column.
    """
    if weight is None:
        return df.groupBy(key).agg(*[mode_value(c).alias(c + suffix) for c in cols])
    unpivoted = df.select(
        F.col(key), F.col(weight).alias("__w"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.col(c).cast("string").alias("v"))
                            for i, c in enumerate(cols)])).alias("__s"))
    counts = (unpivoted.where(F.col("__s.v").isNotNull())
              .groupBy(F.col(key), F.col("__s.ci").alias("ci"), F.col("__s.v").alias("v"))
              .agg(F.sum("__w").alias("cnt")))
    best = counts.groupBy(key).agg(*[
        F.min(F.when(F.col("ci") == i, F.struct((-F.col("cnt")).alias("neg"), F.col("v"))))
        .alias(f"__m{i}") for i in range(len(cols))])
    return best.select(key, *[F.col(f"__m{i}.v").alias(c + suffix) for i, c in enumerate(cols)])


def first_struct(order_cols: Sequence[str], value_cols: Sequence[str], where: Column | None = None) -> Column:
    """A7 as an aggregate: ``min(struct(order..., values...))`` of the rows for which ``where`` holds."""
    st = F.struct(*[F.col(c) for c in order_cols], *[F.col(c).alias(f"__v_{c}") for c in value_cols])
    return F.min(st if where is None else F.when(where, st))


def group_first(df: DataFrame, key: str, order_cols: Sequence[str],
                value_cols: Sequence[str]) -> DataFrame:
    """Per group, the values of the first row under an explicit total order.

    ``min(struct(order..., values...))`` - a plain, partially aggregated
    aggregate.  Callers pass NULL-free rows (the reference drops NULL rows
    before ``first()``), so the first row's values are the first non-NULL
    values.
    """
    first = df.groupBy(key).agg(first_struct(order_cols, value_cols).alias("__first"))
    return first.select(key, *[F.col(f"__first.__v_{c}").alias(c) for c in value_cols])


def first_non_null(df: DataFrame, key: str, order_cols: Sequence[str],
                   value_cols: Sequence[str]) -> DataFrame:
    """A7 general form: first non-NULL value of each column in the given order."""
    order = F.struct(*[F.col(c) for c in order_cols])
    aggs = [F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))
            .alias(f"__f_{c}") for c in value_cols]
    res = df.groupBy(key).agg(*aggs)
    return res.select(key, *[F.col(f"__f_{c}.v").alias(c) for c in value_cols])


def with_global_max(df: DataFrame, col: str, alias: str) -> DataFrame:
    """Attach the table-wide maximum of ``col`` to every row.

    A one-row aggregate joined by broadcast; no un-partitioned window (which
    would move every row to a single task).
    """
    mx = df.agg(F.max(col).alias(alias))
    return df.crossJoin(F.broadcast(mx))


def value_counts(df: DataFrame, col: str, count_name: str = "count") -> DataFrame:
    """``value_counts()`` - rows per distinct value, the most frequent first, NULLs excluded."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(count_name)).orderBy(F.desc(count_name), col))


def transform_by_group(df: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """``groupby(key)[..].transform(f)`` - a group aggregate on every row.

    Aggregate then join back on the key (hash join, AQE splits a skewed key)
    instead of a window, which would need a whole group in one task.
    """
    agg = df.groupBy(key).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return df.join(agg, on=key, how="left")
