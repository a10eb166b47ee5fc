"""Profiling operators.

Each profile is one aggregate pass over the table (plus bounded side tables
such as the 10-bin grid), unpivoted to a long result.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buyerlens.operators.aggregate import EXACT_DECIMAL, exact_sum


def _q(c: str) -> str:
    return f"`{c}`"


def _long(df: DataFrame, names: Sequence[str], fields: dict[str, list]) -> DataFrame:
    """Unpivot one wide row into one row per column name."""
    structs = [F.struct(F.lit(n).alias("column_name"),
                        *[fields[k][i].alias(k) for k in fields]) for i, n in enumerate(names)]
    return df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def missing_values_table(df: DataFrame) -> DataFrame:
    """A10 ``missing_values_table``: NULL count and percentage per column,
    columns without NULLs left out, percentage rounded to 1 decimal, the
    sparsest column first."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(F.col(_q(c)).isNull()).alias(f"__m{i}") for i, c in enumerate(cols)])
    long = _long(wide, cols, {
        "missing_values": [F.col(f"__m{i}") for i in range(len(cols))],
        "rows": [F.col("__n")] * len(cols)})
    return (long.where(F.col("missing_values") > 0)
            .select("column_name", "missing_values",
                    F.bround(F.lit(100.0) * F.col("missing_values") / F.col("rows"), 1)
                    .alias("pct_of_total")).orderBy(F.desc("pct_of_total"), "column_name"))


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """A12 ``describe()``: count, mean, sample std, min, quartiles, max per column.

    Mean and std use exact sums (two passes: the mean, then squared
    deviations).  Quartiles are exact and linear-interpolated, computed with
    the distributed ranking of ``exact_quantiles``; ``exact=False`` uses
    ``percentile_approx`` instead.
    """
    means = df.agg(*[(exact_sum(c).cast("double") / F.count(c)).alias(f"__mu{i}")
                     for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(means))
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(_q(c)).cast("double")
        d = x - F.col(f"__mu{i}")
        aggs += [F.count(x).alias(f"__n{i}"), F.first(f"__mu{i}").alias(f"__m{i}"),
                 F.sum((d * d).cast(EXACT_DECIMAL)).cast("double").alias(f"__ss{i}"),
                 F.min(x).alias(f"__min{i}"), F.max(x).alias(f"__max{i}")]
        if not exact:
            aggs.append(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)),
                                            10000).alias(f"__q{i}"))
    wide = j.agg(*aggs)
    if exact:
        from buyerlens.operators.window import exact_quantiles
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        qa = []
        for i, c in enumerate(cols):
            is_c = F.col("column_name") == c
            qa.append(F.array(*[F.max(F.when(is_c & (F.col("p") == p), F.col("value")))
                                for p in (0.25, 0.5, 0.75)]).alias(f"__q{i}"))
        wide = wide.crossJoin(F.broadcast(q.agg(*qa)))
    n = len(cols)
    return _long(wide, cols, {
        "count": [F.col(f"__n{i}") for i in range(n)],
        "mean": [F.col(f"__m{i}") for i in range(n)],
        "std": [F.when(F.col(f"__n{i}") > 1, F.sqrt(F.col(f"__ss{i}") / (F.col(f"__n{i}") - 1)))
                for i in range(n)],
        "min": [F.col(f"__min{i}") for i in range(n)],
        "q25": [F.col(f"__q{i}")[0] for i in range(n)],
        "q50": [F.col(f"__q{i}")[1] for i in range(n)],
        "q75": [F.col(f"__q{i}")[2] for i in range(n)],
        "max": [F.col(f"__max{i}") for i in range(n)]})


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """A13 ``cut(x, bins).value_counts().sort_index()``: equal-width,
    right-closed bins between min and max, empty bins kept; the lowest bin
    also holds the minimum (pandas widens its left edge)."""
    rng = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    x = F.col(col)
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.greatest(F.ceil((x - F.col("__lo")) / width) - 1, F.lit(0)), F.lit(bins - 1)))
    counts = (df.where(x.isNotNull()).crossJoin(F.broadcast(rng))
              .groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = grid.crossJoin(F.broadcast(rng)).select(
        "bin", (F.col("__lo") + F.col("bin") * width).alias("left"),
        (F.col("__lo") + (F.col("bin") + 1) * width).alias("right"))
    return (edges.join(counts, "bin", "left")
            .select("bin", "left", "right", F.coalesce("count", F.lit(0)).alias("count")))


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A14 ``corr_plot`` data: Pearson r for the lower triangle (diagonal
    included), pairwise-complete like pandas; NULL for a constant column.

    Every task adds up one block of co-moments of its rows - counts, sums,
    squares and products, each a matrix product of the value and presence
    matrices - and the blocks are summed.  Values are taken relative to the
    column's median, so that little precision is lost; a variance below 1e-12 of
    the mean square is that of a constant column.
    """
    cols = list(cols)
    d = len(cols)
    values = df.select(*[F.col(_q(c)).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    middle = values.agg(*[F.percentile_approx(f"x{i}", 0.5).alias(f"x{i}") for i in range(d)]).first()
    shift = np.array([middle[i] if middle[i] is not None else 0.0 for i in range(d)])
    blocks = values.mapInArrow(functools.partial(_co_moments, shift=shift),
                               "at int, n double, sa double, sb double, qa double, qb double, ab double")
    total = blocks.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "ab")])
    pairs = [(i * d + j, a, b) for i, a in enumerate(cols) for j, b in enumerate(cols[: i + 1])]
    names = df.sparkSession.createDataFrame(pairs, "at int, col_a string, col_b string")
    n = F.col("n")
    var = {c: F.col(f"q{c}") / n - (F.col(f"s{c}") / n) * (F.col(f"s{c}") / n) for c in "ab"}
    constant = (var["a"] <= F.col("qa") / n * 1e-12) | (var["b"] <= F.col("qb") / n * 1e-12)
    c = F.col("ab") / n - (F.col("sa") / n) * (F.col("sb") / n)
    r = F.when((n == 0) | constant, F.lit(None).cast("double")).otherwise(c / F.sqrt(var["a"] * var["b"]))
    return names.join(total.where("n > 0"), "at", "left").select("col_a", "col_b", r.alias("corr"))


def _co_moments(batches, shift: np.ndarray):
    """One row per pair of columns with the co-moments of this task's rows that hold both."""
    d = len(shift)
    sums = np.zeros((6, d, d))
    for batch in batches:
        x = np.stack([np.asarray(batch.column(i).fill_null(np.nan), float) for i in range(d)], axis=1) - shift
        there = (~np.isnan(x)).astype(float)
        x = np.where(there > 0, x, 0.0)
        # at [a, b]: rows with both, sum and squares of a and of b over them, products
        sums += np.stack([there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x])
    flat = sums.reshape(6, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d), pa.int32()), *[pa.array(v) for v in flat]],
                                     ["at", "n", "sa", "sb", "qa", "qb", "ab"])


def quartiles_by(df: DataFrame, group: str, col: str) -> DataFrame:
    """A17 box-plot data: min, quartiles, max of ``col`` per ``group``
    (exact distributed quantiles, see ``exact_quantiles``)."""
    from buyerlens.operators.window import exact_quantiles
    x = F.col(col).cast("double")
    base = df.groupBy(group).agg(F.min(x).alias("min"), F.max(x).alias("max"),
                                 F.count(x).alias("count"))
    q = exact_quantiles(df, [col], [0.25, 0.5, 0.75], group_cols=[group]).groupBy(group).agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
          for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    # NULL groups are matched explicitly (an equi-join would drop them)
    j = base.join(q, base[group].eqNullSafe(q[group]), "left").drop(q[group])
    return j.select(group, "min", "q25", "q50", "q75", "max", "count")


def compare_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """U3 ``df1.equals(df2)`` re-aimed as multiset equality plus a diff summary.

    One pass: the rows of both sides are counted per distinct row; row order
    is not compared, since Spark tables have none.
    """
    same_schema = [(f.name, f.dataType.simpleString()) for f in left.schema.fields] == \
                  [(f.name, f.dataType.simpleString()) for f in right.schema.fields]
    if not same_schema:
        common = [c for c in left.columns if c in right.columns]
        lc = left.agg(F.count(F.lit(1)).alias("rows_left"))
        rc = right.agg(F.count(F.lit(1)).alias("rows_right"))
        return lc.crossJoin(rc).select(
            F.lit(False).alias("schema_equal"), "rows_left", "rows_right",
            F.lit(None).cast("long").alias("only_left"), F.lit(None).cast("long").alias("only_right"),
            F.lit(False).alias("equal"), F.lit(",".join(common)).alias("common_columns"))
    sided = left.withColumn("__left", F.lit(True)).union(right.withColumn("__left", F.lit(False)))
    rows = sided.groupBy(*[F.col(_q(c)) for c in left.columns]).agg(
        F.count_if("__left").alias("__l"), F.count_if(~F.col("__left")).alias("__r"))
    total = lambda e, name: F.coalesce(F.sum(e), F.lit(0)).alias(name)
    zero = F.lit(0).cast("long")
    return rows.agg(total(F.col("__l"), "rows_left"), total(F.col("__r"), "rows_right"),
                    total(F.greatest(F.col("__l") - F.col("__r"), zero), "only_left"),
                    total(F.greatest(F.col("__r") - F.col("__l"), zero), "only_right")).select(
        F.lit(True).alias("schema_equal"), "rows_left", "rows_right", "only_left", "only_right",
        ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"),
        F.lit(",".join(left.columns)).alias("common_columns"))
