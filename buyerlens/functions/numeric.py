"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """Division that yields NULL for a zero denominator (ANSI would raise)."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def safe_ratio_expr(expression: str) -> Column:
    """evaluate a string expression with ``/`` made zero-safe."""
    import re

    # a/(b+c) -> try_divide(a, (b+c)); operands are identifiers or parenthesised.
    pattern = re.compile(r"([A-Za-z_][A-Za-z0-9_]*|\([^()]*\))\s*/\s*([A-Za-z_][A-Za-z0-9_]*|\([^()]*\))")
    text = expression
    while True:
        new = pattern.sub(lambda m: f"try_divide({m.group(1)}, {m.group(2)})", text, count=1)
        if new == text:
            return F.expr(text)
        text = new


def label_at(p, threshold) -> Column:
    """1 when p >= threshold else 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (_col(p) >= t).cast("int")


def threshold_grid(spark: SparkSession, n: int = 1000, step: float = 0.001):
    """thresholds 0, step, 2*step, ... (n values) as a DataFrame ``(t_idx, threshold)``.

    ``id * step`` in double arithmetic equals NumPy's ``arange`` values.
    """
    return spark.range(n).select(
        F.col("id").alias("t_idx"), (F.col("id").cast("double") * F.lit(step)).alias("threshold"))
