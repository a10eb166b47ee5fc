"""Registry of named queries: a Spark builder plus an optional DuckDB oracle.

Each registered query reads the driver tables under ``sf_dir`` and returns a
DataFrame.  Double columns listed in ``round_cols`` are rounded to ``digits``
decimals on both sides, so the comparison is not sensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    round_cols: tuple = field(default_factory=tuple)
    digits: int = 6

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if self.round_cols:
            df = df.withColumns({c: F.round(F.col(c).cast("double"), self.digits)
                                 for c in self.round_cols})
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.round_cols:
            return self.sql
        repl = ", ".join(f"round(CAST({c} AS DOUBLE), {self.digits}) AS {c}" for c in self.round_cols)
        return f"SELECT * REPLACE ({repl}) FROM (\n{self.sql}\n) AS q"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, round_cols=(), digits: int = 6):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(round_cols), digits)
        return fn
    return deco
