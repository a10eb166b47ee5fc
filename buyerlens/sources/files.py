"""File sources and sinks.

* S1 pipe-delimited CSV and S2 comma CSV are read with an explicit schema and a
  header; no inference pass over the data.
* S3 rereads a scores table; an index column written by a pandas-style export
  is dropped.
* S4 writes CSV or Parquet; S5 stores predictions keyed by ``ID_BUYER`` so they
  are joined back by key, never by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


TIMESTAMP_CSV_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                   header: bool = True, timestamp_format: str | None = None) -> DataFrame:
    reader = (spark.read.schema(schema).option("header", header).option("sep", sep)
              .option("mode", "FAILFAST"))
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    return reader.csv(path)


def read_pipe_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``read_csv(path, sep='|')`` with an explicit schema."""
    return read_delimited(spark, path, schema, sep="|")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated file with header."""
    return read_delimited(spark, path, schema, sep=",")


def read_scores(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType | None = None) -> DataFrame:
    """S3: reread a saved scores table, dropping a leading unnamed index column."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True)
        df = (df.schema(schema) if schema is not None else df.option("inferSchema", False)).csv(path)
    for name in df.columns:
        if name in ("", "_c0", "index", "Unnamed: 0"):
            df = df.drop(name)
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ",",
                mode: str = "overwrite", single_file: bool = False) -> None:
    """Write a table.  ``single_file`` coalesces to one file - only for small
    reports (top-k, leaderboards); large tables stay partitioned."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        # full microsecond precision (Spark's default CSV format keeps milliseconds)
        (w.option("header", True).option("sep", sep)
         .option("timestampFormat", TIMESTAMP_CSV_FORMAT)
         .option("timestampNTZFormat", TIMESTAMP_CSV_FORMAT).csv(path))
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def save_predictions(df: DataFrame, path: str, key: str = "ID_BUYER",
                     value: str = "prediction") -> None:
    """Store predictions as (key, value) Parquet."""
    df.select(key, value).write.mode("overwrite").parquet(path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_logical(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|",
                 null_ratio: float | None = None) -> DataFrame:
    """Read a raw export by header name and cast to a logical schema.

    Exports carry more columns than the pipeline keeps, so the file is read
    with every column as a string (no inference pass), the required columns
    are checked and selected by name (P1), and each is cast explicitly; an
    unparsable value fails the job under ANSI (F4).  With ``null_ratio`` the
    required columns must also be dense enough (the sparse-column contract).
    """
    from pyspark.sql import functions as F

    from buyerlens.operators.clean import check_dense, select_required
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path)
    names = [f.name for f in schema.fields]
    df = select_required(raw, names)
    if null_ratio is not None:
        check_dense(df, names, null_ratio)
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            cols.append(F.to_timestamp(c).alias(f.name))
        else:
            cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
