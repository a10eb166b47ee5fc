"""Profiling (A10-A17, U3) and cleaning."""

from buyerlens.operators.clean import (drop_sparse_columns, remove_outliers_iqr,
                                       remove_outliers_zscore, sparse_column_profile)
from buyerlens.operators.profile import (compare_tables, correlation_pairs, describe, histogram,
                                         missing_values_table)
from buyerlens.operators.scoring import minmax_scaled


def test_histogram_right_closed_with_min(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.25,), (1.0,)], "x double")
    got = [r["count"] for r in histogram(df, "x", 4).orderBy("bin").collect()]
    assert got == [3, 0, 0, 1]


def test_constant_column_corr_is_null_and_minmax_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation_pairs(df, ["a", "b"]).collect()}
    assert got[("b", "a")] is None and got[("a", "a")] is None
    assert abs(got[("b", "b")] - 1.0) < 1e-12
    assert [r["a"] for r in minmax_scaled(df, "a").collect()] == [0.0, 0.0]


def test_missing_values_table(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1.0), (4, 2.0)], "k long, x double")
    rows = missing_values_table(df).collect()
    assert [(r["column_name"], r["missing_values"], r["pct_of_total"]) for r in rows] == [("x", 2, 50.0)]


def test_describe_sample_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    r = describe(df, ["x"]).first()
    assert r["count"] == 4 and r["mean"] == 2.5 and r["q25"] == 1.75
    assert abs(r["std"] - 1.2909944487358056) < 1e-12


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, None), (3, 1, 1), (4, 2, 1)], "a long, b long, c long")
    assert drop_sparse_columns(df, 0.75).columns == ["a", "c"]
    kept = {r["column_name"]: r["kept"] for r in sparse_column_profile(df, 0.75).collect()}
    assert kept == {"a": True, "b": False, "c": True}


def test_iqr_filter_null_never_flags(spark):
    rows = [(float(i),) for i in range(1, 11)] + [(1000.0,), (None,)]
    df = spark.createDataFrame(rows, "x double")
    kept = [r["x"] for r in remove_outliers_iqr(df, ["x"]).collect()]
    assert 1000.0 not in kept and None in kept and len(kept) == 11


def test_zscore_filter(spark):
    rows = [(0.0,)] * 30 + [(100.0,)]
    df = spark.createDataFrame(rows, "x double")
    assert remove_outliers_zscore(df, ["x"]).count() == 30


def test_compare_tables(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k long, v string")
    r = compare_tables(a, b).first()
    assert (r["only_left"], r["only_right"], r["equal"]) == (1, 1, False)
    assert compare_tables(a, a).first()["equal"] is True
