"""Scalar functions: day floors (G1), value maps (F1-F3), hashing."""

import datetime as dt

from buyerlens.functions.dates import days_since, floor_days_between
from buyerlens.functions.hashing import key_bit, key_fraction
from buyerlens.functions.maps import buyer_type_label, gender_net_map, ordinal_segment, swap_binary
from buyerlens.functions.numeric import label_at, safe_ratio_expr, threshold_grid


def test_sub_day_gap_floors(spark):
    rows = [(dt.datetime(2022, 1, 2, 1), dt.datetime(2022, 1, 1, 23)),
            (dt.datetime(2022, 1, 1, 23), dt.datetime(2022, 1, 2, 1)),
            (dt.datetime(2022, 1, 3, 0), dt.datetime(2022, 1, 1, 0))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(floor_days_between("a", "b")).collect()]
    assert got == [0, -1, 2]


def test_days_since_snapshot(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 2, 10, 12),)], "t timestamp_ntz")
    assert df.select(days_since("2023-02-11", "t")).first()[0] == 0


def test_buyer_type_map_unmapped_is_null(spark):
    df = spark.createDataFrame([("New_Buyer",), ("Repeat",), ("Repeat_90D",), ("Zzz",), (None,)], "t string")
    assert [r[0] for r in df.select(buyer_type_label("t")).collect()] == [0, 1, 1, None, None]


def test_gender_net_map_keeps_fractions(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (0.5,)], "g double")
    assert [r[0] for r in df.select(gender_net_map("g")).collect()] == [0.0, 0.0, 1.0, 2.0, 0.5]


def test_segment_ordinal(spark):
    df = spark.createDataFrame([("Hibernating",), ("Highly Engaged",), ("HOUSEHOLD",)], "s string")
    assert [r[0] for r in df.select(ordinal_segment("s")).collect()] == [0, 10, None]


def test_swap_binary(spark):
    df = spark.createDataFrame([(0,), (1,)], "t int")
    assert [r[0] for r in df.select(swap_binary("t")).collect()] == [1, 0]


def test_key_hash_is_stable_under_repartitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r[0]: (r[1], r[2]) for r in df.repartition(1).select("k", key_fraction("k", 42), key_bit("k", 7)).collect()}
    b = {r[0]: (r[1], r[2]) for r in df.repartition(8).select("k", key_fraction("k", 42), key_bit("k", 7)).collect()}
    assert a == b
    assert all(0.0 <= v[0] < 1.0 for v in a.values())
    assert 400 < sum(v[1] for v in a.values()) < 600


def test_safe_ratio_expression_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (0.0, 0.0, 1.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(safe_ratio_expr("a/(a+b) + c/(b+c)")).collect()]
    assert got == [2.0, None]


def test_threshold_grid_matches_arange(spark):
    import numpy as np
    got = [r[1] for r in threshold_grid(spark).orderBy("t_idx").collect()]
    assert got == list(np.arange(0, 1, 0.001))


def test_label_at(spark):
    df = spark.createDataFrame([(0.49,), (0.5,)], "p double")
    assert [r[0] for r in df.select(label_at("p", 0.5)).collect()] == [0, 1]
