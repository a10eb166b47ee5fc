"""D1 stores the purchase rows once; every reduction reads only its columns of them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from buyerlens import params
from buyerlens.operators import clean as cl
from buyerlens.plans import buyer_features as bf
from buyerlens.sources import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unread_reductions_are_pruned(spark, sf001):
    d1 = bf.purchase_features(fx.purchases(spark, sf001), fx.offers(spark, sf001))
    plan = _plan(d1.select("ID_BUYER", "REPEATER"))
    assert "Join" not in plan and "decimal" not in plan and "explode" not in plan.lower()
    assert sorted(d1.select("ID_BUYER", "REPEATER").collect()) == sorted((r["ID_BUYER"], r["REPEATER"]) for r in d1.collect())


def test_first_row_modes_and_means_of_one_buyer(spark, sf001):
    purchases = fx.purchases(spark, sf001)
    rows = bf.purchase_rows(purchases).toPandas()
    got = bf.purchase_features(purchases, fx.offers(spark, sf001)).toPandas().set_index("ID_BUYER")
    assert set(got.index) == set(rows["ID_BUYER"])
    for buyer, own in list(rows.groupby("ID_BUYER"))[:20]:
        first = own.sort_values(bf.FIRST_ORDER + bf.ROW_FIRST_COLUMNS).iloc[0]
        assert all(got.loc[buyer, c] == first[c] for c in bf.ROW_FIRST_COLUMNS)
        for c in bf.MODE_COLUMNS:
            n = own[c].astype(str).value_counts()
            assert got.loc[buyer, c] == min(n[n == n.max()].index)
        for c in params.MEAN_COLUMNS:
            if c != "ID_GENDER":
                assert abs(got.loc[buyer, c] - own[c].mean()) < 1e-6


def test_whole_rows_decide_the_contract_before_columns_are_counted(spark, monkeypatch):
    df = spark.range(100).select("id", F.when(F.col("id") >= 10, F.col("id")).alias("a"), F.when(F.col("id") < 90, F.col("id")).alias("b"))
    cl.check_dense(df, ["id", "a", "b"], 0.85)  # 80 whole rows, 90 values in each column
    monkeypatch.setattr(cl, "dense_columns", lambda *_: (_ for _ in ()).throw(AssertionError("counted by column")))
    cl.check_dense(df, ["id", "a", "b"], 0.80)


def _builds(monkeypatch, spark, sf, name):
    """How often the query reduces the purchases."""
    calls, real = [], bf.purchase_features
    monkeypatch.setattr(bf, "purchase_features", lambda *a, **k: calls.append(1) or real(*a, **k))
    entry.queries()[name](spark, sf).collect()
    return len(calls)


def test_versions_and_running_value_reduce_the_purchases_once(spark, sf001, monkeypatch):
    assert _builds(monkeypatch, spark, sf001, "U3_compare_versions") == 1
    assert _builds(monkeypatch, spark, sf001, "W3_running_value") == 1


def test_sparse_columns_are_dropped_from_a_stored_table(spark, sf001):
    plan = _plan(entry.queries()["P3_drop_sparse_columns"](spark, sf001))
    assert "Join" not in plan and "Aggregate" not in plan


def _stored(monkeypatch):
    """What D1 stores, in the order it does."""
    kept, real = [], bf.materialize
    monkeypatch.setattr(bf, "materialize", lambda df: kept.append(df) or real(df))
    return kept


def test_one_aggregate_makes_all_reductions(spark, sf001, monkeypatch):
    kept = _stored(monkeypatch)
    d1 = bf.purchase_features(fx.purchases(spark, sf001), fx.offers(spark, sf001))
    assert kept[0].count() == d1.count()  # one row per buyer, not the purchase rows
    assert "Generate" not in _plan(kept[0])


def test_rows_with_nulls_or_nan_count_in_the_contract_only(spark, sf001):
    hole = lambda c, n, v: F.when(F.col("ID_ORDER") % 50 == n, v).otherwise(F.col(c))
    purchases = fx.purchases(spark, sf001).withColumn("ID_BRAND", hole("ID_BRAND", 1, F.lit(None))).withColumn(
        "PRICE_SOLD_GMV", hole("PRICE_SOLD_GMV", 2, F.lit(float("nan")))).withColumn("ID_BUYER", hole("ID_BUYER", 3, F.lit(None)))
    offers = fx.offers(spark, sf001)
    got = bf.purchase_features(purchases, offers).orderBy("ID_BUYER").collect()
    clean = purchases.where("ID_ORDER % 50 NOT IN (1, 2, 3)")
    assert got == bf.purchase_features(clean, offers).orderBy("ID_BUYER").collect()
    with pytest.raises(cl.SchemaContractError, match="ID_BRAND"):
        bf.purchase_features(purchases.withColumn("ID_BRAND", F.when(F.col("ID_ORDER") % 5 > 0, "b")), offers)
