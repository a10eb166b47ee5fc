"""Physical-plan guards for the scale design: the per-buyer build and the
Qini curve never funnel rows through a global window or a cartesian product,
and filters reach the parquet scans."""

import re

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from buyerlens.operators.clean import SchemaContractError
from buyerlens.plans import buyer_features as bf
from buyerlens.sources import fixtures as fx


def _plan(spark, name, sf):
    df = entry.queries()[name](spark, sf)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["D1_purchase_features", "D2_likes_features",
                                  "D3_comments_features", "D4_buyer_table"])
def test_buyer_build_has_no_window(spark, sf001, name):
    plan = _plan(spark, name, sf001)
    assert "Window" not in plan
    assert "CartesianProduct" not in plan


def test_qini_uses_no_window(spark, sf001):
    plan = _plan(spark, "L6_qini_curve", sf001)
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_event_filters_are_pushed_down(spark, sf001):
    plan = _plan(spark, "D2_likes_features", sf001)
    pushed = re.findall(r"PushedFilters: \[[^\]]*\]", plan)
    assert pushed and all("EqualTo(event_type,view)" in f for f in pushed)


def _sparse(df, column, share):
    """The table with ``column`` NULL in that share of its rows, by a hash of the row."""
    cut = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1000)) >= int(share * 1000)
    return df.withColumn(column, F.when(cut, F.col(column)))


def test_null_contract_is_observed_while_the_reduction_is_stored(spark, sf001):
    likes, comments, offers, purchases = (f(spark, sf001) for f in (fx.likes, fx.comments, fx.offers, fx.purchases))
    want = sorted(map(tuple, bf.likes_features(likes).collect()))
    got = bf.likes_features(likes, check_contract=True)
    assert sorted(map(tuple, got.collect())) == want
    assert "event_type" not in got._jdf.queryExecution().executedPlan().toString()  # the events are not read again
    with pytest.raises(SchemaContractError, match="COMMISSION"):
        bf.likes_features(_sparse(likes, "COMMISSION", 0.3), check_contract=True)
    with pytest.raises(SchemaContractError, match="COMMISSION"):
        bf.comments_features(_sparse(comments, "COMMISSION", 0.35), check_contract=True)
    bf.comments_features(_sparse(comments, "COMMISSION", 0.05), check_contract=True)
    with pytest.raises(SchemaContractError, match="ID_BRAND"):
        bf.purchase_features(_sparse(purchases, "ID_BRAND", 0.4), offers)
    with pytest.raises(SchemaContractError, match="missing"):
        bf.purchase_features(purchases.drop("ID_BRAND"), offers)


def test_purchases_are_read_once(spark, sf001):
    plan = _plan(spark, "D1_purchase_features", sf001)
    assert "lineitem" not in plan and plan.count("ReadSchema") <= 4
