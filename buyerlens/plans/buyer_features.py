"""Raw tables to one row per buyer.

Shuffle budget at scale (all keyed on ID_BUYER):

* D1: one aggregate of the purchase rows counts for the null contract and makes
  the means and the maximum, the first row and the modes; its result is stored, one
  row per buyer.  Offers are pre-aggregated per buyer and joined to it.
* D2/D3: one ``groupBy(ID_BUYER)`` each; the table-wide latest date is a
  one-row aggregate broadcast back.
* The null-ratio contract of likes and comments is one aggregate of its own; each
  contract fails before anything is built on its table's reduction.
* D4: two left joins of tables that are already hash-partitioned by
  ID_BUYER; AQE broadcasts a side at runtime only when its measured size is
  under the broadcast threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from buyerlens import params
from buyerlens.functions.dates import floor_days_between
from buyerlens.functions.maps import buyer_type_label, gender_net_map
from buyerlens.operators.aggregate import exact_mean, exact_sum, first_struct, mode_value, sum0
from buyerlens.operators.clean import check_dense, observe_dense, select_required, whole_row
from buyerlens.session import materialize
from buyerlens.sources.schemas import PURCHASES

PURCHASE_COLUMNS = PURCHASES.names

MODE_COLUMNS, MEAN_COLUMNS = params.MODE_COLUMNS, params.MEAN_COLUMNS
# Columns taken from the first row of each buyer (buyer-level attributes and
# per-row values the reference keeps through ``first()``).
FIRST_COLUMNS = [
    "RANK_BUYER", "RANK_WITHIN_SEGMENT", "ID_SEGMENT", "ORDER_VALUE_RANGE", "DATE_NEW_BUYER",
    "DATE_CREATION", "DATE_LAST_LOGIN", "INACTIVE", "NB_SOLD", "NB_PUBLISHED", "NB_PURCHASED",
    "NL_REACTIVITY_GROUP", "ID_RFM_BUYER", "RFM_BUYER", "USER_SEGMENT", "DATE_LAST_PURCHASE",
    "DATE_FIRST_PURCHASE", "BUYER_SEGMENT", "CLTV", "NB_OFFERS", "AVG_OFFERS", "NB_DAYS_ONLINE",
]
# Total order that defines "first row": sale date, order, product, then values.
FIRST_ORDER = ["DATE_SOLD", "ID_ORDER", "ID_PRODUCT"]


def offers_per_buyer(offers: DataFrame) -> DataFrame:
    """Per-buyer offer totals and means (W1 + A9 in the reference, one agg here)."""
    return (offers.where(F.col("ID_BUYER").isNotNull()).groupBy("ID_BUYER")
            .agg(sum0("NB_TOTAL_OFFERS").cast("double").alias("NB_OFFERS"),
                 exact_mean("NB_TOTAL_OFFERS").alias("AVG_OFFERS")))


# Per-buyer offer columns: constant within a buyer and NULL-free after the
# fill, so they never decide which rows the any-NULL drop removes.
OFFER_COLUMNS = ["NB_OFFERS", "AVG_OFFERS"]
ROW_FIRST_COLUMNS = [c for c in FIRST_COLUMNS if c not in OFFER_COLUMNS]


def _labelled(purchases: DataFrame, *more: str) -> DataFrame:
    df = purchases.select(*PURCHASE_COLUMNS, *more)
    return (df.withColumn("REPEATER", buyer_type_label("BUYER_TYPE"))
            .withColumn("CLTV", F.col("VALUE_PURCHASED") + F.col("VALUE_SOLD"))
            .drop("BUYER_TYPE", "VALUE_PURCHASED", "VALUE_SOLD", "VALUE_PUBLISHED"))


def purchase_rows(purchases: DataFrame) -> DataFrame:
    """Row-level part of D1: labels, value, NULL-row drop, days online."""
    df = _labelled(purchases).na.drop(how="any")
    return df.withColumn("NB_DAYS_ONLINE", floor_days_between("DATE_SOLD", "DATE_PUBLISHED"))


def _marked_rows(purchases: DataFrame) -> DataFrame:
    """Every purchase row with ``__whole`` (no required column is NULL) and ``__row`` (``purchase_rows`` keeps it,
    so no value is NULL or NaN); all but the buyer is NULL in rows that it drops."""
    df = _labelled(purchases.withColumn("__whole", whole_row(PURCHASE_COLUMNS)), "__whole")
    names = [c for c in df.columns if c != "__whole"]
    kept = whole_row(names)
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            kept = kept & ~F.isnan(c)
    df = df.withColumn("__row", kept)
    df = df.select("ID_BUYER", "__whole", "__row", *[F.when(F.col("__row"), F.col(c)).alias(c) for c in names if c != "ID_BUYER"])
    return df.withColumn("NB_DAYS_ONLINE", floor_days_between("DATE_SOLD", "DATE_PUBLISHED"))


def _exact_total(df: DataFrame, c: str):
    """Exact sum of a column; whole numbers need no rounding to 10 decimals."""
    whole = {"int": "long", "bigint": "decimal(20,0)"}.get(dict(df.dtypes)[c])
    return F.sum(F.col(c).cast(whole)) if whole else exact_sum(c)


def purchase_features(purchases: DataFrame, offers: DataFrame,
                      check_contract: bool = True) -> DataFrame:
    """D1 ``data_processing_mmao_transac``: one row per buyer.

    One partially aggregated aggregate counts the rows for the null contract and
    makes all three reductions (means and maximum, modes, first row); its result,
    one row per buyer, is stored.

    The offers left join (J1) is applied to the per-buyer result rather than
    to every purchase row: the filled offer columns are constant per buyer
    and never NULL, so the result is the same, and a buyer with a huge share
    of the rows is reduced by map-side aggregation before any join or
    shuffle on the buyer key.
    """
    purchases = select_required(purchases, PURCHASE_COLUMNS)
    rows = _marked_rows(purchases)
    first = [f"__v_{c}" for c in ROW_FIRST_COLUMNS]
    # exact sums -> one conversion to double -> one division: the same bits under any partitioning
    buyer = rows.groupBy("ID_BUYER").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("__whole").alias("whole"), F.count_if("__row").alias("__rows"),
        *[(_exact_total(rows, c).cast("double") / F.nullif(F.count_if("__row"), F.lit(0))).alias(c) for c in MEAN_COLUMNS],
        *[mode_value(c).alias(c) for c in MODE_COLUMNS], F.max("REPEATER").alias("REPEATER"),
        first_struct(FIRST_ORDER, ROW_FIRST_COLUMNS, F.col("__row")).alias("__first"))
    buyer = materialize(buyer.select("ID_BUYER", "n", "whole", "__rows", *MEAN_COLUMNS, *MODE_COLUMNS, "REPEATER",
                                     *[F.col(f"__first.{c}").alias(c) for c in first]))
    if check_contract:
        check_dense(purchases, PURCHASE_COLUMNS, params.NULL_RATIO_PURCHASES, buyer)
    buyer = buyer.where("__rows > 0").withColumn("ID_GENDER", gender_net_map("ID_GENDER"))
    # as a left join on their keys the offers are pruned if a caller does not read them
    out = (buyer.withColumnsRenamed(dict(zip(first, ROW_FIRST_COLUMNS)))
           .join(offers_per_buyer(offers), "ID_BUYER", "left")
           .withColumn("NB_OFFERS", F.coalesce("NB_OFFERS", F.lit(0.0)))
           .withColumn("AVG_OFFERS", F.coalesce("AVG_OFFERS", F.lit(0.0))))
    return out.select("ID_BUYER", *MODE_COLUMNS, *MEAN_COLUMNS, "REPEATER", *FIRST_COLUMNS)


@dataclass(frozen=True)
class ActivitySpec:
    """Column map shared by the likes (D2) and comments (D3) feature builders."""
    date_col: str
    sums: dict = field(default_factory=dict)       # output -> input column
    distincts: dict = field(default_factory=dict)  # output -> input column
    mean_out: str = "Avg_commision"
    mean_in: str = "COMMISSION"
    last_date: str = "LastDate"
    recency: str = "Recency"
    frequency: str = "Frequency_12M"


LIKES_SPEC = ActivitySpec(
    date_col="DATE_LIKED",
    sums={"Total_likes": "LIKES", "Total_wishes": "WISHES", "Total_MMAO_NB": "MMAO_NB"},
    distincts={"NB_products_liked": "ID_PRODUCT", "NB_categories_liked": "ID_CATEGORY"},
    mean_out="Avg_commision_liked", last_date="LastLikeDate", recency="Recency_liked",
    frequency="Frequnecy_like_12M")

COMMENTS_SPEC = ActivitySpec(
    date_col="DATE_COMMENT",
    sums={"Total_nb_likes": "NB_LIKES", "Total_nb_wish": "NBWISH"},
    distincts={"NB_products_commented": "ID_PRODUCT",
               "NB_categories_commented": "ID_CATEGORY"},
    mean_out="Avg_commision_commented", last_date="LastCommentDate",
    recency="Recency_comment", frequency="Frequnecy_comment_12M")


def activity_features(events: DataFrame, spec: ActivitySpec, cutoff: str = params.ACTIVITY_CUTOFF,
                      ratio: float | None = None) -> DataFrame:
    """Totals, distinct counts, mean commission, last date, recency and
    count since the cutoff - one ``groupBy(ID_BUYER)``.

    Recency is measured against the latest activity date over all buyers
    (a one-row aggregate joined by broadcast).  A buyer with no dated row has
    a NULL last date and a NULL recency, as in pandas.  With ``ratio`` the columns
    that are read must be non-null in that share of the rows.
    """
    verify = None
    if ratio is not None:
        read = dict.fromkeys(["ID_BUYER", spec.date_col, *spec.sums.values(), *spec.distincts.values(), spec.mean_in])
        events, verify = observe_dense(events, list(read), ratio)
    d = F.col(spec.date_col)
    cut = F.to_timestamp_ntz(F.lit(cutoff))
    agg = (events.where(F.col("ID_BUYER").isNotNull()).groupBy("ID_BUYER").agg(
        *[sum0(src).alias(out) for out, src in spec.sums.items()],
        *[F.count_distinct(src).alias(out) for out, src in spec.distincts.items()],
        exact_mean(spec.mean_in).alias(spec.mean_out),
        F.max(d).alias(spec.last_date),
        F.count(F.when(d >= cut, F.lit(1))).alias(spec.frequency)))
    if verify:
        # stored once: the latest date needs no second aggregation
        agg = materialize(agg)
        verify()
        latest = agg.agg(F.max(spec.last_date).alias("__latest"))
    else:
        # The latest date over buyers equals the latest dated row of a keyed buyer:
        # a map-side max per task and a one-row merge, instead of re-running the
        # grouped aggregation for a single scalar.
        latest = (events.where(F.col("ID_BUYER").isNotNull())
                  .agg(F.max(d).alias("__latest")))
    out = agg.crossJoin(F.broadcast(latest)).withColumn(
        spec.recency, floor_days_between("__latest", spec.last_date)).drop("__latest")
    cols = (["ID_BUYER"] + list(spec.sums) + list(spec.distincts)
            + [spec.mean_out, spec.last_date, spec.recency, spec.frequency])
    return out.select(*cols)


def likes_features(likes: DataFrame, cutoff: str = params.ACTIVITY_CUTOFF, check_contract: bool = False) -> DataFrame:
    """D2 ``data_processing_likes``."""
    return activity_features(likes, LIKES_SPEC, cutoff, params.NULL_RATIO_LIKES if check_contract else None)


def comments_features(comments: DataFrame, cutoff: str = params.ACTIVITY_CUTOFF, check_contract: bool = False) -> DataFrame:
    """D3 ``data_preprocessing_comment``."""
    return activity_features(comments, COMMENTS_SPEC, cutoff, params.NULL_RATIO_COMMENTS if check_contract else None)


def merge_buyer_table(purchase_feats: DataFrame, likes_feats: DataFrame,
                      comments_feats: DataFrame) -> DataFrame:
    """D4 ``merge_dataframes``: purchases left join likes left join comments."""
    return (purchase_feats.join(likes_feats, "ID_BUYER", "left")
            .join(comments_feats, "ID_BUYER", "left"))


def buyer_table(purchases: DataFrame, offers: DataFrame, likes: DataFrame,
                comments: DataFrame, cutoff: str = params.ACTIVITY_CUTOFF) -> DataFrame:
    """D1 + D2 + D3 + D4."""
    return merge_buyer_table(purchase_features(purchases, offers),
                             likes_features(likes, cutoff, check_contract=True),
                             comments_features(comments, cutoff, check_contract=True))
