"""Explicit logical schemas (no inference), from the reference's column lists."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, D, I, TS = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()


def struct(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Names and order of the required purchase columns.
PURCHASES = struct([
    ("ID_PRODUCT", L), ("ID_ORDER", L), ("ID_CATEGORY", S), ("ID_SUBCATEGORY", S),
    ("ID_CONDITION", I), ("ID_BRAND", S), ("UNIVERSE", S), ("DEPOSIT_PRICE", D),
    ("PRICE_SOLD_GMV", D), ("NB_ITEMS", L), ("DISCOUNT_AMOUNT_GMV", D), ("DATE_SOLD", TS),
    ("DATE_PUBLISHED", TS), ("ID_PAYMENT_TYPE", S), ("ID_BUYER", L), ("RANK_BUYER", L),
    ("RANK_WITHIN_SEGMENT", L), ("ID_SEGMENT", S), ("LOVED", I), ("ORDER_VALUE_RANGE", S),
    ("BUYER_FEE_GMV", D), ("ORDER_MARKETING_CHANNEL", S), ("MMAO_PRICE_DROP", D),
    ("VOUCHER_REVENUE", D), ("BUYER_TYPE", S), ("FLAG_FRAUD", I), ("ID_GENDER", I),
    ("DATE_NEW_BUYER", TS), ("DATE_CREATION", TS), ("DATE_LAST_LOGIN", TS), ("INACTIVE", I),
    ("NB_SOLD", L), ("VALUE_SOLD", D), ("NB_PUBLISHED", L), ("VALUE_PUBLISHED", D),
    ("NB_PURCHASED", L), ("VALUE_PURCHASED", D), ("NL_REACTIVITY_GROUP", S),
    ("ID_RFM_BUYER", S), ("RFM_BUYER", S), ("USER_SEGMENT", S), ("DATE_LAST_PURCHASE", TS),
    ("DATE_FIRST_PURCHASE", TS), ("BUYER_SEGMENT", S),
])

OFFERS = struct([("ID_BUYER", L), ("NB_TOTAL_OFFERS", L)])

LIKES = struct([
    ("ID_BUYER", L), ("ID_LIKE", L), ("DATE_LIKED", TS), ("MMAO_NB", L), ("LIKES", L),
    ("WISHES", L), ("ID_PRODUCT", L), ("ID_CATEGORY", S), ("COMMISSION", D),
])

COMMENTS = struct([
    ("ID_BUYER", L), ("ID_COMMENT", L), ("DATE_COMMENT", TS), ("NB_LIKES", L),
    ("NBWISH", L), ("ID_PRODUCT", L), ("ID_CATEGORY", S), ("COMMISSION", D),
])

SCORED = struct([("ID_BUYER", L), ("label", I), ("score", D), ("prediction", I)])

SCORES_REPORT = struct([("ID_BUYER", L), ("Composite_Score", D)])

PREDICTIONS = struct([("ID_BUYER", L), ("prediction", D)])
