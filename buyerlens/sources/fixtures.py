"""Logical input tables built from the driver's TPC-H-like tables.

The reference reads four warehouse exports (purchases, offers, likes,
comments).  The driver ships other tables, so each logical table is a view
over them.  Every view has a Spark builder and a DuckDB SQL text with the same
definition; the oracle queries prepend the SQL text as CTEs.

Mapping (one purchase row per lineitem):

* purchases: lineitem x orders x part x customer, buyer = o_custkey
* offers:    events of type 'click'
* likes:     events of type 'view'
* comments:  events of type 'error'
* scored:    one row per buyer of the buyer table with a fixed md5-derived score
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from buyerlens.functions.hashing import key_fraction
from buyerlens.sources.tables import read_table

# Segment names used for c_mktsegment; HOUSEHOLD keeps its raw value, which the
# ordinal encoder later maps to NULL.
MKT_SEGMENT_MAP = {
    "AUTOMOBILE": "Hibernating",
    "BUILDING": "At Risk",
    "FURNITURE": "New Customer",
    "MACHINERY": "Highly Engaged",
}

# Constant fills for columns that have no stand-in; all are dropped before
# modelling, but they must be non-null to survive the any-null row drop.
CONST_LONG = ["RANK_BUYER", "RANK_WITHIN_SEGMENT", "NB_SOLD", "NB_PURCHASED"]
CONST_INT = ["LOVED", "FLAG_FRAUD"]
CONST_STRING = ["ID_SEGMENT", "ORDER_VALUE_RANGE", "NL_REACTIVITY_GROUP", "ID_RFM_BUYER",
                "RFM_BUYER", "BUYER_SEGMENT", "UNIVERSE"]
CONST_DOUBLE = ["VALUE_PUBLISHED"]

SCORE_SEED = 42


def _json_k(col: str = "props"):
    return F.get_json_object(F.col(col), "$.k").cast("long")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")

    lo = li.join(orders, li.l_orderkey == orders.o_orderkey)
    # Buyer-level dates: aggregate then join back (no per-buyer window, which
    # would put a hot buyer's rows into one task).  The latest ship date per
    # buyer is the latest of its orders' latest ship dates, so lineitem is
    # reduced per order first and only the order-sized result meets orders;
    # the inner join keeps exactly the orders that have lineitems.
    per_order = li.groupBy(F.col("l_orderkey").alias("po_orderkey")).agg(
        F.max("l_shipdate").alias("po_ship"))
    buyer = (per_order.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"),
                            F.col("po_orderkey") == F.col("o_orderkey"))
             .groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("first_order"),
                  F.max("o_orderdate").alias("last_order"),
                  F.max("po_ship").alias("last_ship"))
             .join(cust, F.col("o_custkey") == F.col("c_custkey"))
             .drop("o_custkey"))
    seg = F.create_map(*[F.lit(x) for kv in MKT_SEGMENT_MAP.items() for x in kv])
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = (lo.join(part, lo.l_partkey == part.p_partkey)
            .join(buyer, F.col("o_custkey") == F.col("c_custkey")))
    cols = [
        F.col("l_partkey").alias("ID_PRODUCT"),
        F.col("l_orderkey").alias("ID_ORDER"),
        F.col("p_type").alias("ID_CATEGORY"),
        F.col("p_size").cast("string").alias("ID_SUBCATEGORY"),
        F.col("l_linenumber").alias("ID_CONDITION"),
        F.col("p_brand").alias("ID_BRAND"),
        F.col("p_retailprice").alias("DEPOSIT_PRICE"),
        F.col("l_extendedprice").alias("PRICE_SOLD_GMV"),
        F.col("l_quantity").cast("long").alias("NB_ITEMS"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("DISCOUNT_AMOUNT_GMV"),
        F.col("l_shipdate").alias("DATE_SOLD"),
        F.col("o_orderdate").alias("DATE_PUBLISHED"),
        F.col("o_orderpriority").alias("ID_PAYMENT_TYPE"),
        F.col("o_custkey").alias("ID_BUYER"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("BUYER_FEE_GMV"),
        F.col("l_returnflag").alias("ORDER_MARKETING_CHANNEL"),
        (F.col("p_retailprice") - F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")))
        .alias("MMAO_PRICE_DROP"),
        (F.col("l_extendedprice") * F.col("l_discount") * F.lit(0.5)).alias("VOUCHER_REVENUE"),
        F.when(urgent & (F.col("o_orderstatus") == "F"), F.lit("Repeat"))
        .when(urgent, F.lit("Repeat_90D")).otherwise(F.lit("New_Buyer")).alias("BUYER_TYPE"),
        (F.col("l_linenumber") % 4).alias("ID_GENDER"),
        F.col("first_order").alias("DATE_NEW_BUYER"),
        F.timestamp_add("DAY", -(F.col("c_custkey") % 90), F.col("first_order"))
        .alias("DATE_CREATION"),
        F.col("last_ship").alias("DATE_LAST_LOGIN"),
        (F.col("c_acctbal") < 0).cast("int").alias("INACTIVE"),
        F.col("c_acctbal").alias("VALUE_SOLD"),
        F.col("c_nationkey").cast("long").alias("NB_PUBLISHED"),
        F.col("o_totalprice").alias("VALUE_PURCHASED"),
        F.coalesce(F.try_element_at(seg, F.col("c_mktsegment")), F.col("c_mktsegment"))
        .alias("USER_SEGMENT"),
        F.col("last_order").alias("DATE_LAST_PURCHASE"),
        F.col("first_order").alias("DATE_FIRST_PURCHASE"),
    ]
    cols += [F.lit(0).cast("long").alias(c) for c in CONST_LONG]
    cols += [F.lit(0).cast("int").alias(c) for c in CONST_INT]
    cols += [F.lit("NA").alias(c) for c in CONST_STRING]
    cols += [F.lit(0.0).alias(c) for c in CONST_DOUBLE]
    return rows.select(*cols)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return (ev.where(F.col("event_type") == "click")
            .select(F.col("user_id").alias("ID_BUYER"), _json_k().alias("NB_TOTAL_OFFERS")))


def likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    k = _json_k()
    return (ev.where(F.col("event_type") == "view")
            .select(F.col("user_id").alias("ID_BUYER"),
                    F.col("event_id").alias("ID_LIKE"),
                    F.col("ts").alias("DATE_LIKED"),
                    (k % 5).alias("MMAO_NB"),
                    k.alias("LIKES"),
                    (k % 3).alias("WISHES"),
                    (F.col("event_id") % 200).alias("ID_PRODUCT"),
                    (F.col("event_id") % 7).cast("string").alias("ID_CATEGORY"),
                    F.col("value").alias("COMMISSION")))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    k = _json_k()
    return (ev.where(F.col("event_type") == "error")
            .select(F.col("user_id").alias("ID_BUYER"),
                    F.col("event_id").alias("ID_COMMENT"),
                    F.col("ts").alias("DATE_COMMENT"),
                    k.alias("NB_LIKES"),
                    (k % 3).alias("NBWISH"),
                    (F.col("event_id") % 200).alias("ID_PRODUCT"),
                    (F.col("event_id") % 7).cast("string").alias("ID_CATEGORY"),
                    F.col("value").alias("COMMISSION")))


# ---------------------------------------------------------------------------
# DuckDB text of the same views (used only by the oracle queries).
# ---------------------------------------------------------------------------

def _seg_case() -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MKT_SEGMENT_MAP.items())
    return f"CASE c_mktsegment {whens} ELSE c_mktsegment END"


def _const_sql() -> str:
    parts = [f"CAST(0 AS BIGINT) AS {c}" for c in CONST_LONG]
    parts += [f"CAST(0 AS INTEGER) AS {c}" for c in CONST_INT]
    parts += [f"'NA' AS {c}" for c in CONST_STRING]
    parts += [f"CAST(0.0 AS DOUBLE) AS {c}" for c in CONST_DOUBLE]
    return ",\n       ".join(parts)


SQL_JSON_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

SQL_VIEWS = {
    "lo_": """SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "buyer_dates_": """SELECT o_custkey AS b_custkey, min(o_orderdate) AS first_order,
       max(o_orderdate) AS last_order, max(l_shipdate) AS last_ship
FROM lo_ GROUP BY o_custkey""",
    "purchases": f"""SELECT l_partkey AS ID_PRODUCT, l_orderkey AS ID_ORDER, p_type AS ID_CATEGORY,
       CAST(p_size AS VARCHAR) AS ID_SUBCATEGORY, l_linenumber AS ID_CONDITION,
       p_brand AS ID_BRAND, p_retailprice AS DEPOSIT_PRICE, l_extendedprice AS PRICE_SOLD_GMV,
       CAST(l_quantity AS BIGINT) AS NB_ITEMS, l_extendedprice * l_discount AS DISCOUNT_AMOUNT_GMV,
       l_shipdate AS DATE_SOLD, o_orderdate AS DATE_PUBLISHED, o_orderpriority AS ID_PAYMENT_TYPE,
       o_custkey AS ID_BUYER, l_extendedprice * l_tax AS BUYER_FEE_GMV,
       l_returnflag AS ORDER_MARKETING_CHANNEL,
       p_retailprice - CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS MMAO_PRICE_DROP,
       l_extendedprice * l_discount * 0.5 AS VOUCHER_REVENUE,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'Repeat'
            WHEN o_orderpriority = '1-URGENT' THEN 'Repeat_90D' ELSE 'New_Buyer' END AS BUYER_TYPE,
       l_linenumber % 4 AS ID_GENDER, first_order AS DATE_NEW_BUYER,
       first_order - to_days(CAST(c_custkey % 90 AS INTEGER)) AS DATE_CREATION,
       last_ship AS DATE_LAST_LOGIN, CAST(c_acctbal < 0 AS INTEGER) AS INACTIVE,
       c_acctbal AS VALUE_SOLD, CAST(c_nationkey AS BIGINT) AS NB_PUBLISHED,
       o_totalprice AS VALUE_PURCHASED, {_seg_case()} AS USER_SEGMENT,
       last_order AS DATE_LAST_PURCHASE, first_order AS DATE_FIRST_PURCHASE,
       {_const_sql()}
FROM lo_ JOIN part ON l_partkey = p_partkey
JOIN buyer_dates_ ON o_custkey = b_custkey
JOIN customer ON b_custkey = c_custkey""",
    "offers": f"""SELECT user_id AS ID_BUYER, {SQL_JSON_K} AS NB_TOTAL_OFFERS
FROM events WHERE event_type = 'click'""",
    "likes": f"""SELECT user_id AS ID_BUYER, event_id AS ID_LIKE, ts AS DATE_LIKED,
       {SQL_JSON_K} % 5 AS MMAO_NB, {SQL_JSON_K} AS LIKES, {SQL_JSON_K} % 3 AS WISHES,
       event_id % 200 AS ID_PRODUCT, CAST(event_id % 7 AS VARCHAR) AS ID_CATEGORY,
       value AS COMMISSION
FROM events WHERE event_type = 'view'""",
    "comments": f"""SELECT user_id AS ID_BUYER, event_id AS ID_COMMENT, ts AS DATE_COMMENT,
       {SQL_JSON_K} AS NB_LIKES, {SQL_JSON_K} % 3 AS NBWISH,
       event_id % 200 AS ID_PRODUCT, CAST(event_id % 7 AS VARCHAR) AS ID_CATEGORY,
       value AS COMMISSION
FROM events WHERE event_type = 'error'""",
}

# Which base views each logical view needs, in dependency order.
SQL_DEPENDS = {
    "purchases": ["lo_", "buyer_dates_", "purchases"],
    "offers": ["offers"],
    "likes": ["likes"],
    "comments": ["comments"],
}


def sql_key_fraction(key: str, seed: int = SCORE_SEED) -> str:
    return (f"(CAST(('0x' || substr(md5(concat(CAST({key} AS VARCHAR), '|', '{seed}')), 1, 8)) "
            f"AS BIGINT) / 4294967296.0)")


def sql_key_hash32(key: str, seed) -> str:
    return (f"CAST(('0x' || substr(md5(concat(CAST({key} AS VARCHAR), '|', '{seed}')), 1, 8)) "
            f"AS BIGINT)")


def with_views(names, body_ctes: list[tuple[str, str]] | None = None, final: str = "") -> str:
    """Build ``WITH v1 AS (...), ... <final>`` from fixture views and extra CTEs."""
    order: list[str] = []
    for n in names:
        for dep in SQL_DEPENDS[n]:
            if dep not in order:
                order.append(dep)
    ctes = [(n, SQL_VIEWS[n]) for n in order] + list(body_ctes or [])
    text = ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in ctes)
    return f"WITH {text}\n{final}"
