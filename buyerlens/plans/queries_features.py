"""Registered queries for the buyer feature build (D1-D4) and their oracles."""

from __future__ import annotations

from buyerlens import params
from buyerlens.operators.aggregate import sql_exact_mean
from buyerlens.plans import buyer_features as bf
from buyerlens.plans.registry import register
from buyerlens.sources import fixtures as fx

CUT = params.FIXTURE_CUTOFF
DAY_US = "86400000000.0"


def sql_floor_days(end: str, start: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / {DAY_US}) AS BIGINT)"


# ----------------------------------------------------------------------------
# SQL builders: each returns CTEs ending in a CTE named ``out``.
# ----------------------------------------------------------------------------

def activity_ctes(view: str, spec: bf.ActivitySpec, out: str, cutoff: str = CUT):
    sums = ",\n  ".join(f"CAST(COALESCE(SUM({s}), 0) AS BIGINT) AS {o}" for o, s in spec.sums.items())
    dist = ",\n  ".join(f"COUNT(DISTINCT {s}) AS {o}" for o, s in spec.distincts.items())
    agg = f"""SELECT ID_BUYER,
  {sums},
  {dist},
  {sql_exact_mean(spec.mean_in)} AS {spec.mean_out},
  MAX({spec.date_col}) AS {spec.last_date},
  COUNT(*) FILTER (WHERE {spec.date_col} >= TIMESTAMP '{cutoff}') AS {spec.frequency}
FROM {view} WHERE ID_BUYER IS NOT NULL GROUP BY ID_BUYER"""
    cols = ", ".join(["a.ID_BUYER"] + [f"a.{c}" for c in list(spec.sums) + list(spec.distincts)]
                     + [f"a.{spec.mean_out}", f"a.{spec.last_date}"])
    fin = f"""SELECT {cols},
  {sql_floor_days('m.mx', 'a.' + spec.last_date)} AS {spec.recency}, a.{spec.frequency}
FROM {out}_agg a CROSS JOIN (SELECT max({spec.last_date}) AS mx FROM {out}_agg) m"""
    return [(f"{out}_agg", agg), (out, fin)]


def purchase_ctes(out: str = "d1"):
    keep = [c for c in bf.PURCHASE_COLUMNS
            if c not in ("BUYER_TYPE", "VALUE_PURCHASED", "VALUE_SOLD", "VALUE_PUBLISHED")]
    all_cols = keep + ["REPEATER", "CLTV", "NB_OFFERS", "AVG_OFFERS"]
    ctes = [
        (f"{out}_offers", """SELECT ID_BUYER, CAST(COALESCE(SUM(NB_TOTAL_OFFERS), 0) AS DOUBLE) AS NB_OFFERS,
       (CAST(SUM(NB_TOTAL_OFFERS) AS DOUBLE) / COUNT(NB_TOTAL_OFFERS)) AS AVG_OFFERS
FROM offers WHERE ID_BUYER IS NOT NULL GROUP BY ID_BUYER"""),
        (f"{out}_rows", f"""SELECT {', '.join('p.' + c for c in keep)},
       CASE p.BUYER_TYPE WHEN 'New_Buyer' THEN 0 WHEN 'Repeat' THEN 1 WHEN 'Repeat_90D' THEN 1 END AS REPEATER,
       p.VALUE_PURCHASED + p.VALUE_SOLD AS CLTV,
       COALESCE(o.NB_OFFERS, 0.0) AS NB_OFFERS, COALESCE(o.AVG_OFFERS, 0.0) AS AVG_OFFERS
FROM purchases p LEFT JOIN {out}_offers o ON p.ID_BUYER = o.ID_BUYER
WHERE p.ID_BUYER IS NOT NULL"""),
        (f"{out}_clean", f"""SELECT *, {sql_floor_days('DATE_SOLD', 'DATE_PUBLISHED')} AS NB_DAYS_ONLINE
FROM {out}_rows WHERE {' AND '.join(c + ' IS NOT NULL' for c in all_cols)}"""),
    ]
    for c in bf.MODE_COLUMNS:
        ctes.append((f"{out}_m_{c}", f"""SELECT ID_BUYER, v AS {c} FROM (
  SELECT ID_BUYER, CAST({c} AS VARCHAR) AS v,
         row_number() OVER (PARTITION BY ID_BUYER ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rn
  FROM {out}_clean GROUP BY ID_BUYER, {c}) WHERE rn = 1"""))
    order = ", ".join(bf.FIRST_ORDER + bf.FIRST_COLUMNS)
    ctes.append((f"{out}_first", f"""SELECT * EXCLUDE (rn) FROM (
  SELECT ID_BUYER, {', '.join(bf.FIRST_COLUMNS)},
         row_number() OVER (PARTITION BY ID_BUYER ORDER BY {order}) AS rn
  FROM {out}_clean) WHERE rn = 1"""))
    means = ", ".join(f"{sql_exact_mean(c)} AS {c}" for c in bf.MEAN_COLUMNS if c != "ID_GENDER")
    g = sql_exact_mean("ID_GENDER")
    ctes.append((f"{out}_means", f"""SELECT ID_BUYER, {means},
       CASE WHEN {g} = 0 THEN 0.0 WHEN {g} = 1 THEN 0.0
            WHEN {g} = 2 THEN 1.0 WHEN {g} = 3 THEN 2.0
            ELSE {g} END AS ID_GENDER,
       max(REPEATER) AS REPEATER
FROM {out}_clean GROUP BY ID_BUYER"""))
    joins = " ".join(f"JOIN {out}_m_{c} USING (ID_BUYER)" for c in bf.MODE_COLUMNS)
    sel = ", ".join([f"{out}_means.ID_BUYER"] + bf.MODE_COLUMNS + bf.MEAN_COLUMNS + ["REPEATER"]
                    + bf.FIRST_COLUMNS)
    ctes.append((out, f"""SELECT {sel}
FROM {out}_means JOIN {out}_first USING (ID_BUYER) {joins}"""))
    return ctes


def buyer_table_ctes(out: str = "d4"):
    ctes = (purchase_ctes("d1") + activity_ctes("likes", bf.LIKES_SPEC, "d2")
            + activity_ctes("comments", bf.COMMENTS_SPEC, "d3"))
    d2 = [c for c in ["ID_BUYER"] + _activity_cols(bf.LIKES_SPEC) if c != "ID_BUYER"]
    d3 = [c for c in ["ID_BUYER"] + _activity_cols(bf.COMMENTS_SPEC) if c != "ID_BUYER"]
    ctes.append((out, f"""SELECT d1.*, {', '.join('d2.' + c for c in d2)}, {', '.join('d3.' + c for c in d3)}
FROM d1 LEFT JOIN d2 ON d1.ID_BUYER = d2.ID_BUYER LEFT JOIN d3 ON d1.ID_BUYER = d3.ID_BUYER"""))
    return ctes


def _activity_cols(spec: bf.ActivitySpec) -> list[str]:
    return (list(spec.sums) + list(spec.distincts)
            + [spec.mean_out, spec.last_date, spec.recency, spec.frequency])


D1_DOUBLES = bf.MEAN_COLUMNS + ["CLTV", "NB_OFFERS", "AVG_OFFERS"]
D4_DOUBLES = D1_DOUBLES + [bf.LIKES_SPEC.mean_out, bf.COMMENTS_SPEC.mean_out]


# ----------------------------------------------------------------------------
# Spark side
# ----------------------------------------------------------------------------

def buyer_table(spark, sf_dir, cutoff: str = CUT):
    return bf.buyer_table(fx.purchases(spark, sf_dir), fx.offers(spark, sf_dir),
                          fx.likes(spark, sf_dir), fx.comments(spark, sf_dir), cutoff)


@register("D2_likes_features",
          sql=fx.with_views(["likes"], activity_ctes("likes", bf.LIKES_SPEC, "d2"),
                            "SELECT * FROM d2"),
          )
def q_d2(spark, sf_dir):
    return bf.likes_features(fx.likes(spark, sf_dir), CUT)


@register("D3_comments_features",
          sql=fx.with_views(["comments"], activity_ctes("comments", bf.COMMENTS_SPEC, "d3"),
                            "SELECT * FROM d3"),
          )
def q_d3(spark, sf_dir):
    return bf.comments_features(fx.comments(spark, sf_dir), CUT)


@register("D1_purchase_features",
          sql=fx.with_views(["purchases", "offers"], purchase_ctes("d1"), "SELECT * FROM d1"),
          )
def q_d1(spark, sf_dir):
    return bf.purchase_features(fx.purchases(spark, sf_dir), fx.offers(spark, sf_dir))


@register("D4_buyer_table",
          sql=fx.with_views(["purchases", "offers", "likes", "comments"], buyer_table_ctes("d4"),
                            "SELECT * FROM d4"),
          )
def q_d4(spark, sf_dir):
    return buyer_table(spark, sf_dir)


# ----------------------------------------------------------------------------
# Single operators on the fixture views
# ----------------------------------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from buyerlens.functions.dates import floor_days_between  # noqa: E402
from buyerlens.operators.aggregate import group_first, group_mode, sum0, transform_by_group  # noqa: E402
from buyerlens.operators.clean import activity_since  # noqa: E402


@register("W1_group_transform", sql=fx.with_views(["likes"], [], """
SELECT ID_LIKE, ID_BUYER, LIKES,
       CAST(COALESCE(SUM(LIKES) OVER (PARTITION BY ID_BUYER), 0) AS BIGINT) AS Total_likes
FROM likes WHERE ID_BUYER IS NOT NULL"""))
def q_w1(spark, sf_dir):
    lk = fx.likes(spark, sf_dir).where(F.col("ID_BUYER").isNotNull())
    return (transform_by_group(lk.select("ID_LIKE", "ID_BUYER", "LIKES"), "ID_BUYER",
                               {"Total_likes": sum0("LIKES")}))


@register("P8_activity_filter", sql=fx.with_views(["likes"], [], f"""
SELECT ID_LIKE, ID_BUYER, DATE_LIKED FROM likes
WHERE DATE_LIKED IS NULL OR DATE_LIKED >= TIMESTAMP '{CUT}'"""))
def q_p8(spark, sf_dir):
    return activity_since(fx.likes(spark, sf_dir), "DATE_LIKED", CUT).select(
        "ID_LIKE", "ID_BUYER", "DATE_LIKED")


@register("F5_days_online", sql=fx.with_views(["purchases"], [], f"""
SELECT ID_ORDER, ID_PRODUCT, DATE_SOLD, DATE_PUBLISHED,
       {sql_floor_days('DATE_SOLD', 'DATE_PUBLISHED')} AS NB_DAYS_ONLINE FROM purchases"""))
def q_f5(spark, sf_dir):
    p = fx.purchases(spark, sf_dir)
    return p.select("ID_ORDER", "ID_PRODUCT", "DATE_SOLD", "DATE_PUBLISHED",
                    floor_days_between("DATE_SOLD", "DATE_PUBLISHED").alias("NB_DAYS_ONLINE"))


def _mode_sql():
    ctes = [("m_buyers", "SELECT DISTINCT ID_BUYER FROM purchases WHERE ID_BUYER IS NOT NULL")]
    for c in bf.MODE_COLUMNS:
        ctes.append((f"m_{c}", f"""SELECT ID_BUYER, v AS {c} FROM (
  SELECT ID_BUYER, CAST({c} AS VARCHAR) AS v,
         row_number() OVER (PARTITION BY ID_BUYER ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rn
  FROM purchases WHERE ID_BUYER IS NOT NULL AND {c} IS NOT NULL GROUP BY ID_BUYER, {c}) WHERE rn = 1"""))
    joins = " ".join(f"LEFT JOIN m_{c} USING (ID_BUYER)" for c in bf.MODE_COLUMNS)
    return fx.with_views(["purchases"], ctes,
                         f"SELECT ID_BUYER, {', '.join(bf.MODE_COLUMNS)} FROM m_buyers {joins}")


@register("A6_group_mode", sql=_mode_sql())
def q_a6(spark, sf_dir):
    p = fx.purchases(spark, sf_dir).where(F.col("ID_BUYER").isNotNull())
    return group_mode(p, "ID_BUYER", bf.MODE_COLUMNS)


A7_VALUES = ["PRICE_SOLD_GMV", "ID_BRAND", "NB_ITEMS"]


@register("A7_first_row", sql=fx.with_views(["purchases"], [], f"""
SELECT ID_BUYER, {', '.join(A7_VALUES)} FROM (
  SELECT *, row_number() OVER (PARTITION BY ID_BUYER
                               ORDER BY {', '.join(bf.FIRST_ORDER + A7_VALUES)}) AS rn
  FROM purchases WHERE ID_BUYER IS NOT NULL) WHERE rn = 1"""))
def q_a7(spark, sf_dir):
    p = fx.purchases(spark, sf_dir).where(F.col("ID_BUYER").isNotNull())
    return group_first(p, "ID_BUYER", bf.FIRST_ORDER, A7_VALUES)
