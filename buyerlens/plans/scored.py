"""Model table (D5) and deterministic scored tables built on it.

Evaluation, composite scoring and uplift operators take score columns; here
those scores are fixed md5-derived fractions of the buyer key, so each
operator can be compared with SQL independently of any model fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buyerlens import params
from buyerlens.functions.hashing import key_fraction
from buyerlens.operators import uplift as up
from buyerlens.plans import model_table as mt
from buyerlens.plans.queries_features import buyer_table, buyer_table_ctes, sql_floor_days
from buyerlens.session import materialize
from buyerlens.sources import fixtures as fx

SNAP = params.FIXTURE_SNAPSHOT
CLASS_SALTS = ["cls0", "cls1", "cls2", "cls3"]


def model_table(spark, sf_dir, materialized: bool = True, columns=None) -> DataFrame:
    """D5 over the driver tables.  Most consumers read it from several
    branches (train/test, statistics and their application), so it is
    materialized once per query in the checkpoint directory; ``columns``
    names those a consumer reads, and only what they need is computed."""
    df = mt.model_table(buyer_table(spark, sf_dir), SNAP)
    if columns:
        df = df.select(*columns)
    return materialize(df) if materialized else df


def scored_binary(spark, sf_dir, m: DataFrame | None = None) -> DataFrame:
    """(ID_BUYER, label, score, prediction) over every buyer of the model table; ``m`` is one a caller has stored."""
    m = m if m is not None else model_table(spark, sf_dir, columns=["ID_BUYER", "REPEATER"])
    s = key_fraction("ID_BUYER", 42)
    return m.select("ID_BUYER", F.col("REPEATER").alias("label"), s.alias("score"),
                    (s >= 0.5).cast("int").alias("prediction"))


def uplift_predictions(spark, sf_dir, invert: bool = False, convention: str = "as_coded"):
    """Prediction table in the shape ``machine_learning`` returns, with fixed
    probabilities: outcome probability, four class probabilities, uplift score."""
    m = model_table(spark, sf_dir, columns=["ID_BUYER", "REPEATER"])
    m = up.assign_treatment(m)
    if invert:
        m = up.invert_treatment(m)
    m = up.target_class(m, convention)
    raw = [key_fraction("ID_BUYER", s) + F.lit(0.01) for s in CLASS_SALTS]
    tot = raw[0] + raw[1] + raw[2] + raw[3]
    names = ["proba_CN", "proba_CR", "proba_TN", "proba_TR"]
    m = m.select("*", *[(r / tot).alias(n) for r, n in zip(raw, names)],
                 key_fraction("ID_BUYER", "rep42").alias("proba_REPEATER"))
    m = m.withColumn("prediction_REPEATER", (F.col("proba_REPEATER") >= 0.5).cast("int"))
    best = F.greatest(*[F.col(n) for n in names])
    pred = (F.when(F.col(names[0]) == best, 0).when(F.col(names[1]) == best, 1)
            .when(F.col(names[2]) == best, 2).otherwise(3))
    m = m.withColumn("prediction_target_class", pred)
    return up.uplift_score(m)


# ---------------------------------------------------------------------------
# SQL
# ---------------------------------------------------------------------------

def model_table_ctes(out: str = "d5"):
    ctes = buyer_table_ctes("d4")
    drop = mt.DROP_FOR_MODEL + mt.DROP_DATES + mt.DROP_TOTALS + ["USER_SEGMENT"]
    fills0 = ["NB_products_liked", "NB_categories_liked", "NB_products_commented",
              "NB_categories_commented", "Frequnecy_comment_12M"]
    fills999 = ["Recency_comment", "Recency_liked"]
    seg = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(params.USER_SEGMENT_ORDER))
    repl = ", ".join([f"COALESCE({c}, 0) AS {c}" for c in fills0]
                     + [f"COALESCE({c}, 999) AS {c}" for c in fills999])
    ctes.append((out, f"""SELECT * EXCLUDE ({', '.join(drop)}) REPLACE ({repl}),
       CAST(CASE USER_SEGMENT {seg} END AS BIGINT) AS USER_SEGMENT,
       {sql_floor_days('DATE_FIRST_PURCHASE', 'DATE_CREATION')} AS days_bf_first_order,
       {sql_floor_days(f"TIMESTAMP '{SNAP}'", 'DATE_LAST_LOGIN')} AS days_since_last_login
FROM d4"""))
    return ctes


def sql_with_model(extra_ctes, final: str) -> str:
    return fx.with_views(["purchases", "offers", "likes", "comments"],
                         model_table_ctes("d5") + list(extra_ctes), final)


def sql_frac(key: str, salt) -> str:
    return fx.sql_key_fraction(key, salt)


SCORED_CTE = ("scored", f"""SELECT ID_BUYER, REPEATER AS label, {sql_frac('ID_BUYER', 42)} AS score,
       CAST({sql_frac('ID_BUYER', 42)} >= 0.5 AS INTEGER) AS prediction
FROM d5""")


def uplift_ctes(invert: bool = False, convention: str = "as_coded"):
    t = f"CAST({fx.sql_key_hash32('ID_BUYER', 'treat42')} % 2 AS INTEGER)"
    if invert:
        t = f"(CASE {t} WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE {t} END)"
    mapping = (params.UPLIFT_CLASS_AS_CODED if convention == "as_coded"
               else params.UPLIFT_CLASS_CORRECTED)
    whens = " ".join(f"WHEN treatment = {tv} AND REPEATER = {rv} THEN {c}"
                     for (tv, rv), c in mapping.items())
    raw = [f"({sql_frac('ID_BUYER', s)} + 0.01)" for s in CLASS_SALTS]
    tot = f"({raw[0]} + {raw[1]} + {raw[2]} + {raw[3]})"
    names = ["proba_CN", "proba_CR", "proba_TN", "proba_TR"]
    probs = ", ".join(f"{r} / {tot} AS {n}" for r, n in zip(raw, names))
    best = f"greatest({', '.join(names)})"

    def dv(a, b):
        return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"
    score = (f"{dv('proba_CN', 'proba_CN+proba_CR')} + {dv('proba_TR', 'proba_TN+proba_TR')} "
             f"- {dv('proba_TN', 'proba_TN+proba_TR')} - {dv('proba_CR', 'proba_CN+proba_CR')}")
    return [
        ("u_base", f"SELECT ID_BUYER, REPEATER, {t} AS treatment FROM d5"),
        ("u_cls", f"SELECT *, CASE {whens} ELSE 0 END AS target_class FROM u_base"),
        ("u_prob", f"""SELECT *, {probs}, {sql_frac('ID_BUYER', 'rep42')} AS proba_REPEATER FROM u_cls"""),
        ("upred", f"""SELECT *, CAST(proba_REPEATER >= 0.5 AS INTEGER) AS prediction_REPEATER,
       CASE WHEN proba_CN = {best} THEN 0 WHEN proba_CR = {best} THEN 1
            WHEN proba_TN = {best} THEN 2 ELSE 3 END AS prediction_target_class,
       {score} AS score_etu
FROM u_prob"""),
    ]

