"""Registered queries: profiling, cleaning, encoders, selection and splits."""

from __future__ import annotations

from buyerlens.operators import clean as cl
from buyerlens.operators import encode as en
from buyerlens.operators import profile as pr
from buyerlens.operators import split as sp
from buyerlens.operators.aggregate import value_counts
from buyerlens.operators import uplift as up
from buyerlens.plans import buyer_features as bf
from buyerlens.plans import scored as s
from buyerlens.plans.queries_eval import C1_CTES, q_c1, xsum
from buyerlens.plans.queries_features import CUT, buyer_table, buyer_table_ctes
from buyerlens.plans.registry import register
from buyerlens.session import materialize
from buyerlens.sources import fixtures as fx

frac = s.sql_frac
hash32 = fx.sql_key_hash32


def _activity_cols(spec):
    return (list(spec.sums) + list(spec.distincts)
            + [spec.mean_out, spec.last_date, spec.recency, spec.frequency])


D4_COLUMNS = (["ID_BUYER"] + bf.MODE_COLUMNS + bf.MEAN_COLUMNS + ["REPEATER"] + bf.FIRST_COLUMNS
              + _activity_cols(bf.LIKES_SPEC) + _activity_cols(bf.COMMENTS_SPEC))
NUMERIC_FEATURES = [
    "DEPOSIT_PRICE", "PRICE_SOLD_GMV", "NB_ITEMS", "DISCOUNT_AMOUNT_GMV", "BUYER_FEE_GMV",
    "MMAO_PRICE_DROP", "ID_GENDER", "INACTIVE", "NB_PUBLISHED", "USER_SEGMENT", "NB_OFFERS",
    "AVG_OFFERS", "NB_DAYS_ONLINE", "NB_products_liked", "NB_categories_liked", "Recency_liked",
    "NB_products_commented", "NB_categories_commented", "Recency_comment",
    "Frequnecy_comment_12M", "days_bf_first_order", "days_since_last_login",
]
CONTINUOUS = ["DEPOSIT_PRICE", "PRICE_SOLD_GMV", "NB_ITEMS", "DISCOUNT_AMOUNT_GMV",
              "BUYER_FEE_GMV", "MMAO_PRICE_DROP", "CLTV", "NB_DAYS_ONLINE"]
ENCODED = ["ID_CATEGORY", "ID_SUBCATEGORY", "ID_BRAND", "ID_PAYMENT_TYPE"]


def sql_d4(final: str, extra=()) -> str:
    return fx.with_views(["purchases", "offers", "likes", "comments"],
                         buyer_table_ctes("d4") + list(extra), final)


def unnest_rows(fields_per_row: list[dict[str, str]], source: str) -> str:
    """One aggregate row -> one row per struct (DuckDB unnest of a struct list)."""
    structs = ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in f.items()) + "}"
                        for f in fields_per_row)
    return f"SELECT unnest([{structs}], recursive := true) FROM {source}"


def xmean(c: str) -> str:
    return f"({xsum(c)} / count({c}))"


# ----------------------------------------------------------------- A10
A10_AGG = ", ".join(["count(*) AS n"] + [f"count(*) FILTER (WHERE {c} IS NULL) AS m{i}"
                                         for i, c in enumerate(D4_COLUMNS)])
A10_SQL = sql_d4(f"""SELECT column_name, missing_values,
       round_even(CAST(100.0 AS DOUBLE) * missing_values / rows, 1) AS pct_of_total
FROM ({unnest_rows([{'column_name': f"'{c}'", 'missing_values': f'm{i}', 'rows': 'n'}
                    for i, c in enumerate(D4_COLUMNS)], 'a10')}) u
WHERE missing_values > 0""", [("a10", f"SELECT {A10_AGG} FROM d4")])


@register("A10_missing_values_table", sql=A10_SQL)
def q_a10(spark, sf_dir):
    return pr.missing_values_table(buyer_table(spark, sf_dir))


# ----------------------------------------------------------------- A11
@register("A11_value_counts", sql=s.sql_with_model(
    [], "SELECT REPEATER, count(*) AS count FROM d5 WHERE REPEATER IS NOT NULL GROUP BY REPEATER"))
def q_a11(spark, sf_dir):
    return value_counts(s.model_table(spark, sf_dir, columns=["REPEATER"]), "REPEATER")


# ----------------------------------------------------------------- A12
DESC_COLS = ["REPEATER_pred_proba", "CLTV", "COMPOSITE_SCORE"]


def _describe_sql(cols, src):
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(f"""count({c}) AS n{i}, {xmean(c)} AS m{i}, min({c}) AS mn{i}, max({c}) AS mx{i},
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a{i}, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS b{i},
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS c{i}""")
    stage1 = f"SELECT {', '.join(aggs)} FROM {src}"
    ss = ", ".join(f"{xsum(f'(CAST({c} AS DOUBLE) - m{i}) * (CAST({c} AS DOUBLE) - m{i})')} AS ss{i}"
                   for i, c in enumerate(cols))
    stage2 = f"SELECT ds1.*, x.* FROM ds1 CROSS JOIN (SELECT {ss} FROM {src} CROSS JOIN ds1) x"
    rows = [{"column_name": f"'{c}'", "count": f"n{i}", "mean": f"m{i}",
             "std": f"CASE WHEN n{i} > 1 THEN sqrt(ss{i} / (n{i} - 1)) END",
             "min": f"CAST(mn{i} AS DOUBLE)", "q25": f"a{i}", "q50": f"b{i}", "q75": f"c{i}",
             "max": f"CAST(mx{i} AS DOUBLE)"} for i, c in enumerate(cols)]
    return [("ds1", stage1), ("ds2", stage2)], unnest_rows(rows, "ds2")


_A12_CTES, _A12_FINAL = _describe_sql(DESC_COLS, "c1")


@register("A12_describe", sql=s.sql_with_model(C1_CTES + _A12_CTES, _A12_FINAL),
          round_cols=["q25", "q50", "q75"], digits=9)
def q_a12(spark, sf_dir):
    return pr.describe(q_c1(spark, sf_dir), DESC_COLS)


# ----------------------------------------------------------------- A13
@register("A13_histogram", sql=s.sql_with_model(C1_CTES + [
    ("h_rng", "SELECT min(COMPOSITE_SCORE) AS lo, max(COMPOSITE_SCORE) AS hi FROM c1"),
    ("h_cnt", """SELECT CAST(CASE WHEN (hi - lo) / 10 = 0 THEN 0
        ELSE least(greatest(ceil((COMPOSITE_SCORE - lo) / ((hi - lo) / 10)) - 1, 0), 9) END AS INTEGER) AS bin,
       count(*) AS cnt
FROM c1 CROSS JOIN h_rng WHERE COMPOSITE_SCORE IS NOT NULL GROUP BY 1""")], """
SELECT CAST(r.i AS INTEGER) AS bin, lo + CAST(r.i AS INTEGER) * ((hi - lo) / 10) AS "left",
       lo + (CAST(r.i AS INTEGER) + 1) * ((hi - lo) / 10) AS "right", COALESCE(cnt, 0) AS count
FROM range(10) r(i) CROSS JOIN h_rng LEFT JOIN h_cnt ON h_cnt.bin = r.i"""))
def q_a13(spark, sf_dir):
    return pr.histogram(q_c1(spark, sf_dir), "COMPOSITE_SCORE", 10)


# ----------------------------------------------------------------- A14
CORR_COLS = NUMERIC_FEATURES + ["REPEATER", "CLTV"]


def _corr_sql():
    aggs, rows, k = [], [], 0
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[: i + 1]:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            aggs.append(f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c{k}, "
                        f"var_pop(CAST({a} AS DOUBLE)) FILTER (WHERE {both}) AS va{k}, "
                        f"var_pop(CAST({b} AS DOUBLE)) FILTER (WHERE {both}) AS vb{k}")
            rows.append({"col_a": f"'{a}'", "col_b": f"'{b}'",
                         "corr": f"CASE WHEN va{k} = 0 OR vb{k} = 0 THEN NULL "
                                 f"ELSE c{k} / sqrt(va{k} * vb{k}) END"})
            k += 1
    return s.sql_with_model([("a14", f"SELECT {', '.join(aggs)} FROM d5")], unnest_rows(rows, "a14"))


@register("A14_correlation_matrix", sql=_corr_sql(), round_cols=["corr"], digits=6)
def q_a14(spark, sf_dir):
    return pr.correlation_pairs(s.model_table(spark, sf_dir, columns=CORR_COLS), CORR_COLS)


# ----------------------------------------------------------------- A16/A17
@register("A17_quartiles_by_target", sql=s.sql_with_model([], """
SELECT REPEATER, min(CAST(CLTV AS DOUBLE)) AS min, quantile_cont(CAST(CLTV AS DOUBLE), 0.25) AS q25,
       quantile_cont(CAST(CLTV AS DOUBLE), 0.5) AS q50, quantile_cont(CAST(CLTV AS DOUBLE), 0.75) AS q75,
       max(CAST(CLTV AS DOUBLE)) AS max, count(CLTV) AS count
FROM d5 GROUP BY REPEATER"""), round_cols=["q25", "q50", "q75"], digits=6)
def q_a17(spark, sf_dir):
    return pr.quartiles_by(s.model_table(spark, sf_dir, columns=["REPEATER", "CLTV"]), "REPEATER", "CLTV")


# ----------------------------------------------------------------- U3
U3_CUT2 = "2024-01-20"


def _u3_sql():
    b = buyer_table_ctes("d4")
    b2 = [(n.replace("d4", "e4").replace("d1", "e1").replace("d2", "e2").replace("d3", "e3"),
           q.replace("TIMESTAMP '2024-01-15'", f"TIMESTAMP '{U3_CUT2}'")
            .replace("d1", "e1").replace("d2", "e2").replace("d3", "e3").replace("d4", "e4"))
          for n, q in buyer_table_ctes("d4")]
    return fx.with_views(["purchases", "offers", "likes", "comments"], b + b2, """
SELECT true AS schema_equal, (SELECT count(*) FROM d4) AS rows_left, (SELECT count(*) FROM e4) AS rows_right,
       (SELECT count(*) FROM (SELECT * FROM d4 EXCEPT ALL SELECT * FROM e4)) AS only_left,
       (SELECT count(*) FROM (SELECT * FROM e4 EXCEPT ALL SELECT * FROM d4)) AS only_right,
       (SELECT count(*) FROM (SELECT * FROM d4 EXCEPT ALL SELECT * FROM e4)) = 0
       AND (SELECT count(*) FROM (SELECT * FROM e4 EXCEPT ALL SELECT * FROM d4)) = 0 AS "equal\"""")


@register("U3_compare_versions", sql=_u3_sql())
def q_u3(spark, sf_dir):
    # the versions differ in the activity cutoff only, so they share their purchase features
    purchases = materialize(bf.purchase_features(fx.purchases(spark, sf_dir), fx.offers(spark, sf_dir)))
    left, right = (bf.merge_buyer_table(purchases, bf.likes_features(fx.likes(spark, sf_dir), cut, check_contract=True),
                                        bf.comments_features(fx.comments(spark, sf_dir), cut, check_contract=True))
                   for cut in (CUT, U3_CUT2))
    return pr.compare_tables(left, right).drop("common_columns")


# ----------------------------------------------------------------- P3
P3_SQL = sql_d4(f"""SELECT column_name, non_null, rows, non_null >= 0.85 * rows AS kept
FROM ({unnest_rows([{'column_name': f"'{c}'", 'non_null': f'k{i}', 'rows': 'n'}
                    for i, c in enumerate(D4_COLUMNS)], 'p3')}) u""",
                [("p3", "SELECT " + ", ".join(["count(*) AS n"] + [f"count({c}) AS k{i}"
                                                                  for i, c in enumerate(D4_COLUMNS)])
                  + " FROM d4")])


@register("P3_sparse_column_profile", sql=P3_SQL)
def q_p3(spark, sf_dir):
    return cl.sparse_column_profile(buyer_table(spark, sf_dir), 0.85)


@register("P3_drop_sparse_columns")
def q_p3_drop(spark, sf_dir):
    return cl.drop_sparse_columns(materialize(buyer_table(spark, sf_dir)), 0.85)


# ----------------------------------------------------------------- P13/P14
def _iqr_sql():
    qs = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{i}, "
                   f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{i}" for i, c in enumerate(CONTINUOUS))
    flags = " OR ".join(f"COALESCE(CAST({c} AS DOUBLE) < q1_{i} - 1.5 * (q3_{i} - q1_{i}) "
                        f"OR CAST({c} AS DOUBLE) > q3_{i} + 1.5 * (q3_{i} - q1_{i}), false)"
                        for i, c in enumerate(CONTINUOUS))
    return s.sql_with_model([("iq", f"SELECT {qs} FROM d5")],
                            f"SELECT d5.* FROM d5 CROSS JOIN iq WHERE NOT ({flags})")


@register("P13_iqr_outlier_filter", sql=_iqr_sql())
def q_p13(spark, sf_dir):
    return cl.remove_outliers_iqr(s.model_table(spark, sf_dir), CONTINUOUS)


def _z_sql():
    mu = ", ".join(f"{xmean(c)} AS mu{i}" for i, c in enumerate(CONTINUOUS))
    sd = ", ".join(f"sqrt({xsum(f'(CAST({c} AS DOUBLE) - mu{i}) * (CAST({c} AS DOUBLE) - mu{i})')} "
                   f"/ count({c})) AS sd{i}" for i, c in enumerate(CONTINUOUS))
    keep = " AND ".join(f"COALESCE(abs(CASE WHEN sd{i} = 0 THEN NULL ELSE (CAST({c} AS DOUBLE) - mu{i}) / sd{i} END) < 3, false)"
                        for i, c in enumerate(CONTINUOUS))
    return s.sql_with_model([("zm", f"SELECT {mu} FROM d5"),
                             ("zs", f"SELECT zm.*, {sd} FROM d5 CROSS JOIN zm GROUP BY ALL")],
                            f"SELECT d5.* FROM d5 CROSS JOIN zs WHERE {keep}")


@register("P14_zscore_outlier_filter", sql=_z_sql())
def q_p14(spark, sf_dir):
    return cl.remove_outliers_zscore(s.model_table(spark, sf_dir), CONTINUOUS)


# ----------------------------------------------------------------- P15
@register("P15_preview", sql=s.sql_with_model([], "SELECT * FROM d5 ORDER BY ID_BUYER LIMIT 5"))
def q_p15(spark, sf_dir):
    return cl.preview(s.model_table(spark, sf_dir), ["ID_BUYER"], 5)


@register("P15_shape", sql=s.sql_with_model(
    [], "SELECT count(*) AS n_rows, CAST(29 AS BIGINT) AS n_columns FROM d5"))
def q_p15_shape(spark, sf_dir):
    return cl.shape(s.model_table(spark, sf_dir))


# ----------------------------------------------------------------- E8-E12
SPLIT_CTES = [("tr", f"SELECT * FROM d5 WHERE {frac('ID_BUYER', 'split42')} >= 0.2"),
              ("te", f"SELECT * FROM d5 WHERE {frac('ID_BUYER', 'split42')} < 0.2")]


def _split(spark, sf_dir):
    return sp.train_test_split(s.model_table(spark, sf_dir))


@register("E8_train_test_split", sql=s.sql_with_model([], f"""
SELECT ID_BUYER, CAST({frac('ID_BUYER', 'split42')} < 0.2 AS INTEGER) AS is_test FROM d5"""))
def q_e8(spark, sf_dir):
    return sp.mark_test(s.model_table(spark, sf_dir, columns=["ID_BUYER"])).select("ID_BUYER", "is_test")


def _strat_sql(stratum: str, salt: str, src: str) -> str:
    return (f"row_number() OVER (PARTITION BY {stratum} ORDER BY {hash32('ID_BUYER', salt)}, ID_BUYER)")


@register("E9_stratified_split", sql=s.sql_with_model(s.uplift_ctes()[:1], f"""
SELECT ID_BUYER, treatment,
       CAST(rn <= ceil(CAST(0.3 AS DOUBLE) * cnt) AS INTEGER) AS is_test
FROM (SELECT ID_BUYER, treatment, {_strat_sql('treatment', 'split42', 'u_base')} AS rn,
             count(*) OVER (PARTITION BY treatment) AS cnt FROM u_base) x"""))
def q_e9(spark, sf_dir):
    base = up.assign_treatment(s.model_table(spark, sf_dir, columns=["ID_BUYER"]))
    return sp.stratified_split(base, "treatment").select("ID_BUYER", "treatment", "is_test")


@register("E10_stratified_kfold", sql=s.sql_with_model([], f"""
SELECT ID_BUYER, REPEATER, CAST(({_strat_sql('REPEATER', 'splitf42', 'd5')} - 1) % 7 AS INTEGER) AS fold
FROM d5"""))
def q_e10(spark, sf_dir):
    m = s.model_table(spark, sf_dir, columns=["ID_BUYER", "REPEATER"])
    return sp.stratified_kfold(m, "REPEATER", 7)


@register("E11_kfold", sql=s.sql_with_model([], f"""
SELECT ID_BUYER, CAST({hash32('ID_BUYER', 'fold42')} % 7 AS INTEGER) AS fold FROM d5"""))
def q_e11(spark, sf_dir):
    return sp.kfold(s.model_table(spark, sf_dir, columns=["ID_BUYER"]), 7)


@register("E12_class_weights", sql=s.sql_with_model([], """
SELECT ID_BUYER, d5.REPEATER, CAST(n AS DOUBLE) / (k * nc) AS weight
FROM d5 LEFT JOIN (SELECT REPEATER, count(*) AS nc FROM d5 GROUP BY REPEATER) c
  ON d5.REPEATER = c.REPEATER
CROSS JOIN (SELECT count(*) AS n, count(DISTINCT REPEATER) + max(CASE WHEN REPEATER IS NULL THEN 1 ELSE 0 END) AS k FROM d5) t"""))
def q_e12(spark, sf_dir):
    m = s.model_table(spark, sf_dir, columns=["ID_BUYER", "REPEATER"])
    return sp.class_weights(m, "REPEATER").select("ID_BUYER", "REPEATER", "weight")


# ----------------------------------------------------------------- E1
def _te_sql():
    maps = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS category, count(*) AS n, "
        f"{xmean('REPEATER')} AS mean FROM tr WHERE {c} IS NOT NULL GROUP BY 2" for c in ENCODED)
    joins = " ".join(f"LEFT JOIN te_enc m{i} ON m{i}.column_name = '{c}' AND m{i}.category = CAST(te.{c} AS VARCHAR)"
                     for i, c in enumerate(ENCODED))
    sel = ", ".join(f"COALESCE(m{i}.encoded, prior) AS {c}" for i, c in enumerate(ENCODED))
    return s.sql_with_model(SPLIT_CTES + [
        ("te_prior", f"SELECT {xmean('REPEATER')} AS prior FROM tr"),
        ("te_map", maps),
        ("te_enc", """SELECT column_name, category,
       CASE WHEN n = 1 THEN prior ELSE prior * (CAST(1.0 AS DOUBLE) - w) + mean * w END AS encoded
FROM (SELECT *, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-(n - 20) / CAST(10.0 AS DOUBLE))) AS w
      FROM te_map CROSS JOIN te_prior) x""")],
        f"SELECT te.ID_BUYER, {sel} FROM te CROSS JOIN te_prior {joins}")


@register("E1_target_encoding", sql=_te_sql(), round_cols=ENCODED, digits=6)
def q_e1(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    mapping, prior = en.fit_target_encoder(train, ENCODED, "REPEATER")
    return en.apply_target_encoder(test.select("ID_BUYER", *ENCODED), mapping, prior, ENCODED)


# ----------------------------------------------------------------- E2/E3
def _minmax_sql():
    fit = ", ".join(f"CAST(min({c}) AS DOUBLE) AS mn{i}, CAST(max({c}) AS DOUBLE) AS mx{i}"
                    for i, c in enumerate(NUMERIC_FEATURES))
    sel = ", ".join(f"(CAST({c} AS DOUBLE) - mn{i}) / CASE WHEN mx{i} - mn{i} = 0 THEN 1.0 ELSE mx{i} - mn{i} END AS {c}"
                    for i, c in enumerate(NUMERIC_FEATURES))
    return s.sql_with_model(SPLIT_CTES + [("mm", f"SELECT {fit} FROM tr")],
                            f"SELECT ID_BUYER, {sel} FROM te CROSS JOIN mm")


@register("E2_minmax_scaling", sql=_minmax_sql())
def q_e2(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    _, te = en.scale(train, test.select("ID_BUYER", *NUMERIC_FEATURES), NUMERIC_FEATURES, "MinMaxScaler")
    return te


def _standard_sql():
    mu = ", ".join(f"{xmean(c)} AS mu{i}" for i, c in enumerate(NUMERIC_FEATURES))
    sd = ", ".join(f"sqrt({xsum(f'(CAST({c} AS DOUBLE) - mu{i}) * (CAST({c} AS DOUBLE) - mu{i})')} "
                   f"/ count({c})) AS sd{i}" for i, c in enumerate(NUMERIC_FEATURES))
    sel = ", ".join(f"(CAST({c} AS DOUBLE) - mu{i}) / CASE WHEN sd{i} = 0 THEN 1.0 ELSE sd{i} END AS {c}"
                    for i, c in enumerate(NUMERIC_FEATURES))
    return s.sql_with_model(SPLIT_CTES + [("sm", f"SELECT {mu} FROM tr"),
                                          ("ss", f"SELECT sm.*, {sd} FROM tr CROSS JOIN sm GROUP BY ALL")],
                            f"SELECT ID_BUYER, {sel} FROM te CROSS JOIN ss")


@register("E3_standard_scaling", sql=_standard_sql())
def q_e3(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    _, te = en.scale(train, test.select("ID_BUYER", *NUMERIC_FEATURES), NUMERIC_FEATURES, "StandardScaler")
    return te


# ----------------------------------------------------------------- E5/E6
def _moments_sql(cols, target=None):
    names = list(cols) + ([target] if target else [])
    mu = ", ".join(f"{xmean(c)} AS mu{i}" for i, c in enumerate(names))
    parts = [f"{xsum(f'(CAST({c} AS DOUBLE) - mu{i}) * (CAST({c} AS DOUBLE) - mu{i})')} AS ss{i}"
             for i, c in enumerate(names)]
    if target:
        t = len(names) - 1
        parts += [f"{xsum(f'(CAST({c} AS DOUBLE) - mu{i}) * (CAST({target} AS DOUBLE) - mu{t})')} AS sxy{i}"
                  for i, c in enumerate(cols)]
    return [("mo_mu", f"SELECT count(*) AS n, {mu} FROM tr"),
            ("mo", f"SELECT any_value(n) AS n, {', '.join(parts)} FROM tr CROSS JOIN mo_mu")]


@register("E5_variance_threshold", sql=s.sql_with_model(
    SPLIT_CTES + _moments_sql(NUMERIC_FEATURES),
    f"""SELECT column_name, variance, variance > 0.1 AS kept FROM ({unnest_rows(
        [{'column_name': f"'{c}'", 'variance': f'ss{i} / n'} for i, c in enumerate(NUMERIC_FEATURES)],
        'mo')}) u"""))
def q_e5(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return en.variance_threshold(train, NUMERIC_FEATURES, 0.1)


def _e6_sql():
    t = len(NUMERIC_FEATURES)
    rows = []
    for i, c in enumerate(NUMERIC_FEATURES):
        r = f"(CASE WHEN ss{i} = 0 OR ss{t} = 0 THEN NULL ELSE sxy{i} / sqrt(ss{i} * ss{t}) END)"
        rows.append({"column_name": f"'{c}'", "r": r,
                     "f_score": f"CASE WHEN CAST(1.0 AS DOUBLE) - {r} * {r} = 0 THEN CAST('inf' AS DOUBLE) "
                                f"ELSE {r} * {r} / (CAST(1.0 AS DOUBLE) - {r} * {r}) * (n - 2) END"})
    return s.sql_with_model(SPLIT_CTES + _moments_sql(NUMERIC_FEATURES, "CLTV"), f"""
SELECT *, row_number() OVER (ORDER BY f_score DESC NULLS LAST, column_name) AS rank,
       row_number() OVER (ORDER BY f_score DESC NULLS LAST, column_name) <= 10 AS selected
FROM ({unnest_rows(rows, 'mo')}) u""")


@register("E6_univariate_selection", sql=_e6_sql())
def q_e6(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return en.univariate_selection(train, NUMERIC_FEATURES, "CLTV", 10)

