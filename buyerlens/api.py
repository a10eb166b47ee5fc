"""Entry points under the reference pipeline's function names.

Each function takes and returns Spark DataFrames (the buyer key stays a
column; there is no index) and delegates to the operators.  Arguments the
reference ignored are not offered; an invalid method name raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buyerlens import params
from buyerlens.operators import clean, encode, metrics, models, profile, scoring, uplift
from buyerlens.operators.split import train_test_split
from buyerlens.plans import buyer_features as bf
from buyerlens.plans import model_table as mt

# ------------------------------------------------------------ feature build
def data_processing_mmao_transac(df_mmao: DataFrame, df_transaction: DataFrame,
                                 check_contract: bool = True) -> DataFrame:
    """Purchases + offers -> one row per buyer."""
    return bf.purchase_features(df_transaction, df_mmao, check_contract)


def data_processing_likes(df_likes: DataFrame, cutoff: str = params.ACTIVITY_CUTOFF) -> DataFrame:
    """D2."""
    return bf.likes_features(df_likes, cutoff)


def data_preprocessing_comment(df_comment: DataFrame,
                               cutoff: str = params.ACTIVITY_CUTOFF) -> DataFrame:
    """D3."""
    return bf.comments_features(df_comment, cutoff)


def merge_dataframes(df_transac: DataFrame, df_likes_final: DataFrame,
                     df_comments_final: DataFrame) -> DataFrame:
    """D4."""
    return bf.merge_buyer_table(df_transac, df_likes_final, df_comments_final)


# ------------------------------------------------------------ preparation
drop_columns = mt.drop_model_columns
encoding = mt.encode_segment


def date_time_converting(df: DataFrame, snapshot: str = params.SNAPSHOT_DATE) -> DataFrame:
    return mt.date_features(df, snapshot)


def missing_values(df: DataFrame) -> DataFrame:
    return clean.missing_values_fill(df, params.FILL_COUNT, params.FILL_RECENCY)


def target_encoding(train_df: DataFrame, valid_df: DataFrame, target_col: str,
                    cols=tuple(mt.TARGET_ENCODED)):
    """Fit on ``train_df`` (its ``target_col`` column), apply to both."""
    mapping, prior = encode.fit_target_encoder(train_df, list(cols), target_col)
    return (encode.apply_target_encoder(train_df, mapping, prior, list(cols)),
            encode.apply_target_encoder(valid_df, mapping, prior, list(cols)))


def outliers_removal(df: DataFrame, outlier_method: str, cols) -> DataFrame:
    """P13 / P14."""
    if outlier_method == "IQR":
        return clean.remove_outliers_iqr(df, cols, params.IQR_FACTOR)
    if outlier_method == "zscore":
        return clean.remove_outliers_zscore(df, cols, params.Z_LIMIT)
    raise ValueError(f"unknown outlier method {outlier_method!r}")


def select_features(train: DataFrame, cols, target: str, method: str,
                    vt_threshold: float = params.VARIANCE_THRESHOLD, k: int = params.K_BEST):
    """Returns the selected column names (the same type for every method)."""
    if method == "variance":
        t = encode.variance_threshold(train, cols, vt_threshold)
        return [r["column_name"] for r in t.where("kept").collect()]       # <= len(cols) rows
    if method == "univariate":
        t = encode.univariate_selection(train, cols, target, k)
        return [r["column_name"] for r in t.where("selected").collect()]   # <= len(cols) rows
    if method == "recursive":
        return models.recursive_elimination(train, cols, target, k)
    raise ValueError(f"unknown selection method {method!r}")


def scaling(train: DataFrame, test: DataFrame, cols, scaler: str = "MinMaxScaler"):
    """E2-E4."""
    return encode.scale(train, test, cols, scaler)


corr_plot = profile.correlation_pairs
missing_values_table = profile.missing_values_table


# ------------------------------------------------------------ scoring
def calculate_composite_score(scored: DataFrame, df_model: DataFrame,
                              weight_repeater: float = params.WEIGHT_REPEATER,
                              weight_cv: float = params.WEIGHT_CURRENT_VALUE,
                              proba_col: str = "score") -> DataFrame:
    """C1."""
    return scoring.composite_score(scored, df_model, proba_col, "CLTV",
                                   weight_repeater=weight_repeater, weight_cv=weight_cv)


def WA_Scoring(df: DataFrame, weight_repeater: float = params.WA_WEIGHT_REPEATER,  # noqa: N802
               weight_CLTV: float = params.WA_WEIGHT_CLTV) -> DataFrame:  # noqa: N803
    """C2 on ``(ID_BUYER, repeater_pred_proba, cltv_pred_lgbm)``."""
    return scoring.wa_scoring(df, weight_repeater=weight_repeater, weight_cltv=weight_CLTV)


def apply_threshold_optimization(df: DataFrame, label: str = "label", score: str = "score"):
    """V8: ``(relabelled rows, one-row summary with the optimal threshold)``."""
    summary = metrics.optimal_threshold(df, label, score)
    return metrics.relabel(df, summary.select("optimal_threshold"), score), summary


def split(df: DataFrame, test_size: float = params.TEST_SHARE, seed=params.SEED):
    """E8 ``train_test_split``."""
    return train_test_split(df, test_share=test_size, seed=seed)


# ------------------------------------------------------------ uplift
declare_target_class = uplift.target_class
correlation_treatment = uplift.treatment_correlation
sorting_data = uplift.sorting_data
calculating_qini = uplift.qini_curve
evaluation_qini = uplift.evaluation_qini
accuracy_evaluation = metrics.two_model_accuracy


def cm_evaluation(df: DataFrame):
    """V2 + V3: the outcome model's confusion matrix and the four one-vs-rest
    matrices of the class model."""
    return (metrics.confusion_matrix(df, "REPEATER", "prediction_REPEATER"),
            metrics.one_vs_rest(df, "target_class", "prediction_target_class"))


def merging_data(qini_c: DataFrame, qini_u: DataFrame) -> DataFrame:
    """Stack both curves with their model label, ordered by ``n``."""
    return (qini_u.withColumn("model", F.lit("ETU"))
            .unionByName(qini_c.withColumn("model", F.lit("ETP")))
            .orderBy(F.asc_nulls_last("n")))
