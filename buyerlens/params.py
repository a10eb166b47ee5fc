"""Parameters with the reference pipeline's defaults.

Fixed values that must equal the reference for identical results are listed
here together, in their natural order.
"""

from __future__ import annotations

# --- fixed values (reference defaults) -------------------------------------
NULL_RATIO_PURCHASES = 0.85
NULL_RATIO_LIKES = 0.85
NULL_RATIO_COMMENTS = 0.80
ACTIVITY_CUTOFF = "2022-01-01"
SNAPSHOT_DATE = "2023-02-11"
FILL_COUNT = 0
FILL_RECENCY = 999
SEED = 42
TEST_SHARE = 0.2
UPLIFT_TEST_SHARE = 0.3
FOLDS_CLASSIFIER = 7
FOLDS_REGRESSOR = 7
FOLDS_BOOSTED_REGRESSOR = 5
VARIANCE_THRESHOLD = 0.1
K_BEST = 10
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
WEIGHT_REPEATER = 0.75
WEIGHT_CURRENT_VALUE = 0.25
WA_WEIGHT_REPEATER = 0.8
WA_WEIGHT_CLTV = 0.2
MIN_SCORE = 0.5
TOP_K = 10
THRESHOLD_STEP = 0.001
THRESHOLD_COUNT = 1000
TE_MIN_SAMPLES_LEAF = 20
TE_SMOOTHING = 10.0

# Buyer-type labels: New_Buyer -> 0, Repeat -> 1, Repeat_90D -> 1.
BUYER_TYPE_MAP = {"New_Buyer": 0, "Repeat": 1, "Repeat_90D": 1}

# USER_SEGMENT ordinal order, lowest to highest.
USER_SEGMENT_ORDER = [
    "Hibernating", "Inactive 6-12M", "Dormant 6M", "About to Sleep",
    "At High Risk", "At Risk", "Need Attention", "New Customer",
    "Potential Engaged", "Engaged", "Highly Engaged",
]

# Gender code after the reference's overwrite cascade (net effect).
GENDER_NET_MAP = {0: 0, 1: 0, 2: 1, 3: 2}

# Four uplift classes as the reference code assigns them (treatment, repeater).
UPLIFT_CLASS_AS_CODED = {(0, 1): 0, (0, 0): 1, (1, 1): 2, (1, 0): 3}
# The labelling its comments describe: CN=0, CR=1, TN=2, TR=3.
UPLIFT_CLASS_CORRECTED = {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 3}

# Columns of the purchase features by how a buyer's rows are reduced.
MODE_COLUMNS = ["ID_CATEGORY", "ID_SUBCATEGORY", "ID_BRAND", "ID_PAYMENT_TYPE",
                "ORDER_MARKETING_CHANNEL"]
MEAN_COLUMNS = ["DEPOSIT_PRICE", "PRICE_SOLD_GMV", "NB_ITEMS", "DISCOUNT_AMOUNT_GMV",
                "BUYER_FEE_GMV", "MMAO_PRICE_DROP", "VOUCHER_REVENUE", "ID_CONDITION",
                "ID_GENDER"]

# Columns removed for the model table; the two mean-commission columns carry
# explicit names instead of merge suffixes.
DROP_FOR_MODEL = [
    "RFM_BUYER", "ORDER_VALUE_RANGE", "ID_CONDITION", "ORDER_MARKETING_CHANNEL",
    "Total_likes", "Total_wishes", "Total_MMAO_NB", "Avg_commision_liked",
    "Avg_commision_commented", "NL_REACTIVITY_GROUP", "NB_PURCHASED", "RANK_BUYER",
    "BUYER_SEGMENT", "NB_SOLD", "RANK_WITHIN_SEGMENT", "ID_SEGMENT", "ID_RFM_BUYER",
    "Frequnecy_like_12M", "VOUCHER_REVENUE",
]
DROP_DATES = ["DATE_CREATION", "DATE_NEW_BUYER", "LastLikeDate", "LastCommentDate",
              "DATE_FIRST_PURCHASE", "DATE_LAST_LOGIN", "DATE_LAST_PURCHASE"]
DROP_TOTALS = ["Total_nb_likes", "Total_nb_wish"]

# Uplift score of the four class probabilities.
UPLIFT_EXPRESSION = ("proba_CN/(proba_CN+proba_CR) + proba_TR/(proba_TN+proba_TR) "
                     "- proba_TN/(proba_TN+proba_TR) - proba_CR/(proba_CN+proba_CR)")
# ---------------------------------------------------------------------------

# Fixture settings for the driver tables (events span 2024-01-01..2024-01-30).
FIXTURE_CUTOFF = "2024-01-15"
FIXTURE_SNAPSHOT = "2024-02-11"
