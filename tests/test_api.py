"""The reference-named entry points wire up to the operators."""

from buyerlens import api
from buyerlens.plans import scored as s
from buyerlens.sources import fixtures as fx


def test_api_feature_build_and_selection(spark, sf001):
    d1 = api.data_processing_mmao_transac(fx.offers(spark, sf001), fx.purchases(spark, sf001))
    d2 = api.data_processing_likes(fx.likes(spark, sf001), "2024-01-15")
    d3 = api.data_preprocessing_comment(fx.comments(spark, sf001), "2024-01-15")
    buyers = api.merge_dataframes(d1, d2, d3)
    m = api.encoding(api.missing_values(api.date_time_converting(api.drop_columns(buyers), "2024-02-11")))
    assert m.count() == d1.count()
    train, test = api.split(m)
    cols = ["DEPOSIT_PRICE", "PRICE_SOLD_GMV", "NB_ITEMS", "NB_OFFERS", "NB_DAYS_ONLINE"]
    assert set(api.select_features(train, cols, "CLTV", "variance")) <= set(cols)
    assert len(api.select_features(train, cols, "CLTV", "univariate", k=2)) == 2
    assert len(api.select_features(train, cols, "CLTV", "recursive", k=3)) == 3
    tr, te = api.target_encoding(train, test, "REPEATER")
    assert tr.count() == train.count() and te.count() == test.count()


def test_api_threshold_and_uplift(spark, sf001):
    sb = s.scored_binary(spark, sf001)
    relabelled, summary = api.apply_threshold_optimization(sb)
    assert summary.count() == 1 and relabelled.count() == sb.count()
    pred = s.uplift_predictions(spark, sf001)
    cm, ovr = api.cm_evaluation(pred)
    assert cm.count() == 4 and ovr.count() >= 2
