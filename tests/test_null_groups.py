import random
from pyspark.sql import functions as F
from buyerlens.operators.split import class_weights, stratified_kfold, stratified_split
from buyerlens.operators.window import ordered_scan


def _small_batches(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))


def test_null_groups_across_batches_and_partitions(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(i, None if i < 3 else (0 if i < 43 else 1), 2 ** 60 + 1 if i % 2 else None) for i in range(83)]
    df = spark.createDataFrame(rows, "id long, g int, big long")
    try:
        for size, parts in ((5, 1), (5, 4), (1000, 3)):
            _small_batches(spark, size)
            out = ordered_scan(df, ["id"], ["g"], sum_cols=["id"], num_partitions=parts).collect()
            seen = {}
            for r in sorted(out, key=lambda r: r["id"]):
                n, total = seen.get(r["g"], (0, 0))
                seen[r["g"]] = (n + 1, total + r["id"])
                assert (r["_pos"], r["cum_id"]) == seen[r["g"]]
                assert r["big"] in (None, 2 ** 60 + 1)
            assert {k: v[0] for k, v in seen.items()} == {None: 3, 0: 40, 1: 40}
    finally:
        _small_batches(spark, old)


def test_null_stratum_keeps_its_rows(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(i, rng.choice([None, 0, 0, 0, 1])) for i in range(2000)], "ID_BUYER long, y int")
    split = stratified_split(df, "y", test_share=0.3)
    counts = {r["y"]: (r["n"], r["t"]) for r in split.groupBy("y").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    assert sum(n for n, _ in counts.values()) == 2000 and None in counts
    assert all(t == -(-3 * n // 10) for n, t in counts.values())
    folds = stratified_kfold(df, "y", k=5).groupBy("y", "fold").count().collect()
    for label in (None, 0, 1):
        sizes = [r["count"] for r in folds if r["y"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    weighted = class_weights(df, "y")
    assert weighted.count() == 2000 and weighted.filter("weight is null").count() == 0
