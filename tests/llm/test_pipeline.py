import re

import pyarrow as pa

import corpus_pipeline as cp
from buyerlens.llm import mixing, sharding, toxicity
from buyerlens.llm.decontaminate import contaminated
from buyerlens.llm.minhash_join import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["toxicity", "minhash_near_dedup", "decontamination", "mixing", "sharding"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf001}/labels.parquet"))
    texts = {r["doc_id"]: r for r in docs.collect()}
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] >= 0.5}
    left = {i for i in texts} - toxic
    assert toxic and any(re.search("idiot|stupid|trash|moron|scum", texts[i]["text"].lower()) for i in toxic)
    clean = docs.filter(docs.doc_id.isin(*left))
    groups = {r["doc_id"]: r["component_id"] for r in near_duplicates(clean).collect()}
    left = {i for i in left if groups[i] == i}
    leaks = {r["doc_id"] for r in contaminated(docs, spark.read.parquet(f"{sf001}/benchmark.parquet")).collect()}
    left -= leaks
    chosen = {r["doc_id"] for r in mixing.sampled(docs.filter(docs.doc_id.isin(*left))).collect() if r["kept"]}
    out = cp.run(spark, sf001)
    assert out.columns == [*COLUMNS, "shard", "grown_shard"]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == chosen and len(rows) == len(chosen)
    want = sharding.descend(sharding.document_keys(pa.array([r["doc_id"] for r in rows], pa.int64())), sharding.build_tree(24))
    assert [r["shard"] for r in rows] == want.tolist()
    assert all(r["text"] == texts[r["doc_id"]]["text"] for r in rows)


def test_stages_keep_columns_and_null_rows(spark, sf001):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (2, "some clean words", "en", "s", 3, 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf001)
        assert out.columns == docs.columns, name
        if name != "mixing":
            assert out.count() == 3, name
    assert cp.STAGES[-1][1](spark, docs, sf001).columns == [*docs.columns, "shard", "grown_shard"]
