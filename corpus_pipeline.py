"""Corpus pipeline: toxicity, near duplicates, benchmark contamination, mixing, sharding.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` on the rows its
predecessor kept; ``run`` writes each stage's result as Parquet in the shared
checkpoint folder and hands the reread table to the next one.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from buyerlens.llm import decontaminate, minhash_join, mixing, sharding, toxicity
from buyerlens.session import free_shared, write_shared


#: Rows that pass between Spark and its Python workers at a time: texts are long, and every worker of an
#: executor holds its batches several times over.
BATCH_ROWS = "1000"


def _small_batches(stage):
    """A stage that exchanges small Arrow batches with its Python workers."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)
    run_stage.__doc__ = stage.__doc__
    return run_stage


@_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the n-gram classifier (operator 8) scores below 0.5.  It is trained on the
    labelled rows of ``docs`` outside the evaluation fold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


@_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 9; five-word shingles, 0.8): the one with
    the smallest doc_id.  Only dropped ids are joined, so rows without an id stay."""
    found = minhash_join.near_duplicates(docs)
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped"))
    return docs.join(dropped, docs.doc_id == F.col("_dropped"), "left_anti")


@_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item (operator 7)."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares are raked to flattened source, language and topic marginals (operator 5)."""
    return mixing.mixed(docs)


@_small_batches
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns plus the shard of each document, and its shard with one more (operator 6)."""
    tree = sharding.build_tree(24)
    return sharding.place(docs, tree, sharding.grow(tree, 24))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Hashing, classifier training and tiling have no SQL form; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        kept = write_shared(stage(spark, docs, sf_dir))
        free_shared(docs)
        docs = kept
    return docs
