"""Bounded training samples of labelled documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buyerlens.session import write_shared


def held_out(doc_id) -> F.Column:
    """Whether a document belongs to the evaluation fold: crc32 of the id's text is 0 modulo 5.
    A null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``ord, y, text`` of at most ``max_rows`` labelled documents outside the evaluation fold, in
    the order of a hash of doc_id.  Of several labels of one document the largest counts.  The
    broadcast side has at most ``max_rows`` rows."""
    chosen = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
              .select(F.col("doc_id").cast("long").alias("ord"), "y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("key") == F.col("ord")).select("ord", "y", "text")


def collect_bounded(texts: DataFrame, featurize, kind: str, max_values: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature arrays and labels of the sampled documents, in the order of a hash of their ids,
    as far as the arrays fit in ``max_values`` values; a document that does not fit any more is
    skipped.  Only the sizes of the others' arrays reach the driver.

    ``featurize`` maps a text column to one array of ``kind`` (int or float) per row.
    """
    def rows(batches):
        value = pa.int32() if kind == "int" else pa.float32()
        for batch in batches:
            out = featurize(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ord"), batch.column("y"), pa.array([len(u) for u in out], pa.int64()),
                 pa.array(out, pa.list_(value))], ["ord", "y", "n", "features"])

    stored = write_shared(texts.mapInArrow(rows, f"ord long, y int, n long, features array<{kind}>")
                          .dropDuplicates(["ord"]).withColumn("turn", F.xxhash64("ord")))
    sizes = sorted((r["turn"], r["ord"], r["n"]) for r in stored.select("turn", "ord", "n").collect())
    taken, total = [], 0
    for _, ord_, n in sizes:
        if total + n <= max_values:
            total += n
            taken.append(ord_)
    if not taken:
        return [], np.zeros(0)
    keep = texts.sparkSession.createDataFrame([(o,) for o in taken], "ord long")
    table = stored.select("ord", "y", "features").join(F.broadcast(keep), "ord").toArrow()
    flat = table.column("features").combine_chunks()
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    ids, y = table.column("ord").to_numpy(), table.column("y").to_numpy()
    use = np.argsort(ids, kind="stable")
    return [values[offsets[k]:offsets[k + 1]] for k in use], y[use].astype(float)


def no_model_score(y: np.ndarray) -> float | None:
    """The score of every text when training rows lack a class: the smoothed share of label 1."""
    n, k = len(y), int(y.sum())
    return (k + 0.5) / (n + 2) if n == 0 or k in (0, n) else None
