"""Score buyer tables as they land in a folder (re-aim of the upload app).

The reference app scores one uploaded CSV per HTTP request.  Here each new
file in ``input_dir`` is a micro-batch of a file-source stream; every batch
goes through the stored encoders, scalers and models (C3) and the weighted
composite (C2), and is written to ``output_dir/batch_id=<n>`` with overwrite,
so a retried batch replaces its own output (idempotent sink).  Progress is
tracked in ``checkpoint_location``, so a restarted query resumes where it
stopped.

The reference min-max scales predicted value inside each upload; pass
``value_range=(lo, hi)`` to use a stored range instead, which makes a buyer's
score independent of the other buyers in the same file.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from buyerlens import params
from buyerlens.operators import scoring as sc
from buyerlens.plans.scoring_job import apply_target


def start_scoring_stream(spark: SparkSession, input_dir: str, schema: T.StructType,
                         repeater_path: str, cltv_path: str, features: list[str],
                         output_dir: str, checkpoint_location: str,
                         value_range: tuple[float, float] | None = None,
                         min_score: float = params.MIN_SCORE, available_now: bool = True,
                         file_format: str = "parquet"):
    """Start the streaming scoring query and return its handle."""
    reader = spark.readStream.schema(schema)
    # CSV uploads: header names are checked against the schema instead of
    # mapping columns by position (a reordered file fails instead of
    # silently shifting values).
    stream = reader.parquet(input_dir) if file_format == "parquet" else \
        reader.option("header", True).option("enforceSchema", False).csv(input_dir)

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        p = apply_target(spark, batch, repeater_path, features, "repeater_pred_proba", True)
        v = apply_target(spark, batch, cltv_path, features, "cltv_pred_lgbm", False)
        lo, hi = value_range if value_range else (None, None)
        wa = sc.wa_scoring(p.join(v, "ID_BUYER"), lo=lo, hi=hi)
        out = (wa.select("ID_BUYER", "Composite_Score")
               .withColumn("above_min_score", F.col("Composite_Score") >= F.lit(min_score)))
        out.write.mode("overwrite").parquet(os.path.join(output_dir, f"batch_id={batch_id}"))

    writer = (stream.writeStream.foreachBatch(score_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="10 seconds")
    return writer.start()
