"""Spark session helpers.

Cluster settings (master, memory, ``spark.checkpoint.dir``) come from the
submitting environment.  Only when a setting is missing - as in local tests -
do we fill in a default.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock for timestamp arithmetic, ANSI
# errors instead of silent nulls, adaptive execution for runtime broadcast,
# partition coalescing and skew-join splitting.
_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # delete checkpoint files in the shared folder once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Wide projections with many aliases of the same source column (the
    # purchase rows) make constraint propagation enumerate alias combinations
    # until the driver runs out of memory; the constraints it would infer are
    # only IsNotNull filters that the scans and joins do not need.
    "spark.sql.constraintPropagation.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "buyerlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    On a cluster ``spark.checkpoint.dir`` must name a folder that the driver
    and all executors share; it is used as is and its absence is an error.
    Only a single-JVM ``local`` master, as in tests, gets a private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        configured = tempfile.mkdtemp(prefix="buyerlens-ckpt-")
    if "://" not in configured:
        os.makedirs(configured, exist_ok=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per context, so that
    functions shipped to Python workers import it wherever the driver started."""
    sc = spark.sparkContext
    if getattr(sc, "_buyerlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="buyerlens-src-"), "buyerlens_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("buyerlens", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._buyerlens_shipped = True


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the session's JVM delete a work folder when it ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_shared(df, drop_shuffles: bool = False):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Lineage is cut: a lost executor costs a re-read.  Readers prune columns.
    The files are deleted when the session's JVM ends.  With ``drop_shuffles`` Spark deletes the
    shuffle files of the write as soon as it has ended, not when a garbage collection finds them unused.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/stored-{uuid.uuid4().hex}"
    if drop_shuffles:
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    delete_on_exit(spark, path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._buyerlens_path = path
    return stored


def free_shared(df) -> None:
    """Delete the files of a table that ``write_shared`` returned, once a loop has superseded it."""
    path = getattr(df, "_buyerlens_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def apply_query_conf(spark: SparkSession) -> None:
    """Session settings the operators assume; safe to call repeatedly."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled",
              "spark.sql.constraintPropagation.enabled"):
        spark.conf.set(k, _CONF[k])
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def materialize(df):
    """``df`` stored once because it feeds several branches of a plan; see ``write_shared``."""
    return write_shared(df)
