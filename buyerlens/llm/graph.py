"""Connected components of an edge table, as repeated Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buyerlens.session import write_shared


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star or small-star step: neighbours are re-hung on the minimum.

    The minimum is a partially aggregated group; the join back on a hub's key
    is an ordinary equi-join whose hot partitions AQE splits.
    """
    if small:
        pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w"))
    else:
        pairs = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(
            edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    low = pairs.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
    joined = pairs.join(low, "v")
    if small:
        moved = joined.select(F.col("w").alias("a"), F.col("m").alias("b")).unionAll(
            low.select(F.col("v").alias("a"), F.col("m").alias("b")))
    else:
        moved = joined.filter("w > v").select(F.col("w").alias("a"), F.col("m").alias("b"))
    moved = moved.filter("a <> b")
    return moved.distinct() if small else moved


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id that an edge ``(a, b)`` names; the
    component is the smallest id reachable.  Alternating large-star and
    small-star steps until nothing moves (logarithmically many in practice).
    Edges with a null end are ignored."""
    cur = write_shared(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                       .filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.struct(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"))
    before = None
    while True:
        now = cur.agg(mark.alias("m")).first()["m"]
        if now == before or now["n"] == 0:
            break
        before = now
        cur = write_shared(_stars(_stars(cur, False), True))
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        cur.select(F.col("b"), F.col("b")).distinct())
