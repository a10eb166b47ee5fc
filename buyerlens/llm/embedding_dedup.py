"""Embedding near-duplicates by randomised-rotation binary codes (operator 2).

A unit vector is turned by random rotations and stored as the signs of its
coordinates, with the inner product ``f`` of the code and the turned vector as
correction factor.  ``<code_a, y_b> / f_a`` is an unbiased estimate of the
cosine, and its error stays within ``EPSILON`` standard deviations of
``sqrt((1 - f^2) / f^2 / (bits - 1))``.  Pairs whose upper bound reaches the
threshold are recomputed exactly in double precision; the rest is below it.

Which pairs are estimated: the code is cut into ``tables`` bands of ``bits``
signs, and vectors of one label that agree on a band meet in a bucket.  The
number of bits follows the logarithm of the number of vectors, and the number
of tables is such that a pair at the threshold meets nowhere with probability
``MISS`` at most.  A pair is estimated only in the first band on which it
agrees.  Buckets above ``BLOCK_ROWS`` are split into pairs of blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buyerlens.llm.graph import components
from buyerlens.session import ship_package, write_shared

THRESHOLD, MISS, EPSILON, BLOCK_ROWS = 0.93, 1e-6, 5.5, 1024


@dataclass(frozen=True)
class Plan:
    bits: int
    tables: int
    threshold: float

    @property
    def width(self) -> int:
        return self.bits * self.tables


def make_plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> Plan:
    bits = max(4, math.ceil(math.log2(max(n, 2))) - 8)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return Plan(bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet))), threshold)


_turns: dict = {}


def rotation(dim: int, width: int) -> np.ndarray:
    """``width`` rows of stacked random rotations of ``dim`` coordinates, scaled so that unit
    vectors stay (nearly) unit vectors."""
    if (dim, width) not in _turns:
        rng = np.random.default_rng(dim)
        blocks = []
        for _ in range(-(-width // dim)):
            q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
            blocks.append(q * np.sign(np.diag(r)))
        _turns[dim, width] = np.concatenate(blocks)[:width] * math.sqrt(dim / width)
    return _turns[dim, width]


def _matrix(col: pa.Array, kind) -> np.ndarray:
    """Fixed-length list column as a matrix."""
    return np.asarray(col.flatten()).astype(kind).reshape(len(col), -1) if len(col) else np.zeros((0, 1), kind)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bands_of(code: np.ndarray, plan: Plan) -> np.ndarray:
    """Band values of packed sign codes, one row each."""
    bits = np.unpackbits(code, axis=1, count=plan.width).reshape(len(code), plan.tables, plan.bits)
    return bits.astype(np.int64) @ (1 << np.arange(plan.bits, dtype=np.int64))


def _encode(batches, plan: Plan):
    names = ["id", "label", "dim", "code", "factor", "small", "step", "bands"]
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            x = _unit(_matrix(part.column("embedding"), np.float64))
            y = x @ rotation(dim, plan.width).T
            norm = np.linalg.norm(y, axis=1)
            y = y / norm[:, None]
            code = np.packbits(y > 0, axis=1)
            factor = np.abs(y).sum(axis=1) / math.sqrt(plan.width) * norm
            step = np.abs(x).max(axis=1) / 127
            small = np.rint(x / step[:, None]).astype(np.int8)
            bands = bands_of(code, plan)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), part.column("dim"),
                 pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor),
                 pa.array([c.tobytes() for c in small], pa.binary()), pa.array(step),
                 pa.array(list(bands), pa.list_(pa.int64()))], names)


def _stack(col: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def _estimate(batches, plan: Plan):
    """Candidate pairs of the buckets in a partition; rows come sorted by group."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
        if not table:
            continue
        whole = table[0]
        group = np.asarray(whole.column("group"))
        cut = int(np.flatnonzero(group == group[-1])[0])  # the last group may go on in the next batch
        rest = whole.slice(cut)
        yield from _pairs(whole.slice(0, cut), plan)
    if rest is not None:
        yield from _pairs(rest, plan)


def _pairs(rows: pa.RecordBatch, plan: Plan):
    n = rows.num_rows
    if n < 2:
        return
    group = np.asarray(rows.column("group"))
    end = np.searchsorted(group, group, side="right")
    ids, dims = np.asarray(rows.column("id")), np.asarray(rows.column("dim"))
    own, table, cross = (np.asarray(rows.column(c)) for c in ("block", "t", "cross"))
    code = _stack(rows.column("code"), np.uint8)
    bands = bands_of(code, plan)
    factor, step = np.asarray(rows.column("factor")), np.asarray(rows.column("step"))
    decoded = {}
    for dim in np.unique(dims).tolist():
        who = np.flatnonzero(dims == dim)
        sign = np.unpackbits(code[who], axis=1, count=plan.width) * 2.0 - 1
        near = sign @ rotation(dim, plan.width) / math.sqrt(plan.width)
        small = _stack(rows.column("small").take(pa.array(who)), np.int8)
        at = np.zeros(n, np.int64)
        at[who] = np.arange(len(who))
        decoded[dim] = (near, small.astype(np.float32), at)
    spread = np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(max(plan.width - 1, 1))
    i, gap, out_a, out_b = np.arange(n), 1, [], []
    while True:
        i = i[i + gap < end[i]]
        if not len(i):
            break
        for lo in range(0, len(i), 200_000):
            a = i[lo:lo + 200_000]
            b = a + gap
            live = (ids[a] != ids[b]) & ~(cross[a] & (own[a] == own[b]))
            a, b = a[live], b[live]
            # a pair belongs to the first band on which it agrees
            first = (bands[a] == bands[b]).argmax(axis=1) == table[a]
            a, b = a[first], b[first]
            for dim, (near, small, at) in decoded.items():
                pick = dims[a] == dim
                p, q = a[pick], b[pick]
                dot = np.einsum("ij,ij->i", near[at[p]], small[at[q]]) * step[q]
                bound = dot / factor[p] + EPSILON * spread[p] + step[q] * math.sqrt(dim)
                hit = bound >= plan.threshold
                out_a.append(np.minimum(ids[p[hit]], ids[q[hit]]))
                out_b.append(np.maximum(ids[p[hit]], ids[q[hit]]))
        gap += 1
    if out_a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def _exact(batches, threshold: float):
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        keep = np.zeros(len(dims), bool)
        for dim in np.unique(dims).tolist():
            who = dims == dim
            part = batch.filter(pa.array(who))
            x, y = (_unit(_matrix(part.column(c), np.float64)) for c in ("xa", "xb"))
            keep[who] = np.einsum("ij,ij->i", x, y) >= threshold
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS,
                    miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors of one non-null label and one length link at cosine >= threshold.  Null and zero vectors
    and those with null or non-finite components link with nothing, nor do rows with a null vec_id
    (null component, kept).  ``n_links`` counts rows, so equal vectors count each other; rows with a
    repeated vec_id share a component.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          vec.alias("embedding"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", number)
                        & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = write_shared(rows.withColumn("usable", usable))
    # equal vectors of a label are one class
    classes = write_shared(rows.filter("usable").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")))
    plan = make_plan(classes.count(), threshold, miss)
    codes = write_shared(classes.select("id", "label", "dim", "embedding").mapInArrow(
        partial(_encode, plan=plan), "id long, label string, dim int, code binary, factor double, small binary, "
                                     "step double, bands array<long>"))
    bucket = ["label", "dim", "t", "band"]
    posts = codes.select("id", "label", "dim", F.posexplode("bands").alias("t", "band"))
    sizes = posts.groupBy(bucket).agg(F.count("*").alias("m")).filter("m > 1")
    parts = F.ceil(F.col("m") / block_rows).cast("int")
    posts = posts.join(sizes, bucket).withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    posts = posts.select("id", "t", "block", (F.col("parts") > 1).alias("split"), (lo != hi).alias("cross"),
                         F.xxhash64(*bucket, lo, hi).alias("group"))
    carried = posts.join(codes.drop("bands", "label"), "id")
    near = (carried.repartition("group").sortWithinPartitions("group")
            .select("group", "id", "dim", "t", "block", "cross", "code", "factor", "small", "step")
            .mapInArrow(partial(_estimate, plan=plan), "a long, b long"))
    near = write_shared(near.distinct())
    side = lambda a, x: classes.select(F.col("id").alias(a), F.col("embedding").alias(x), F.col("label").alias(f"l{a}"),
                                       F.col("dim").alias(f"d{a}"))
    paired = near.join(side("a", "xa"), "a").join(side("b", "xb"), "b").filter("la = lb and da = db")
    links = write_shared(paired.select("a", "b", "xa", "xb", F.col("da").alias("dim")).mapInArrow(
        partial(_exact, threshold=threshold), "a long, b long").distinct())
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(
        F.sum("copies").alias("others"))
    found = classes.join(others, F.col("id") == F.col("a"), "left").join(
        components(links).withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    out = rows.join(found, F.col("usable") & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    low = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), low.alias("component_id"),
                      F.coalesce(F.col("vec_id") == low, F.lit(True)).alias("kept"))


def op2_embedding(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
