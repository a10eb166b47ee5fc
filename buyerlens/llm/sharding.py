"""Sharding by a hierarchical weighted hash tree (operator 6).

A document descends region, rack and shard levels.  At each node every child
draws ``-ln(u) / weight`` with ``u`` hashed from the document id and the
child's path, and the smallest draw wins.  Draws of a child depend on nothing
but the document and that child, so a changed weight moves documents only
into or out of the subtrees on its path, and a shard added as a subtree of
its own takes documents only into itself.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from buyerlens.llm.text import U64, mix
from buyerlens.session import ship_package, write_shared

#: Rows of a shard that one task numbers at a time, on average.
SLOT_ROWS = 4000


@dataclass
class Node:
    """An inner node has children and the sum of their weights; a leaf is a shard."""
    path: str
    own: float = 1.0
    shard: int | None = None
    children: list["Node"] = field(default_factory=list)

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own

    def seed(self) -> np.uint64:
        return mix(np.array([zlib.crc32(self.path.encode()) * 0x9E3779B97F4A7C15 & (2**64 - 1)], np.uint64))[0]


def build_tree(shards: int, racks: int = 2, per_rack: int = 4, weights: dict[int, float] | None = None) -> Node:
    """Regions of ``racks`` x ``per_rack`` shards, filled in shard order."""
    root = Node("root")
    for s in range(shards):
        rack, region = s // per_rack, s // (per_rack * racks)
        if not root.children or root.children[-1].path != f"r{region}":
            root.children.append(Node(f"r{region}"))
        at = root.children[-1]
        if not at.children or at.children[-1].path != f"r{region}/k{rack}":
            at.children.append(Node(f"r{region}/k{rack}"))
        at.children[-1].children.append(Node(f"shard{s}", (weights or {}).get(s, 1.0), s))
    return root


def grow(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own: no other node's weight changes."""
    leaf = Node(f"shard{shard}", weight, shard)
    return Node(root.path, root.own, None, [*root.children, Node(f"grown{shard}", children=[
        Node(f"grown{shard}/k", children=[leaf])])])


def descend(keys: np.ndarray, root: Node) -> np.ndarray:
    """Shard of each hashed document key."""
    out = np.full(len(keys), -1, np.int32)
    stack = [(root, np.arange(len(keys)))]
    while stack:
        node, rows = stack.pop()
        if not node.children:
            out[rows] = node.shard
            continue
        live = [c for c in node.children if c.weight > 0]
        best, pick = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        for k, child in enumerate(live):
            u = ((mix(keys[rows] ^ child.seed()) >> U64(11)).astype(float) + 0.5) / 2.0 ** 53
            straw = -np.log(u) / child.weight
            low = straw < best
            best[low], pick[low] = straw[low], k
        stack += [(child, rows[pick == k]) for k, child in enumerate(live)]
    return out


def document_keys(ids: pa.Array) -> np.ndarray:
    """Hashed id; all null ids share one key."""
    missing = np.asarray(ids.is_null())
    raw = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
    return np.where(missing, U64(0x5851F42D4C957F2D), mix(raw + U64(0x9E3779B97F4A7C15)))


def _place(batches, tree: Node, grown: Node):
    for batch in batches:
        keys = document_keys(batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(descend(keys, tree)), pa.array(descend(keys, grown))],
            [*batch.schema.names, "shard", "grown_shard"])


def place(docs: DataFrame, tree: Node, grown: Node) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` appended (columns of these names are replaced)."""
    ship_package(docs.sparkSession)
    docs = docs.drop("shard", "grown_shard")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(partial(_place, tree=tree, grown=grown), f"{fields}, shard int, grown_shard int")


def assign(docs: DataFrame, shards: int = 24, weights: dict[int, float] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs(doc_id, text)``.

    Law ``key``: doc_id and the shard count decide the shard, and with one more shard rows move only
    into it.  ``size`` is the text's UTF-8 bytes (null: none) plus 8 and ``text_crc32`` the CRC of
    those bytes.  Slots number each shard's rows from 0 without gaps; rows that are equal in id, size
    and CRC are numbered together.  Null ids go to one shard.  Other columns are ignored.
    """
    tree = build_tree(shards, weights=weights)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    placed = write_shared(place(rows, tree, grow(tree, shards)))
    total = placed.count()
    buckets = max(1, total // (SLOT_ROWS * shards))
    own = ["doc_id", "size", "text_crc32"]
    # equal rows are counted first, so a repeated row cannot fill a bucket
    distinct = placed.groupBy(*own, "shard", "grown_shard").agg(F.count("*").alias("copies")).withColumn(
        "bucket", F.pmod(F.xxhash64(*own), F.lit(buckets)))
    distinct = write_shared(distinct)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = distinct.groupBy("shard", "bucket").agg(F.sum("copies").alias("m")).select(
        "shard", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "bucket").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    numbered = distinct.withColumn("first", F.coalesce(F.sum("copies").over(inner), F.lit(0))).join(base, ["shard", "bucket"])
    start = F.col("base") + F.col("first")
    return numbered.withColumn("slot", F.explode(F.sequence(start, start + F.col("copies") - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, weights: dict[int, float] | None = None) -> None:
    """Write ``docs`` as Parquet, one folder per shard."""
    tree = build_tree(shards, weights=weights)
    place(docs, tree, grow(tree, shards)).drop("grown_shard").write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
