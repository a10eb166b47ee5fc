import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from buyerlens.llm.sharding import assign, build_tree, descend, document_keys, grow, write_shards

SCHEMA = "doc_id long, text string, shard string"


def test_a_new_shard_takes_rows_only_into_itself():
    keys = document_keys(pa.array(range(20_000)))
    tree = build_tree(24)
    old, new = descend(keys, tree), descend(keys, grow(tree, 24))
    assert set(old) == set(range(24))
    assert all((old == new) | (new == 24)) and 500 < (new == 24).sum() < 1100
    assert max(Counter(old.tolist()).values()) < 1.2 * 20_000 / 24


def test_weights_shift_rows_only_on_their_path():
    keys = document_keys(pa.array(range(20_000)))
    old, new = descend(keys, build_tree(24)), descend(keys, build_tree(24, weights={5: 3.0}))
    moved = old != new
    region, rack = old // 8, old // 4
    # nothing moves between two subtrees whose weights stayed
    assert all((new[moved] // 8 == 0))
    assert all((new[moved & (region == 0)] // 4 == 1))
    assert all(new[moved & (rack == 1)] == 5)
    assert (new == 5).sum() > 2 * (old == 5).sum()
    assert not (descend(keys, build_tree(24, weights={5: 0.0})) == 5).any()


def test_assignment_columns(spark):
    data = [(i, "é" * (i % 50), "x") for i in range(3000)] + [(7, "same", "")] * 5 + [(None, None, ""), (None, "n", "")]
    out = assign(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(out) == len(data)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in data)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    for s in range(24):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    by_id = {}
    for r in out:
        assert by_id.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    keys = descend(document_keys(pa.array([0, 1, 2], pa.int64())), build_tree(24))
    assert [by_id[i][0] for i in range(3)] == keys.tolist()
    assert assign(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slots_have_no_gaps_over_many_buckets(spark):
    df = spark.range(120_000).selectExpr("id doc_id", "cast(id as string) text")
    out = assign(df, shards=2).groupBy("shard").agg({"slot": "max", "doc_id": "count"}).collect()
    assert all(r["max(slot)"] + 1 == r["count(doc_id)"] for r in out)
    assert assign(df, shards=2).select("shard", "slot").distinct().count() == 120_000


def test_shard_files(spark, tmp_path):
    df = spark.range(100).selectExpr("id doc_id", "cast(id as string) text")
    write_shards(df, str(tmp_path / "out"), 24)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    shard = descend(document_keys(pa.array(range(100))), build_tree(24))
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == dict(enumerate(shard.tolist()))
