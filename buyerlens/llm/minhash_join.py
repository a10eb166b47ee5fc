"""MinHash near-duplicate groups by a signature-coordinate inverted join (operator 9).

Every text becomes its set of word shingles and a signature of ``coords``
minima.  Texts with equal sets form one class, and one signature per class is
posted under each (coordinate, value) pair it shares with another class.  Two
classes can match on ``matches`` coordinates only if each has that many shared
pairs and both post the rarest pair they have in common, so a class posts only
the rarest ``c - matches + 1`` of its ``c`` shared pairs (prefix) and classes
with fewer shared pairs are skipped.  Collisions of the remaining candidate
pairs are counted on whole signatures; pairs at or above ``matches`` are
confirmed on the full shingle sets.

Pairs are met inside tasks and bounded before they become rows: the shingles of
a class are counted in ``SKETCH`` hash buckets, and the sum of the bucket-wise
minima of two classes is at least their intersection.  Pairs whose bound stays
below the threshold are not made, so near copies that differ too much cost
neither rows nor shuffles.

A posting list does not compare all its pairs.  First every member meets the
list's smallest id.  Then the members outside the list's largest component meet
the members of other components; lists that became one component are skipped.
So a group of m near copies costs about m comparisons, while no link between
two components is left unchecked.

A link of Jaccard 0.8 is missed only if fewer than ``matches`` of ``coords``
coordinates agree (16 of 36: about 1e-6).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buyerlens.llm.graph import components
from buyerlens.llm.text import U64, column_bytes, grams, mix, row_groups, words
from buyerlens.session import write_shared

COORDS, MATCHES = 36, 16
SKETCH_BITS = 8
SKETCH = 1 << SKETCH_BITS
#: Members of a posting list that one group of a task sees, on average.
LIST_ROWS = 1000
#: Leaders that one group of a task holds, on average.
LEADERS = 512


def shingle_sets(data, offsets, k: int):
    """Sorted distinct shingle hashes of each row (fewer than ``k`` words: one
    shingle of the whole sequence; no words: empty)."""
    h, _, _, rows = words(data, offsets, fold=True)
    g = grams(h, k)
    for i in range(len(rows) - 1):
        a, b = rows[i], rows[i + 1]
        if b - a >= k:
            yield np.unique(g[a:b - k + 1])
        elif b > a:
            yield grams(h[a:b], b - a) ^ U64(b - a)
        else:
            yield g[:0]


def _coefficients(coords: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * coords + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    return seed[:coords, None] | U64(1), seed[coords:, None]


def signature(s: np.ndarray, coords: int) -> np.ndarray:
    """``coords`` minima of multiply-add permutations of the shingle hashes."""
    a, b = _coefficients(coords)
    low = np.full(coords, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[None, i:i + 2048] * a + b).min(axis=1), out=low)
    return (low >> U64(32)).astype(np.uint32).view(np.int32)


def _sign(batches, k: int, coords: int):
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        size, k1, k2, sig = [], [], [], []
        for i, j in row_groups(offsets):
            for s in shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], k):
                size.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64)))
                k2.append(int(mix(s).sum(dtype=np.uint64)))
                sig.append(signature(s, coords) if len(s) else None)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(size, pa.int64()),
            pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)),
            pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "k1", "k2", "sig"])


def _sets(batches, k: int, coords: int):
    """Set, signature and bucket counts of each posted class."""
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        sets = [s for i, j in row_groups(offsets)
                for s in shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], k)]
        counts = [np.bincount((s >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=SKETCH).astype(np.uint32) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()),
             pa.array([signature(s, coords).tobytes() for s in sets], pa.binary()),
             pa.array([c.tobytes() for c in counts], pa.binary())], ["id", "set", "sig", "sketch"])


def _meet(batches, percent: int):
    """Pairs of a leader and a member of one posting list, in different components, whose bound reaches
    the threshold.  Rows come sorted by list, leaders first; leaders are held, members streamed.  If rows
    name the tokens they post, a pair is made only in the list of the smallest token both post."""
    group, held = None, None
    for batch in batches:
        key, member = np.asarray(batch.column("list")), np.asarray(batch.column("member"))
        ids, part = np.asarray(batch.column("id")), np.asarray(batch.column("component"))
        size = np.asarray(batch.column("n"))
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
        token, posted = np.asarray(batch.column("token")), np.empty(len(key), object)
        for r, t in enumerate(batch.column("posted").to_pylist()):
            posted[r] = t
        out_a, out_b = [], []
        edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (member[1:] != member[:-1])) + 1, [len(key)]])
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            if key[lo] != group:
                group, held = key[lo], None
            now = (ids[lo:hi], part[lo:hi], size[lo:hi], sketch[lo:hi], posted[lo:hi])
            if not member[lo]:
                held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            elif held is not None:
                for i, p, n, s, t in zip(*held):
                    both = np.minimum(now[3], s).sum(axis=1, dtype=np.int64)
                    hit = (now[1] != p) & (100 * both >= percent * (now[2] + n - both))
                    if t is not None and hit.any():
                        hit = np.flatnonzero(hit)
                        t = set(t)
                        hit = hit[[min(t.intersection(x)) == token[lo] for x in now[4][hit]]]
                    out_a.append(np.minimum(now[0][hit], i))
                    out_b.append(np.maximum(now[0][hit], i))
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def _confirm(batches, percent: int, matches: int):
    """Pairs with ``matches`` equal coordinates at least and 100 * |intersection| >= percent * |union|."""
    for batch in batches:
        keep = []
        for ga, gb, sa, sb in zip(*(batch.column(c) for c in ("ga", "gb", "sa", "sb"))):
            if (np.frombuffer(ga.as_buffer(), np.int32) == np.frombuffer(gb.as_buffer(), np.int32)).sum() < matches:
                keep.append(False)
                continue
            x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80,
                    coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Words are lower-cased (A-Z) runs of non-space bytes.  Rows link when
    100 * |A & B| >= percent * |A | B| on their shingle sets; ``component_id``
    is the smallest doc_id reachable by links and ``kept`` marks that row.
    Texts without words (null, empty, blank) link with nothing.  Rows with a
    repeated doc_id count as one document; rows with a null doc_id link with
    nothing, get a null component and are kept.  Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = write_shared(base.mapInArrow(
        partial(_sign, k=shingle, coords=coords),
        "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>"))
    classes = write_shared(rows.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.first("sig").alias("sig")))
    links = _links(base, classes, shingle, percent, coords, matches)
    found = rows.drop("sig").join(classes.select("k1", "k2", "id"), ["k1", "k2"], "left")
    found = found.join(links, "id", "left")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    low = F.when(known, F.coalesce("component", "id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", low.cast("long").alias("component_id"),
                        F.coalesce(F.col("doc_id") == low, F.lit(True)).alias("kept"))


def _links(base: DataFrame, classes: DataFrame, shingle: int, percent: int,
           coords: int, matches: int) -> DataFrame:
    """``(id, component)`` of the classes that link with another one."""
    key = ["pos", "val"]
    tokens = classes.select("id", "n", F.posexplode("sig").alias("pos", "val"))
    often = tokens.groupBy(key).agg(F.count("*").alias("df")).filter("df > 1")
    lists = (tokens.join(often, key).groupBy("id", "n")
             .agg(F.sort_array(F.collect_list(F.struct("df", "pos", "val"))).alias("t"))
             .filter(F.size("t") >= matches))
    posts = lists.select("id", "n", F.explode(F.slice("t", F.lit(1), F.size("t") - (matches - 1))).alias("t")) \
        .select("id", "n", "t.pos", "t.val")
    posts = write_shared(posts)
    posts = write_shared(posts.join(posts.groupBy(key).count().filter("count > 1").select(key), key))
    ids = posts.select("id").distinct()
    sets = write_shared(base.join(ids, base.doc_id == ids.id, "left_semi").mapInArrow(
        partial(_sets, k=shingle, coords=coords), "id long, set binary, sig binary, sketch binary").distinct())
    token = F.xxhash64(*key).alias("token")
    posted = posts.groupBy("id").agg(F.collect_set(token).alias("posted"))
    sketches = sets.select("id", "sketch", F.lit(None).cast("array<long>").alias("posted"))
    sketched = write_shared(sets.select("id", "sketch").join(posted, "id"))

    def linked(rows, sketches):
        """Confirmed pairs of ``list, member, token, id, n, component`` rows."""
        near = (rows.join(sketches, "id").repartition("list").sortWithinPartitions("list", "member")
                .mapInArrow(partial(_meet, percent=percent), "a long, b long").distinct())
        side = lambda x: sets.select(F.col("id").alias(x), F.col("sig").alias(f"g{x}"), F.col("set").alias(f"s{x}"))
        return write_shared(near.join(side("a"), "a").join(side("b"), "b").mapInArrow(
            partial(_confirm, percent=percent, matches=matches), "a long, b long"))

    row = ["id", "n", "component", token]
    salt = F.pmod(F.xxhash64("id"), "salts").cast("int")
    # 1. members of each list against its smallest id
    first = posts.groupBy(key).agg(F.min("id").alias("first"), F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("salts"))
    state = posts.join(first, key).withColumn("component", F.col("id"))
    lead = F.explode(F.when(F.col("id") == F.col("first"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array()))
    found = linked(state.select(*row, F.xxhash64(*key, salt).alias("list"), F.lit(True).alias("member")).unionAll(
        state.withColumn("salt", lead).select(*row, F.xxhash64(*key, "salt").alias("list"), F.lit(False).alias("member"))), sketches)
    comp = write_shared(components(found))
    # 2. members outside a list's largest component against all others, in blocks of leaders
    state = posts.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = state.groupBy(*key, "component").agg(F.count("*").alias("m"))
    top = parts.groupBy(key).agg(
        F.max(F.struct("m", (-F.col("component")).alias("c"))).alias("x"), F.sum("m").alias("size"),
        F.count("*").alias("parts")).filter("parts > 1").select(
        *key, (-F.col("x.c")).alias("top"), F.ceil(F.col("size") / LIST_ROWS).cast("int").alias("salts"),
        F.ceil((F.col("size") - F.col("x.m")) / LEADERS).cast("int").alias("blocks"))
    state = write_shared(state.join(top, key))
    block = F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int")
    cells = lambda name, size: F.explode(F.sequence(F.lit(0), F.col(size) - 1)).alias(name)
    members = state.select(*row, *key, salt.alias("salt"), cells("block", "blocks"))
    leaders = state.filter("component <> top").select(*row, *key, cells("salt", "salts"), block.alias("block"))
    rows = [x.select(*row, F.xxhash64(*key, "salt", "block").alias("list"), F.lit(kind).alias("member"))
            for x, kind in ((members, True), (leaders, False))]
    more = linked(rows[0].unionAll(rows[1]), sketched)
    return write_shared(components(more.unionAll(comp.select(F.col("id").alias("a"), F.col("component").alias("b")))))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles at 80 percent over the whole ``documents`` table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=80)
