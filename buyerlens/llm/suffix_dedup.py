"""Exact substring dedup with a deep-shallow sorted sparse suffix array (operator 1).

A string of ``width`` bytes that starts at two or more places of the corpus is
a repeat; every byte that a repeat covers is removed.

Only suffixes at anchors are sorted.  The anchor of a window of ``width`` bytes
is its ``gram``-byte string of smallest hash, so equal windows have equal
anchors at equal offsets, and a text has one anchor in about
``(width - gram) / 2`` bytes.  Anchor strings that occur once are dropped by a
count.  The suffixes (and the reversed prefixes) at the places of each
remaining anchor string are sorted: multikey quicksort to a shallow depth,
blind tries below it.  Their common-prefix lengths to the left and right say
which windows, at which offset of the anchor, occur more than once.

Places of one anchor string above ``group`` are split: each of their windows
becomes a key of its own and equal ones are counted, so no task holds an
unbounded group.  Windows that repeat an earlier window of the same text (as
in periodic text) are found while reading it and leave one place in the index.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buyerlens.llm.text import BLOCK, RANDOM_BYTE, U64, column_bytes, mix, powers, segments_min
from buyerlens.session import ship_package, write_shared

WIDTH, GRAM, GROUP = 400, 128, 4096
#: Depth in bytes at which multikey quicksort hands over to blind tries.
SHALLOW = 24
_INDEX_BITS = 20


# --- sorting -------------------------------------------------------------------------------

def common_prefix(a: np.ndarray, b: np.ndarray, start: int = 0) -> int:
    n = min(len(a), len(b))
    if n <= start:
        return n
    diff = a[start:n] != b[start:n]
    at = int(diff.argmax())
    return start + at if diff[at] else n


def _byte(s: np.ndarray, depth: int) -> int:
    return int(s[depth]) if depth < len(s) else -1


def _blind_trie(items: list[int], strings: list[np.ndarray], depth: int) -> list[tuple[int, int]]:
    """Sorted ``(item, common prefix with the one before)`` of strings equal up to ``depth``.

    Nodes store only their depth and branching bytes.  A new string descends blindly by these,
    is compared once with the leaf it reaches, and is inserted where the two differ.
    """
    root: list = [None, items[0]]  # leaf: [None, item, equal items...]; node: [depth, {byte: child}]
    for item in items[1:]:
        s, node, path = strings[item], root, []
        while node[0] is not None:
            path.append(node)
            child = node[1].get(_byte(s, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        other = strings[node[1]]
        same = common_prefix(s, other, depth)
        if same == len(s) == len(other):
            node.append(item)
            continue
        above = None
        for parent in path:
            if parent[0] >= same:
                break
            above = parent
        below = root if above is None else above[1][_byte(s, above[0])]
        if below[0] == same:
            below[1][_byte(s, same)] = [None, item]
            continue
        node = [same, {_byte(other, same): below, _byte(s, same): [None, item]}]
        if above is None:
            root = node
        else:
            above[1][_byte(s, above[0])] = node
    out: list[tuple[int, int]] = []
    stack = [(root, depth)]
    while stack:
        node, shared = stack.pop()
        if node[0] is None:
            out.append((node[1], shared))
            out += [(k, len(strings[k])) for k in node[2:]]
        else:
            turn = sorted(node[1])
            stack += [(node[1][b], node[0]) for b in reversed(turn[1:])]
            stack.append((node[1][turn[0]], shared))
    return out


def deep_shallow_sort(strings: list[np.ndarray], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and the common prefix of each with the one before it (first: 0)."""
    out: list[tuple[int, int]] = []
    stack = [(list(range(len(strings))), 0, 0)]
    while stack:
        items, depth, shared = stack.pop()
        if len(items) == 1:
            out.append((items[0], shared))
            continue
        if depth >= shallow:
            run = _blind_trie(items, strings, depth)
            out.append((run[0][0], shared))
            out += run[1:]
            continue
        keys = [_byte(strings[k], depth) for k in items]
        pivot = sorted(keys)[len(keys) // 2]
        less = [k for k, b in zip(items, keys) if b < pivot]
        same = [k for k, b in zip(items, keys) if b == pivot]
        more = [k for k, b in zip(items, keys) if b > pivot]
        parts = []
        if less:
            parts.append((less, depth))
        if pivot < 0:  # these strings end here and are equal
            parts += [([k], depth) for k in same]
        else:
            parts.append((same, depth + 1))
        if more:
            parts.append((more, depth))
        for n, (part, d) in reversed(list(enumerate(parts))):
            stack.append((part, d, shared if n == 0 else depth))
    return np.array([k for k, _ in out], np.int64), np.array([n for _, n in out], np.int64)


def repeated_offsets(left: list[np.ndarray], right: list[np.ndarray], low: np.ndarray, high: np.ndarray,
                     tail: int) -> list[tuple[int, int, int]]:
    """``(member, first offset, last offset)`` of the windows that occur at several members.

    Member i has windows that begin ``low[i]`` to ``high[i]`` bytes before its anchor; ``left`` are the
    reversed bytes before the anchors and ``right`` the bytes after the anchor strings.  The window at
    offset o of two members is equal when ``left`` agree on o and ``right`` on ``tail - o`` bytes.
    """
    m = len(left)
    if m == 2:
        first = max(int(low.max()), tail - common_prefix(right[0], right[1]))
        last = min(int(high.min()), common_prefix(left[0], left[1]))
        return [(0, first, last), (1, first, last)] if first <= last else []
    order_r, lcp_r = deep_shallow_sort(right)
    order_l, lcp_l = deep_shallow_sort(left)
    if lcp_l[1:].min() >= high.max() and lcp_r[1:].min() >= tail - low.min() and low.min() == low.max() \
            and high.min() == high.max():
        return [(i, int(low[i]), int(high[i])) for i in range(m)]
    edges = np.unique(np.concatenate([low, high + 1, lcp_l[1:] + 1, tail - lcp_r[1:]]))
    edges = edges[(edges >= low.min()) & (edges <= high.max() + 1)]
    class_l, class_r = np.empty(m, np.int64), np.empty(m, np.int64)
    out = []
    for o, after in zip(edges[:-1].tolist(), edges[1:].tolist()):
        live = (low <= o) & (o <= high)
        if live.sum() < 2:
            continue
        class_l[order_l] = np.cumsum(lcp_l < o)
        class_r[order_r] = np.cumsum(lcp_r < tail - o)
        who = np.flatnonzero(live)
        _, code, count = np.unique(class_l[who] * (m + 1) + class_r[who], return_inverse=True, return_counts=True)
        out += [(int(i), o, after - 1) for i in who[count[code] > 1]]
    return out


# --- reading texts -------------------------------------------------------------------------

def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(RANDOM_BYTE[data] * p[:-1], out=total[1:])
    return total, q


def _substring_hashes(total: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes at every position."""
    return mix((total[n:] - total[:-n]) * q[:len(total) - n])


def block_anchors(data: np.ndarray, ends: np.ndarray, width: int, gram: int):
    """Anchors and self-repeats of one block of concatenated rows; ``ends`` are the rows' ends.

    Returns ``anchor position, first window, last window, key`` of each index entry, and
    ``first window, last window`` of runs of windows that occur twice in one row of the block.
    """
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64), none, none
    total, q = _prefix_sums(data)
    key = _substring_hashes(total, q, gram)
    mask = U64((1 << _INDEX_BITS) - 1)
    low = segments_min((key & ~mask) | np.arange(len(key), dtype=np.uint64), width - gram + 1)
    anchor = (low & mask).astype(np.int64)
    n = len(anchor)
    row_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:n]
    start = np.arange(n)
    valid = start + width <= row_end
    # runs of valid windows with one anchor
    cut = np.ones(n, bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [n]]) - 1
    good = valid[first]
    first, last = first[good], last[good]
    if not len(first):
        return none, none, none, none.astype(np.uint64), none, none
    at = anchor[first]
    # an earlier anchor of the same row with the same string: do the windows repeat there?
    k, owner = key[at], row_end[first]
    turn = np.lexsort((at, k, owner))
    twin = (k[turn][1:] == k[turn][:-1]) & (owner[turn][1:] == owner[turn][:-1])
    back = np.zeros(len(at), np.int64)
    back[turn[1:][twin]] = (at[turn][1:] - at[turn][:-1])[twin]
    again = np.zeros(n, bool)
    doubled = np.zeros(n, bool)
    shifted = np.flatnonzero(back)
    if len(shifted):
        size = last[shifted] - first[shifted] + 1
        p = np.repeat(first[shifted] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        prior = p - np.repeat(back[shifted], size)
        ok = prior >= 0
        p, prior = p[ok], prior[ok]
        window = _substring_hashes(total, q, width)
        same = (window[p] == window[prior]) & valid[prior] & (row_end[p] == row_end[prior])
        again[p[same]] = True
        doubled[p[same]] = doubled[prior[same]] = True
    fresh = valid & ~again
    if again.any():
        cut = np.ones(n, bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (fresh[1:] != fresh[:-1])
        first = np.flatnonzero(cut)
        last = np.concatenate([first[1:], [n]]) - 1
        good = fresh[first]
        first, last = first[good], last[good]
        at = anchor[first]
    edge = np.diff(np.concatenate([[0], (doubled & valid).astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    if len(lo):  # a run must not cross rows
        same_row = row_end[lo] == row_end[hi]
        if not same_row.all():
            parts = [(a, b) for a, b in zip(lo.tolist(), hi.tolist())]
            split = []
            for a, b in parts:
                while row_end[a] != row_end[b]:
                    e = int(row_end[a])
                    split.append((a, e - width))
                    a = e
                split.append((a, b))
            lo, hi = np.array([s[0] for s in split]), np.array([s[1] for s in split])
    return at, first, last, key[at], lo, hi


def _blocks(offsets: np.ndarray, width: int):
    """``(first row, row after, byte from, byte to)``: groups of rows, or overlapping parts of a long row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1, i + 1)
        j = min(j, n)
        a, end = int(offsets[i]), int(offsets[j])
        while end - a > BLOCK:
            yield i, j, a, a + BLOCK
            a += BLOCK - width + 1
        yield i, j, a, end
        i = j


def _anchor_rows(batches, width: int, gram: int):
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        parts = []
        for i, j, a, b in _blocks(offsets, width):
            ends = np.minimum(offsets[i + 1:j + 1], b) - a
            at, first, last, key, lo, hi = block_anchors(data[a:b], ends, width, gram)
            row = np.searchsorted(offsets, a + at, side="right") - 1
            base = offsets[row] - a
            parts.append((row, key.view(np.int64), np.zeros(len(at), bool), at - base, first - base, last - base))
            row = np.searchsorted(offsets, a + lo, side="right") - 1
            base = offsets[row] - a
            parts.append((row, np.zeros(len(lo), np.int64), np.ones(len(lo), bool), lo - base, lo - base, hi - base))
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column("tid").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], mask=cols[2].astype(bool)),
             *[pa.array(c, pa.int64()) for c in cols[3:]]], ["tid", "key", "at", "first", "last"])


def _cut_blocks(batches, width: int, gram: int):
    """The bytes around each remaining anchor; for anchors of split groups, one key per window."""
    names = ["key", "sub", "tid", "at", "first", "last", "left", "right"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for tid, text, places in zip(batch.column("tid").to_pylist(), batch.column("text"), batch.column("places")):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            for p in places.as_py():
                at, first, last = p["at"], p["first"], p["last"]
                if p["split"]:
                    total, q = _prefix_sums(raw[first:last + width])
                    for k, h in enumerate(_substring_hashes(total, q, width).view(np.int64).tolist()):
                        w = first + k
                        for c, v in zip(out, (p["key"], h ^ (at - w), tid, at, w, w, None, None)):
                            c.append(v)
                else:
                    row = (p["key"], None, tid, at, first, last, raw[first:at].tobytes(),
                           raw[at + gram:last + width].tobytes())
                    for c, v in zip(out, row):
                        c.append(v)
            if len(out[0]) > 20_000:
                yield _block_batch(out, names)
                out = [[] for _ in names]
        yield _block_batch(out, names)


def _block_batch(out, names):
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)


def _resolve(batches, width: int, gram: int):
    """Repeated windows of each group of places with one anchor string; rows come sorted by key."""
    held: list = []
    held_key, seen = None, set()
    for batch in batches:
        out: list = []
        cols = [batch.column(c) for c in ("tid", "at", "first", "last")]
        tid, at, first, last = (c.to_pylist() for c in cols)
        left, right = batch.column("left"), batch.column("right")
        for r, key in enumerate(batch.column("key").to_pylist()):
            if key != held_key:
                _close(held, out, width, gram)
                held, held_key, seen = [], key, set()
            place = (tid[r], at[r], first[r])
            if place not in seen:  # a text whose row is repeated with the same id comes several times
                seen.add(place)
                held.append((*place, last[r], left[r].as_py(), right[r].as_py()))
        yield _interval_batch(out)
    out = []
    _close(held, out, width, gram)
    yield _interval_batch(out)


def _close(held: list, out: list, width: int, gram: int) -> None:
    if len(held) < 2:
        return
    left = [np.frombuffer(h[4], np.uint8)[::-1] for h in held]
    right = [np.frombuffer(h[5], np.uint8) for h in held]
    low = np.array([h[1] - h[3] for h in held])
    high = np.array([h[1] - h[2] for h in held])
    for i, a, b in repeated_offsets(left, right, low, high, width - gram):
        out.append((held[i][0], held[i][1] - b, held[i][1] - a))


def _interval_batch(rows: list):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.int64())], ["tid", "first", "last"])


def merge_windows(windows: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Maximal byte runs ``[start, end)`` covered by windows that begin in the given ranges."""
    runs: list[list[int]] = []
    for first, last in sorted(windows):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + width)
        else:
            runs.append([first, last + width])
    return [(a, b) for a, b in runs]


def _cut(batches, width: int):
    for batch in batches:
        spans, kept, sha = [], [], []
        for text, windows in zip(batch.column("text"), batch.column("windows")):
            raw = text.as_py()
            runs = merge_windows([(w["first"], w["last"]) for w in windows.as_py()], width)
            rest, at = [], 0
            for a, b in runs:
                rest.append(raw[at:a])
                at = b
            rest.append(raw[at:])
            kept.append(b"".join(rest))
            sha.append(hashlib.sha256(kept[-1]).hexdigest())
            spans.append([{"start": a, "stop": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays(
            [batch.column("tid"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
             pa.array(kept, pa.binary()), pa.array(sha, pa.string())], ["tid", "spans", "kept", "kept_sha256"])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("*", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    return rows.select("*", F.substring(F.unhex("sha"), 1, 16).alias("tid"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` for every row of ``docs(doc_id, text)``.

    ``spans`` are the removed byte runs ``[start, stop)`` and ``kept`` the bytes left.  Null texts are empty; texts under ``width`` bytes keep everything; of equal
    texts of ``width`` bytes or more nothing is left.  Rows with null or repeated doc_id are texts
    like any other.  Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    base = _texts(docs)
    rows = write_shared(base.drop("text"))
    classes = rows.groupBy("tid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # 1. anchors whose string occurs at several places
    found = write_shared(base.filter(F.col("n_bytes") >= width).select("tid", "text").mapInArrow(
        partial(_anchor_rows, width=width, gram=gram), "tid binary, key long, at long, first long, last long"))
    place = F.xxhash64("tid", "at", "first")
    often = (found.filter("key is not null").groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"))
             .filter("a <> b").select("key"))
    places = write_shared(found.filter("key is not null").join(often, "key").distinct())
    large = places.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > group).select("key", F.lit(True).alias("split"))
    # 2. one row per text that has such anchors, or repeats within itself
    own = found.filter("key is null").select("tid", "first", "last").distinct()
    place = F.struct("key", "at", "first", "last", F.coalesce("split", F.lit(False)).alias("split"))
    need = (places.join(large, "key", "left").select("tid", place.alias("place"))
            .unionAll(own.select("tid", F.lit(None).alias("place")))
            .groupBy("tid").agg(F.collect_list("place").alias("places")).join(classes, "tid")
            .withColumnRenamed("tid", "need"))
    texts = write_shared(base.select("doc_id", "tid", "text").join(need, (F.col("tid") == F.col("need"))
                         & F.col("doc_id").eqNullSafe(F.col("rep"))).select("tid", "text", "copies", "places"))
    cut = write_shared(texts.select("tid", "text", "places").mapInArrow(
        partial(_cut_blocks, width=width, gram=gram),
        "key long, sub long, tid binary, at long, first long, last long, left binary, right binary"))
    # 3. repeated windows: sorted suffixes of a group, counts of split groups, repeats inside a text
    grouped = (cut.filter("sub is null").drop("sub").repartition("key").sortWithinPartitions("key")
               .mapInArrow(partial(_resolve, width=width, gram=gram), "tid binary, first long, last long"))
    single = cut.filter("sub is not null").select("key", "sub", "tid", "first")
    where = F.xxhash64("tid", "first")
    equal = (single.groupBy("key", "sub").agg(F.min(where).alias("a"), F.max(where).alias("b"))
             .filter("a <> b").select("key", "sub"))
    split = single.join(equal, ["key", "sub"]).select("tid", "first", F.col("first").alias("last"))
    windows = grouped.unionAll(split).unionAll(own).groupBy("tid").agg(
        F.collect_list(F.struct("first", "last")).alias("windows"))
    # 4. cut the texts; equal long texts lose everything
    result = texts.filter("copies = 1").select("tid", "text").join(windows, "tid").mapInArrow(
        partial(_cut, width=width),
        "tid binary, spans array<struct<start: long, stop: long>>, kept binary, kept_sha256 string")
    return _assemble(base, classes, result, width)


def _assemble(base: DataFrame, classes: DataFrame, result: DataFrame, width: int) -> DataFrame:
    out = base.join(classes.filter("copies > 1").select("tid", "copies"), "tid", "left").join(result, "tid", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    spans = F.when(gone, whole).otherwise(F.coalesce("spans", F.slice(whole, 1, 0)))
    return out.withColumn("spans", spans).select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        "spans", F.when(gone, F.lit("").cast("binary")).otherwise(F.coalesce("kept", "text")).alias("kept"))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns and ``text``, what is left of the text; bytes of characters that a cut split
    are shown as U+FFFD."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("spans", "kept")
