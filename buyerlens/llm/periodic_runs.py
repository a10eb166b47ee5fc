"""Periodic run detection by online dyadic square catching (operator 11).

A run is a maximal stretch of words that repeats with a smallest period and
holds at least two periods (a square).  Whenever a block of ``B = 2**k`` words
is complete, a catcher watches it: each appended word ends a new suffix of
``B`` words, and while that suffix starts ``2B - 1`` to ``4B - 2`` words after
the block it is compared with it.  Every stretch of ``2B - 1`` words holds an
aligned block, so each square of such a period is caught by the first block of
its first half.  At any word three catchers of a level are live, so a text of
``n`` words costs ``O(n log n)`` suffix comparisons.

Suffixes are compared by hashes that double with the level, and all live
catchers advance over a batch of texts at once (unique words between the texts
keep squares inside them).  Caught squares of neighbouring blocks are merged,
grown word by word to both sides and kept if they hold two periods.  A catcher
whose block lies in a run of period ``q <= B / 2`` would report every multiple
of ``q``: those inside that run are dropped, and those in another run of equal
words are kept only where they can be squares.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from buyerlens.llm.text import U64, column_bytes, mix, row_groups, words
from buyerlens.session import ship_package

MIN_LENGTH = 12
#: Bytes of text whose catchers advance together, or one longer text.
GROUP_BYTES = 1 << 20
#: Suffix comparisons made in one vector operation.
CELLS = 1 << 18
#: Words compared one step at a time before the rest of a square is compared in slices.
STEPS = 32


def _suffix_hits(h: np.ndarray, blocks: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks ``l`` and distances ``p`` in ``[2 size - 1, 4 size - 2]`` whose suffix hashes agree."""
    lo = 2 * size - 1
    found_l, found_p = [], []
    if size <= 16:  # few distances: one pass over the blocks for each
        for p in range(lo, 4 * size - 1):
            at = blocks[blocks + p + size <= n]
            hit = at[h[at] == h[at + p]]
            found_l.append(hit)
            found_p.append(np.full(len(hit), p, np.int64))
    else:
        rows = max(1, CELLS // (2 * size))
        reach = np.arange(lo, 4 * size - 1)
        for i in range(0, len(blocks), rows):
            at = blocks[i:i + rows]
            if at[-1] - at[0] == (len(at) - 1) * size and at[-1] + 4 * size - 2 < len(h):
                s = h.strides[0]
                seen = np.lib.stride_tricks.as_strided(h[at[0] + lo:], (len(at), 2 * size), (size * s, s))
                b, d = np.nonzero(seen == h[at][:, None])
            else:
                to = at[:, None] + reach
                b, d = np.nonzero((to + size <= n) & (h[np.minimum(to, len(h) - 1)] == h[at][:, None]))
            found_l.append(at[b])
            found_p.append(d + lo)
    return np.concatenate(found_l), np.concatenate(found_p)


def _inside(runs: np.ndarray, size: int, n: int) -> np.ndarray:
    """For every window of ``size`` words the run of period at most ``size / 2`` that holds it, or -1."""
    out = np.full(n, -1, np.int64)
    pick = np.flatnonzero((2 * runs[:, 2] <= size) & (runs[:, 1] - runs[:, 0] >= size))
    count = runs[pick, 1] - runs[pick, 0] - size + 1
    if len(pick):
        shift = np.repeat(np.cumsum(count) - count, count)
        out[np.arange(count.sum()) - shift + np.repeat(runs[pick, 0], count)] = np.repeat(pick, count)
    return out


def _drop_multiples(runs, l, p, size, n):
    """Caught pairs without those that a run of a shorter period already explains."""
    if not len(l) or not len(runs):
        return l, p
    home = _inside(runs, size, n)
    a, b = home[l], home[l + p]
    first, second = runs[np.maximum(a, 0)], runs[np.maximum(b, 0)]
    begin, stop = np.maximum(first[:, 0], second[:, 0] - p), np.minimum(first[:, 1], second[:, 1] - p)
    # runs of equal words agree exactly where both last, unless they begin or end together
    together = (first[:, 0] == second[:, 0] - p) | (first[:, 1] == second[:, 1] - p)
    keep = (a < 0) | (b < 0) | ((a != b) & (together | (stop - begin >= p)))
    return l[keep], p[keep]


def _grow(w: np.ndarray, at: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
    """First position from ``at`` in the direction of ``step`` where a word differs from that ``p`` later."""
    at, n = at.copy(), len(w)
    live = np.arange(len(at))
    for _ in range(STEPS):
        x = at[live]
        ok = (x >= 0) & (x + p[live] < n)
        live, x = live[ok], x[ok]
        live = live[w[x] == w[x + p[live]]]
        if not len(live):
            return at
        at[live] += step
    for i in live.tolist():
        x, d, size = int(at[i]), int(p[i]), STEPS
        while True:
            if step > 0:
                stop = min(x + size, n - d)
                diff = np.flatnonzero(w[x:stop] != w[x + d:stop + d])
                done, x = (True, x + int(diff[0])) if len(diff) else (stop == n - d, stop)
            else:
                stop = max(x - size, -1)
                diff = np.flatnonzero(w[stop + 1:x + 1] != w[stop + 1 + d:x + 1 + d])
                done, x = (True, stop + 1 + int(diff[-1])) if len(diff) else (stop == -1, stop)
            if done:
                break
            size *= 2
        at[i] = x
    return at


def find_runs(w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows ``start, stop, period`` of all runs of two or more periods in ``w``.

    ``w`` holds 64-bit words of several texts, text ``i`` in ``[bounds[i], bounds[i + 1] - 1)``
    followed by one word that occurs nowhere else.
    """
    n = len(w)
    runs = np.zeros((0, 3), np.int64)
    lengths = np.diff(bounds) - 1
    h, size = w, 1
    while n and 2 * (2 * size - 1) <= lengths.max():
        blocks = np.arange(0, n - size + 1, size)
        text = np.searchsorted(bounds, blocks, side="right") - 1
        blocks = blocks[lengths[text] >= 2 * (2 * size - 1)]
        l, p = _suffix_hits(h, blocks, size, n)
        l, p = _drop_multiples(runs, l, p, size, n)
        if len(l):
            order = np.lexsort((l, p))
            l, p = l[order], p[order]
            new = np.ones(len(l), bool)
            new[1:] = (p[1:] != p[:-1]) | (l[1:] != l[:-1] + size)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(l)) - 1
            period = p[first]
            start = _grow(w, l[first] - 1, period, -1) + 1
            stop = _grow(w, l[last] + size, period, 1) + period
            square = stop - start >= 2 * period
            # a stretch that is already a run, or caught with several distances, keeps its smallest period
            caught = np.concatenate([runs, np.stack([start, stop, period], 1)[square]])
            order = np.lexsort((caught[:, 2], caught[:, 1], caught[:, 0]))
            caught = caught[order]
            keep = np.ones(len(caught), bool)
            keep[1:] = (caught[1:, 0] != caught[:-1, 0]) | (caught[1:, 1] != caught[:-1, 1])
            runs = caught[keep]
        m = n - 2 * size + 1
        if m <= 0:
            break
        # windows of twice the size; 0 stands for a window that is not complete yet
        longer = np.zeros(n, np.uint64)
        longer[:m] = mix(h[:m] * U64(0xD6E8FEB86659FD93) + h[size:size + m])
        h, size = longer, 2 * size
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapsed(raw: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    parts = [b" ".join([raw[a:b] for a, b in zip(s[i:i + 65536].tolist(), e[i:i + 65536].tolist())])
             for i in range(0, len(s), 65536)]
    return b" ".join(parts)


def _rows(batches, min_length: int):
    for batch in batches:
        ids, col = batch.column("doc_id"), batch.column("text")
        data, offsets = column_bytes(col)
        for i, j in row_groups(offsets, GROUP_BYTES):
            part = data[offsets[i]:offsets[j]]
            h, s, e, ends = words(part, offsets[i:j + 1] - offsets[i])
            k = j - i
            # every text is followed by a word of its own
            bounds = ends + np.arange(k + 1)
            w = np.empty(len(h) + k, np.uint64)
            own = bounds[1:] - 1
            is_word = np.ones(len(w), bool)
            is_word[own] = False
            w[is_word] = h
            w[own] = mix(np.arange(k, dtype=np.uint64) + U64(0xA5A5A5A500000000))
            runs = find_runs(w, bounds)
            runs = runs[runs[:, 1] - runs[:, 0] >= min_length]
            text = np.searchsorted(bounds, runs[:, 0], side="right") - 1
            edge = np.zeros(len(w) + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 1], -1)
            kept = np.cumsum(edge)[:-1][is_word] == 0
            raw = part.tobytes()
            collapsed = []
            for t in range(k):
                a, b = ends[t], ends[t + 1]
                stay = kept[a:b]
                collapsed.append(_collapsed(raw, s[a:b][stay], e[a:b][stay]))
            cuts = np.searchsorted(text, np.arange(k + 1))
            found = pa.StructArray.from_arrays(
                [pa.array(runs[:, 0] - bounds[text]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
                ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, k), pa.array(np.diff(ends), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs(doc_id, text)``.

    ``runs`` are the stretches of at least ``min_length`` words and two periods, by start and period;
    ``collapsed`` is the text without the words that some run holds after its first period, its
    words joined by one space.  Null and empty texts have no run and collapse to the empty text.
    Rows with null or repeated doc_id are texts like any other; other columns are ignored.
    A text is searched whole: a task holds about 60 bytes for each word of the texts it works on.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_rows, min_length=min_length),
                           "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped_text(doc_id: Column, text: Column) -> Column:
    """The text of the contract: documents whose hash ends in 0 repeat the words from one on.

    With ``h`` the CRC-32 of the decimal id and ``g = h // 10``, texts of ``n > 0`` words with
    ``h % 10 = 0`` continue from word ``a = g % n`` with period ``1 + (n - a) // (3 + g % 8)``.
    A null id has no hash: its text stays.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size(found)

    def looped(parts):
        n = F.size(parts["w"])
        a = parts["g"] % n
        p = 1 + F.floor((n - a) / (3 + parts["g"] % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")),
                         lambda i: F.get(parts["w"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.array_join(at, " ")

    struct = F.struct(found.alias("w"), F.floor(h / 10).alias("g"))
    return F.when((h % 10 == 0) & (n > 0), F.element_at(F.transform(F.array(struct), looped), 1)).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", looped_text(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("neg"), r["start"].alias("start"),
                                                              r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                  r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.neg")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(-1000 * best.neg) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
