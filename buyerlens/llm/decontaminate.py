"""Benchmark decontamination by greedy string tiling (operator 7).

Documents and benchmark items are sequences of word hashes (lower-cased A-Z,
punctuation at word ends ignored).  Runs of ``seed`` words that a document
shares with an item make the item a candidate.  Running-Karp-Rabin greedy
string tiling then marks the longest non-overlapping common runs, longest
first, down to ``seed`` words; a document contains an item when the tiles
cover at least ``coverage`` of the item's words, in whatever order the
passages stand.

The benchmark is a stated query set: it is sent to the tasks in blocks of at
most ``block_words`` words (so each broadcast is bounded) and every block is
run against all rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buyerlens.llm.text import FOLDED_BYTE, column_bytes, grams, row_groups, span_hashes, word_spans
from buyerlens.session import ship_package

SEED, COVERAGE, BLOCK_WORDS = 4, 0.6, 2_000_000
#: Punctuation dropped at both ends of a word.
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word without the punctuation at its ends, and each row's word range."""
    s, e = word_spans(data, offsets)
    s, e = s.copy(), e.copy()
    while len(s):
        cut = (s < e) & _PUNCT[data[np.minimum(s, len(data) - 1)]]
        if not cut.any():
            break
        s[cut] += 1
    while len(s):
        cut = (s < e) & _PUNCT[data[np.maximum(e - 1, 0)]]
        if not cut.any():
            break
        e[cut] -= 1
    full = s < e
    s, e = s[full], e[full]
    return span_hashes(data, s, e, FOLDED_BYTE), np.searchsorted(s, offsets)


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-hash sequences: ``(item_pos, text_pos, length)``
    of non-overlapping common runs of at least ``least`` words, longest first
    (ties by item position, then text position).

    The search length starts at the item's length.  Each pass hashes all
    unmarked runs of that length in both (Karp-Rabin), extends the equal ones
    to maximal matches and, if one is over twice as long, restarts from its
    length; otherwise it marks the matches and lowers the length.
    """
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = min(len(item), len(text), 64)
    while size >= least:
        gi, gt = grams(item, size), grams(text, size)
        open_i = np.convolve(free_i, np.ones(size, np.int64), "valid") == size
        open_t = np.convolve(free_t, np.ones(size, np.int64), "valid") == size
        at = {}
        for p in np.flatnonzero(open_i):
            at.setdefault(int(gi[p]), []).append(int(p))
        hits = np.flatnonzero(open_t & np.isin(gt, np.array(list(at), np.uint64)))
        found, longest = [], 0
        for q in hits.tolist():
            for p in at[int(gt[q])]:
                # a run that continues a match to its left belongs to that match
                if p and q and free_i[p - 1] and free_t[q - 1] and item[p - 1] == text[q - 1]:
                    continue
                n = size
                while (p + n < len(item) and q + n < len(text) and free_i[p + n] and free_t[q + n]
                       and item[p + n] == text[q + n]):
                    n += 1
                found.append((-n, p, q))
                longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        cut = False
        for n, p, q in sorted(found):
            n = -n
            if free_i[p:p + n].all() and free_t[q:q + n].all():
                free_i[p:p + n] = False
                free_t[q:q + n] = False
                tiles.append((p, q, n))
            else:
                cut = True
        if cut:  # what a tile of this pass left of another match can still be long enough
            continue
        size = size // 2 if size > 2 * least else (least if size > least else 0)
    return tiles


class _Items:
    """A block of the benchmark: word sequences and a sorted seed index."""

    def __init__(self, rows, seed: int):
        rows = [(i, t) for i, t in rows]
        data, offsets = column_bytes(pa.array([t for _, t in rows], pa.string()))
        h, at = word_codes(data, offsets)
        self.ids = [i for i, _ in rows]
        self.words = [h[at[k]:at[k + 1]] for k in range(len(rows))]
        key, owner = [], []
        for k, w in enumerate(self.words):
            n = min(seed, len(w))
            if n:
                g = np.unique(grams(w, n))
                key.append(g)
                owner.append(np.full(len(g), k))
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < seed})
        self.key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        turn = np.argsort(self.key, kind="stable")
        self.key, self.owner = self.key[turn], owner[turn]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.key >> np.uint64(42)).astype(np.int64)] = True


def _matches(h, at, items: _Items, seed: int):
    """Row, item number and shared seed positions of every candidate."""
    for n in [seed, *items.short]:
        g = grams(h, n)
        if not len(g) or not len(items.key):
            continue
        pos = np.flatnonzero(items.sieve[(g >> np.uint64(42)).astype(np.int64)])
        lo = np.searchsorted(items.key, g[pos], side="left")
        hi = np.searchsorted(items.key, g[pos], side="right")
        keep = hi > lo
        pos, lo, hi = pos[keep], lo[keep], hi[keep]
        row = np.searchsorted(at, pos, side="right") - 1
        inside = pos + n <= at[row + 1]
        hit: dict[tuple[int, int], list[int]] = {}
        for p, r, a, b in zip(pos[inside].tolist(), row[inside].tolist(), lo[inside].tolist(), hi[inside].tolist()):
            for k in items.owner[a:b].tolist():
                if min(seed, len(items.words[k])) == n:
                    hit.setdefault((r, k), []).append(p - int(at[r]))
        yield from ((r, k, n, p) for (r, k), p in hit.items())


def _near(doc: np.ndarray, seeds: list[int], n: int) -> np.ndarray:
    """The document's words that lie in shared seeds; gaps become one separator each,
    so that no run continues across them."""
    inside = np.zeros(len(doc) + 1, np.int64)
    p = np.array(seeds)
    np.add.at(inside, p, 1)
    np.add.at(inside, p + n, -1)
    keep = np.cumsum(inside[:-1]) > 0
    gap = ~keep & np.concatenate([[False], keep[:-1]])
    out = np.where(keep, doc, np.uint64(0))
    return out[keep | gap]


def tilings(batch_text, items: _Items, seed: int, coverage: float):
    """``(row, item number, tiles, covered words, item words)`` at or above ``coverage``."""
    data, offsets = column_bytes(batch_text)
    for i, j in row_groups(offsets):
        h, at = word_codes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        for r, k, n, seeds in _matches(h, at, items, seed):
            item = items.words[k]
            doc = h[at[r]:at[r + 1]]
            if n * len(seeds) < coverage * len(item):  # each shared seed covers n words at most
                continue
            tiles = tile(item, _near(doc, seeds, n), min(n, len(item)))
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(item):
                yield i + r, k, len(tiles), covered, len(item)


def _report(batches, items, seed: int, coverage: float):
    for batch in batches:
        ids = batch.column("doc_id")
        found = list(tilings(batch.column("text"), items.value, seed, coverage))
        rows = [f[0] for f in found]
        yield pa.RecordBatch.from_arrays([
            ids.take(pa.array(rows, pa.int64())), pa.array([items.value.ids[f[1]] for f in found], pa.int64()),
            pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()),
            pa.array([f[4] for f in found], pa.int64()), pa.array([f[3] / f[4] for f in found], pa.float64())],
            ["doc_id", "item_id", "n_tiles", "n_covered", "n_words", "coverage"])


def _drop(batches, items, seed: int, coverage: float):
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for f in tilings(batch.column(batch.schema.get_field_index("text")), items.value, seed, coverage):
            keep[f[0]] = False
        yield batch.filter(pa.array(keep))


def _blocks(benchmark: DataFrame, seed: int, block_words: int):
    """The benchmark's items, streamed to the driver and packed into bounded blocks."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")) \
        .filter("text is not null").orderBy("item_id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["text"].split())
        if block and size + n > block_words:
            yield _Items(block, seed)
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield _Items(block, seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` and item of ``benchmark(item_id, text)`` whose tiles
    cover at least ``coverage`` of the item: ``doc_id, item_id, n_tiles, n_covered, n_words, coverage``.

    Items of fewer than ``seed`` words must occur whole; items and documents
    without words match nothing; repeated rows are reported each; a null
    doc_id is reported as null.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    schema = "doc_id long, item_id long, n_tiles long, n_covered long, n_words long, coverage double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for k, items in enumerate(_blocks(benchmark, seed, block_words)):
        found = rows.mapInArrow(partial(_report, items=spark.sparkContext.broadcast(items), seed=seed,
                                        coverage=coverage), schema)
        out = found if k == 0 else out.unionAll(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` that contain no benchmark item, with all their columns."""
    spark = docs.sparkSession
    ship_package(spark)
    for items in _blocks(benchmark, seed, block_words):
        docs = docs.mapInArrow(partial(_drop, items=spark.sparkContext.broadcast(items), seed=seed,
                                       coverage=coverage), docs.schema)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
