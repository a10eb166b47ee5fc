"""Order-preserving packing of token streams by dynamic programming (operator 12).

The documents of a partition, in the order they are read, form one token
stream that is cut into windows of at most ``window`` tokens.  A window that is
not full is padded, unless its length is a power of two.  Window ends may be
document ends (free), sentence ends (a small penalty) or, in long sentences
and in the last window of a partition, other tokens (a larger one).  With cut
positions ``c`` the cheapest way to end a window at ``i`` is

    f(i) = penalty(i) + min(window - c_i + min_j (f(j) + c_j), SHORT + min_j' f(j'))

where ``j`` ranges over cuts at most ``window`` before ``i`` (a sliding minimum,
kept in a monotone queue) and ``j'`` over the cuts at a power of two before it.

The stream is worked through a few megabytes at a time: the cheapest cut in
the last window is final, and the tokens after it open the next piece of the
stream, so a task's memory is bounded by its longest text.
"""

from __future__ import annotations

import os
from collections import deque
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from buyerlens.llm.text import column_bytes, row_groups, span_hashes
from buyerlens.session import ship_package

WINDOW = 2048
END_ID = 1
#: Penalties, in tokens of padding, of ending a window at a sentence end or within a sentence.
SENTENCE, HARD = 1, 16
#: What an unpadded sequence shorter than the window costs, so that sequences stay long.
SHORT = 64
#: Sentences above this many tokens may be cut at each such distance.
LONG_SENTENCE = 128
#: Bytes of text worked on at a time, or one longer text.
GROUP_BYTES = 4 << 20
#: Bytes handed to the tokenizer as one string, and remembered pieces at most.
ENCODE_BYTES, REMEMBERED = 1 << 16, 1_000_000
#: Sequences of one partition are numbered from its number times this.
PARTITION_SEQUENCES = 1 << 33

# Bytes that may follow a space at the start of a piece: visible ASCII and the lead bytes of
# characters that are never white space.
_STARTS = np.zeros(256, bool)
_STARTS[0x21:0x7F] = True
_STARTS[0xC3:0xF5] = True
_STARTS[[0xE1, 0xE2, 0xE3]] = False
# Marks that are split off behind an ASCII letter.
_MARKS, _LETTERS = np.zeros(256, bool), np.zeros(256, bool)
_MARKS[list(b".,;:!?")] = True
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = True


def _byte_alphabet() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write bytes with."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class WordTokenizer:
    """Ids of texts by a byte-level BPE tokenizer that splits words off before their space.

    Such a tokenizer never joins what precedes a space with the visible character after it, nor a
    letter with a punctuation mark after it, so a text's ids are those of its pieces between such
    places, and equal pieces are encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        alphabet = _byte_alphabet()
        size = max([*vocab.values(), *special]) + 1
        self.n_bytes = np.zeros(size, np.int64)
        #: whether a token ends a sentence
        self.closes = np.zeros(size, bool)
        for text, i in vocab.items():
            raw = bytes(alphabet[c] for c in text)
            self.n_bytes[i] = len(raw)
            self.closes[i] = raw.endswith((b".", b"!", b"?", "。".encode(), "！".encode(), "？".encode())) or b"\n" in raw
        for i, text in special.items():
            self.n_bytes[i] = len(text.encode())
            self.closes[i] = False
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.first = self.count = np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def _encode(self, pieces: list[bytes], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another and the number of each; ``alone`` pieces are encoded one by one."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        # strings of about ENCODE_BYTES, cut before and after every piece that is alone
        mark = np.zeros(len(pieces) + 1, bool)
        mark[:-1] |= alone
        mark[1:] |= alone
        block = (ends - sizes) // ENCODE_BYTES
        mark[1:-1] |= block[1:] != block[:-1]
        mark[[0, -1]] = True
        cuts = np.flatnonzero(mark).tolist()
        texts = [b"".join(pieces[i:j]).decode("utf-8") for i, j in zip(cuts, cuts[1:])]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        last = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, side="right")
        return ids, np.diff(last, prepend=0)

    def _learn(self, keys, place, pieces, alone):
        ids, counts = self._encode(pieces, alone)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        first = self.used + np.cumsum(counts) - counts
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.keys = np.insert(self.keys, place, keys)
        self.first, self.count = np.insert(self.first, place, first), np.insert(self.count, place, counts)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and the token number at which each text starts."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        edge = np.zeros(n, bool)
        edge[:-1] = (data[:-1] == 0x20) & _STARTS[data[1:]]
        mark = np.zeros(n, bool)
        mark[1:] = _MARKS[data[1:]] & _LETTERS[data[:-1]]
        edge |= mark
        opens = np.unique(offsets[:-1][np.diff(offsets) > 0])
        edge[opens] = True
        s = np.flatnonzero(edge)
        e = np.append(s[1:], n)
        # pieces that open a text or start with a mark might join what stands before them
        alone = mark[s]
        alone[np.searchsorted(s, opens)] = True
        h = span_hashes(data, s, e) ^ np.where(alone, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(u) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.keys, u)
        new = np.ones(len(u), bool)
        new[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] != u[place < len(self.keys)]
        if new.any():
            raw = data.tobytes()
            fresh = at[new]
            self._learn(u[new], place[new], [raw[a:b] for a, b in zip(s[fresh].tolist(), e[fresh].tolist())], alone[fresh])
            place = np.searchsorted(self.keys, u)
        counts = self.count[place][back]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.uint32)
        block = 1 << 18
        for i in range(0, len(s), block):
            c = counts[i:i + block]
            lo, hi = int(ends[i] - c[0]), int(ends[min(i + block, len(s)) - 1])
            move = np.repeat(self.first[place[back[i:i + block]]] - (ends[i:i + block] - c), c)
            out[lo:hi] = self.flat[np.arange(lo, hi) + move]
        starts = np.append(0, ends)[np.searchsorted(s, offsets)]
        return out, starts


_tokenizers: dict[str, WordTokenizer] = {}


def window_cuts(cuts: np.ndarray, penalty: np.ndarray, window: int, close: bool) -> list[int]:
    """Cheapest window ends among the ascending positions ``cuts`` of a stream that starts at 0.

    No two neighbouring cuts are more than ``window`` apart.  With ``close`` the last cut must
    end a window; otherwise the cheapest cut of the last window is the last one returned.
    """
    pos = np.concatenate([[0], cuts])
    n = len(pos)
    # pairs of cuts that are a power of two apart, by the later one
    later, earlier = [], []
    t = 1
    while t < window:
        to = pos - t
        at = np.searchsorted(pos, to)
        hit = np.flatnonzero((to >= 0) & (pos[np.minimum(at, n - 1)] == to))
        later.append(hit)
        earlier.append(at[hit])
        t *= 2
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    later, earlier = [*later[order].tolist(), n], earlier[order].tolist()
    where, pen = pos.tolist(), [0, *penalty.tolist()]
    cost, back = [0] * n, [0] * n
    queue = deque([(0, 0)])  # (f(j) + c_j, j), rising
    x, jump = 0, later[0]
    for i in range(1, n):
        c = where[i]
        while where[queue[0][1]] < c - window:
            queue.popleft()
        best, j = queue[0]
        best += window - c
        while jump == i:
            if cost[earlier[x]] + SHORT < best:
                j = earlier[x]
                best = cost[j] + SHORT
            x += 1
            jump = later[x]
        best += pen[i]
        cost[i], back[i] = best, j
        key = best + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    i = n - 1
    if not close:
        i = min((k for k in range(n) if where[k] > where[-1] - window), key=lambda k: (cost[k], -k))
    found = []
    while i:
        found.append(where[i])
        i = back[i]
    return found[::-1]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, window: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and what each costs."""
    n = len(ids)
    price = np.full(n + 1, -1, np.int64)
    if every:
        price[1:] = HARD
    price[np.flatnonzero(closes[ids]) + 1] = SENTENCE
    price[doc_ends] = 0
    price[0] = -1
    at = np.flatnonzero(price >= 0)
    gap = np.diff(at, prepend=0)
    step = min(LONG_SENTENCE, window)
    if (gap > step).any():
        wide = np.flatnonzero(gap > step)
        more = (gap[wide] - 1) // step
        index = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        price[np.repeat(at[wide] - gap[wide], more) + index * step] = HARD
        at = np.flatnonzero(price >= 0)
    return at, price[at]


def _pieces(stream, cuts, first_sequence):
    """Rows of the pieces before the last cut: where document and window ends cut the stream."""
    ids, docs = stream
    stop = cuts[-1]
    ends = np.cumsum([d[3] for d in docs])
    marks = np.unique(np.concatenate([ends[ends <= stop], cuts]))
    begin = np.concatenate([[0], marks[:-1]])
    doc = np.searchsorted(ends, begin, side="right")
    seq = np.searchsorted(cuts, begin, side="right")
    opened = np.concatenate([[0], cuts])[seq]
    doc_begin = np.concatenate([[0], ends])[doc]
    start = np.array([docs[d][2] for d in doc.tolist()], np.int64) + begin - doc_begin
    offsets = pa.array(np.concatenate([[0], marks]) * 4, pa.int64())
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(marks), [None, offsets.buffers()[1],
                                           pa.py_buffer(ids[:stop].astype("<u4").tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([docs[d][0] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(marks - begin),
         pa.array([docs[d][1] for d in doc.tolist()], pa.int64()), pa.array(first_sequence + seq.astype(np.int64)),
         pa.array(begin - opened), raw],
        ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def _rest(stream, stop):
    """The stream after token ``stop``."""
    ids, docs = stream
    left, at = [], 0
    for doc_id, total, start, size in docs:
        skip = min(max(stop - at, 0), size)
        if skip < size:
            left.append((doc_id, total, start + skip, size - skip))
        at += size
    return ids[stop:].copy(), left


def _pack(batches, path: str, window: int, end_id: int):
    # a worker that runs several tasks keeps the pieces it has encoded
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    tokenizer = _tokenizers[path]
    closes = tokenizer.closes.copy()
    if end_id >= len(closes):
        closes = np.append(closes, np.zeros(end_id + 1 - len(closes), bool))
    # a stream is its ids and (doc_id, tokens of the document, first token, tokens here) of each document
    stream = (np.zeros(0, np.uint32), [])
    sequence = TaskContext.get().partitionId() * PARTITION_SEQUENCES

    def emit(stream, close):
        nonlocal sequence
        ids, docs = stream
        ends = np.cumsum([d[3] for d in docs])
        at, price = cut_points(ids, ends, closes, window, close)
        cuts = np.array(window_cuts(at, price, window, close), np.int64)
        if not len(cuts):
            return None, stream
        out = _pieces(stream, cuts, sequence)
        sequence += len(cuts)
        return out, _rest(stream, int(cuts[-1]))

    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        names = batch.column("doc_id").to_pylist()
        for i, j in row_groups(offsets, GROUP_BYTES):
            found, starts = tokenizer.ids(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            sizes = np.diff(starts) + 1
            ends = np.cumsum(sizes)
            ids = np.full(int(ends[-1]), end_id, np.uint32)
            own = np.ones(len(ids), bool)
            own[ends - 1] = False
            ids[own] = found
            docs = stream[1] + [(names[k], size, 0, size) for k, size in zip(range(i, j), sizes.tolist())]
            stream = np.concatenate([stream[0], ids]), docs
            if len(stream[0]) > 2 * window:
                out, stream = emit(stream, False)
                if out is not None:
                    yield out
    if len(stream[0]):
        # what is left is at most two windows and may be cut anywhere
        out, stream = emit(stream, True)
        yield out


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` of every piece of ``docs(doc_id, text)``.

    A document is the ids that the tokenizer file ``path`` gives its whole text (null: empty), without
    special tokens, then ``end_id``; an empty text is that id alone.  Each id lies in exactly one piece.
    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers.  A sequence holds up to
    ``window`` consecutive ids of one partition's documents in their order and is padded to ``window``
    unless its length is a power of two.  Rows with null or repeated doc_id are documents like any
    other; other columns are ignored.  A task that is run again reads the same rows in the same order
    and gives the same sequences.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_pack, path=path, window=window, end_id=end_id),
                           "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
