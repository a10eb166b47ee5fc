import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from buyerlens.llm.packing import HARD, SHORT, WordTokenizer, cut_points, op12_packing, pack, window_cuts
from buyerlens.llm.text import column_bytes

import pyarrow as pa

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_ids_equal_whole_texts(plain):
    texts = ["", " ", "  \n ", "a  b   c \t d\n\n e", "café  été 　x   y z    w", "don't stop 123 4x <|endoftext|> end <|endoftext|>",
             " lead and trail ", "x" * 3000, "\U0001f600 \U0001f600‍\U0001f680 ok", "word " * 500, "\x1c \x1d a \x85 b", "  x   y ﻿ z"]
    rng = np.random.default_rng(1)
    alphabet = list("ab. \n\t'é　 …9") + ["  ", " the", "\r\n"]
    texts += ["".join(rng.choice(alphabet, rng.integers(0, 200))) for _ in range(200)]
    words = WordTokenizer(PATH)
    for _ in range(2):  # the second time every piece is remembered
        data, offsets = column_bytes(pa.array(texts))
        ids, starts = words.ids(data, offsets)
        for k, t in enumerate(texts):
            assert ids[starts[k]:starts[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def waste(size, window):
    return min(window - size, SHORT if size & (size - 1) == 0 else window)


def total(cuts, at, price, window):
    cost, last = 0, 0
    worth = dict(zip(at.tolist(), price.tolist()))
    for c in cuts:
        size = c - last
        assert 0 < size <= window
        cost += worth[c] + waste(size, window)
        last = c
    return cost


@pytest.mark.parametrize("window", [8, 12, 64])
def test_cuts_are_cheapest(window):
    rng = np.random.default_rng(window)
    for _ in range(150):
        n = int(rng.integers(1, 30))
        at = np.cumsum(rng.integers(1, window + 1, n))
        price = rng.choice([0, 1, 16], n)
        where, best = [0, *at.tolist()], [0]
        for i in range(1, n + 1):
            ways = [best[j] + waste(where[i] - where[j], window)
                    for j in range(i) if where[i] - where[j] <= window]
            best.append(min(ways) + price[i - 1])
        cuts = window_cuts(at, price, window, True)
        assert cuts[-1] == at[-1] and total(cuts, at, price, window) == best[-1]
        part = window_cuts(at, price, window, False)
        tail = [b for b, w in zip(best, where) if w > where[-1] - window]
        assert (total(part, at, price, window) if part else 0) == min(tail)


def test_cut_points_leave_no_gap():
    closes = np.zeros(10, bool)
    closes[3] = True
    ids = np.array([0] * 1000 + [3] + [0] * 10 + [1], np.uint32)
    at, price = cut_points(ids, np.array([len(ids)]), closes, 2048, False)
    assert np.diff(at, prepend=0).max() <= 128 and dict(zip(at, price))[1001] == 1 and price[-1] == 0
    assert set(price[:-2]) == {HARD}
    assert len(cut_points(ids, np.array([len(ids)]), closes, 2048, True)[0]) == len(ids)


def check(rows, docs, plain, window=2048):
    """Pieces cover every document once; sequences are gapless; returns padding and tokens."""
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t in docs]
    want = sorted((i if i is not None else -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(docs, ids))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
        by_seq[r["sequence_id"]].append(r)
    known = defaultdict(list)
    for (i, _), x in zip(docs, ids):
        known[(i, len(x))].append(x)
    assert set(known) == set(by_doc)
    for key, parts in by_doc.items():
        if len(known[key]) > 1:
            assert sum(p["length"] for p in parts) == key[1] * len(known[key])
            continue
        x, at = known[key][0], 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0
            crc = p["ids_crc32"] if "ids_crc32" in p else zlib.crc32(p["ids"])
            assert crc == zlib.crc32(np.array(x[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == key[1]
    padding = 0
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sum(p["length"] for p in rows) == sum(w[1] for w in want)
    return padding, sum(w[1] for w in want)


def test_query_packs_every_token(spark, sf001, plain):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    out = op12_packing(spark, sf001)
    assert dict(out.dtypes)["ids_crc32"] == "bigint"
    padding, tokens = check([r.asDict() for r in out.collect()], docs, plain)
    assert padding < 0.01 * tokens


def test_order_is_kept_and_edges(spark, plain):
    long = "Some words go on and on. " * 20_000
    docs = [(1, None), (2, ""), (3, "one"), (None, "no id here."), (None, "no id here."), (5, long), (5, "again"), (6, "no end " * 9000), (7, "")]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, sequence_id int").coalesce(1)
    rows = [r.asDict() for r in pack(df, PATH).collect()]
    padding, tokens = check(rows, docs, plain)
    assert padding < 0.005 * tokens
    rows.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    stream = b"".join(r["ids"] for r in rows)
    assert stream == b"".join(np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for _, t in docs)
    assert [r["doc_id"] for r in rows[:3]] == [1, 2, 3]
    assert pack(df.filter("doc_id = 99"), PATH).count() == 0
    small = [r.asDict() for r in pack(df, PATH, window=64).collect()]
    check(small, docs, plain, 64)
