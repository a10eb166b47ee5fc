import random

import numpy as np
import pyarrow as pa

from buyerlens.llm import text as tx
from buyerlens.llm.graph import components


def test_words_match_a_plain_split():
    rows = ["", None, " a  bb\tC\x0b", "ünï x", "a b c", "w" * 700_000 + " z", "z"]
    data, offsets = tx.column_bytes(pa.array(rows))
    h, s, e, at = tx.words(data, offsets, fold=True)
    got = [[bytes(data[a:b]) for a, b in zip(s[at[i]:at[i + 1]], e[at[i]:at[i + 1]])] for i in range(len(rows))]
    import re
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (r or "").encode()) for r in rows]
    by = {}
    for word, code in zip((w.lower() if w.isascii() else w for r in got for w in r), h.tolist()):
        assert by.setdefault(word, code) == code
    assert len(set(by.values())) == len(by)


def test_sliced_columns_and_row_groups():
    col = pa.array(["ab", None, "cde", "f"]).slice(1, 3)
    data, offsets = tx.column_bytes(col)
    assert bytes(data) == b"cdef" and offsets.tolist() == [0, 0, 3, 4]
    assert list(tx.row_groups(np.array([0, 10, 12, 13, 40]), 5)) == [(0, 1), (1, 3), (3, 4)]


def test_window_minima():
    rng = np.random.default_rng(1)
    for n, w in ((10, 3), (7, 7), (5, 9), (100, 1), (101, 10)):
        x = rng.integers(0, 50, n).astype(np.uint64)
        assert tx.segments_min(x, w).tolist() == [min(x[i:i + w]) for i in range(max(n - w + 1, 0))]


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    edges += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: find(x) for x in list(root)}
    assert len(got) == len({r["id"] for r in got})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
