import random

import numpy as np

from buyerlens.llm.decontaminate import contaminated, decontaminate, tile

DOC, ITEM = "doc_id long, text string, coverage string", "item_id long, text string"


def plain_tiling(a, b, least):
    """Textbook greedy string tiling: longest free common run first; ties by position."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        for k in range(n):
            fa[i + k] = fb[j + k] = False


def test_tiling_matches_the_plain_algorithm():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 18))] for _ in range(2))
        got = tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        want = plain_tiling(a, b, 3)
        assert all(a[i:i + n] == b[j:j + n] and n >= 3 for i, j, n in got)
        for side in (0, 1):
            used = [x for t in got for x in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))
        assert sorted((t[2] for t in got), reverse=True)[:1] == sorted((t[2] for t in want), reverse=True)[:1]
        assert abs(sum(t[2] for t in got) - sum(t[2] for t in want)) <= 3


def test_reports_verbatim_and_reordered_items(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    fresh = lambda n: [word() for _ in range(n)]
    items = [fresh(30), fresh(24), ["only", "three", "words"], fresh(40)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, ""), (3, " ".join(items[3]))]
    mixed = items[1][16:] + fresh(5) + items[1][8:16] + fresh(3) + items[1][:8]
    docs = [(0, " ".join(fresh(50) + items[0] + fresh(20)), ""), (1, " ".join(mixed).upper().replace(" ", ", "), ""),
            (2, " ".join(fresh(80)), ""), (3, "x Only three, words!", ""), (4, None, ""), (5, "", ""),
            (6, " ".join(items[3][:16]), ""), (None, " ".join(items[0]), ""), (7, "three words only", ""),
            (8, " ".join(fresh(60_000) + items[0]), ""), (0, " ".join(fresh(50) + items[0]), "")]
    df, bf = spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, ITEM)
    for block in (2_000_000, 25):
        out = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"], r["n_covered"])
                     for r in contaminated(df, bf, block_words=block).collect())
        assert out == [(-1, 0, 30), (0, 0, 30), (0, 0, 30), (1, 1, 24), (3, 2, 3), (8, 0, 30)]
        left = decontaminate(df, bf, block_words=block)
        assert left.columns == df.columns
        assert sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6, 7]
    partial = contaminated(df, bf, coverage=0.4).filter("doc_id = 6").collect()
    assert [(r["item_id"], r["n_covered"], r["n_words"]) for r in partial] == [(3, 16, 40)] * 2


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(1, "a b c d e", "")], DOC)
    assert contaminated(docs, bench).count() == 0 and contaminated(some, bench).count() == 0
    assert decontaminate(some, bench).count() == 1 and decontaminate(docs, bench).count() == 0
