import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buyerlens.llm import quality_crf as q
from buyerlens.llm import toxicity as t
from buyerlens.llm.queries import QUERIES


@pytest.mark.parametrize("name,label,limit", [("op8_toxicity", "toxic", 0.94), ("op10_quality", "quality", 0.96)])
def test_held_out_accuracy(spark, sf01, name, label, limit):
    out = QUERIES[name][0](spark, sf01)
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    labels = spark.read.parquet(f"{sf01}/labels.parquet").collect()
    held = [r for r in labels if rows[r["doc_id"]]["held_out"]]
    right = sum(rows[r["doc_id"]]["predicted"] == r[label] for r in held)
    assert right / len(held) >= limit


def plain_features(text):
    s = " " + text.lower() + " "
    return {(n, s[i:i + n]) for n in t.SIZES for i in range(len(s) - n + 1)}


def test_ngram_features_are_sets_of_whole_texts():
    texts = ["Abc abc", "", None, "ABC  ABC", "é" * 3, "x" * 2_000_000 + "needle", "abc abc"]
    got = list(t.text_features(texts))
    assert len(got[1]) == len(got[2]) == 0
    assert got[0].tolist() == got[6].tolist() and got[0].tolist() != got[3].tolist()
    assert len(got[0]) == len(plain_features("abc abc"))
    alone = next(iter(t.text_features(["needle"])))
    assert len(set(alone) & set(got[5])) >= len(plain_features("needle")) - 3


def test_ratio_weights_separate_classes():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([rng.integers(100, 400, 20), [7 if k % 4 == 0 else 8]])) for k in range(400)]
    y = (np.arange(400) % 4 == 0).astype(float)
    m = t.fit_logistic(rows, y)
    z = np.array([m.weights[r].sum() for r in rows]) + m.bias
    assert ((z > 0) == (y == 1)).all() and m.weights[7] > 0 > m.weights[8]


def chain(score, move):
    """All label sequences of one chain with their weights."""
    out = {}
    for s in itertools.product((0, 1), repeat=len(score)):
        out[s] = np.exp(sum(score[i] * v for i, v in enumerate(s)) + sum(move[a, b] for a, b in zip(s, s[1:])))
    return out


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    sizes = [1, 5, 3, 1, 4]
    rows = np.concatenate([[0], np.cumsum(sizes)])
    score, move = rng.standard_normal(rows[-1]) * 2, rng.standard_normal((2, 2))
    p, pairs, logz = q.marginals(score, rows, move)
    want_pairs, want_z = np.zeros((2, 2)), 0.0
    for a, b in zip(rows[:-1], rows[1:]):
        every = chain(score[a:b], move)
        z = sum(every.values())
        want_z += np.log(z)
        for i in range(b - a):
            assert np.isclose(p[a + i], sum(w for s, w in every.items() if s[i]) / z)
        for s, w in every.items():
            for x, y in zip(s, s[1:]):
                want_pairs[x, y] += w / z
    assert np.allclose(pairs, want_pairs) and np.isclose(logz, want_z)


def test_line_features_of_blocks_equal_those_of_single_texts():
    texts = ["One line.", "", None, "a a a a\n\nB B\na a a a\n", "\n", "x | y | z\n99 !!", "é" * 10]
    data, offsets = q.column_bytes(pa.array(texts))
    f, length, rows = q.line_features(data, offsets)
    for k, text in enumerate(texts):
        lines = (text or "").split("\n")
        assert rows[k + 1] - rows[k] == len(lines)
        assert length[rows[k]:rows[k + 1]].tolist() == [len(x.encode()) for x in lines]
        d, o = q.column_bytes(pa.array([text], pa.string()))
        assert np.allclose(q.line_features(d, o)[0], f[rows[k]:rows[k + 1]])
    a = rows[3]
    assert f[a:rows[4], 12].tolist() == [0, 0, 0, 1, 0] and f[a, 7] == 1


def test_edges_of_both_scores(spark):
    docs = spark.createDataFrame([(1, "good text here", "x"), (2, None, "x"), (3, "", "x"), (None, "bad bad", "x"), (1, "good text here", "x")],
                                 "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, toxic int, quality int")
    empty = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for labels in (none, empty):
        assert {r["score"] for r in t.score(docs, t.fit(docs, labels)).collect()} == {0.25}
        assert {r["score"] for r in q.score(docs, q.fit(docs, labels)).collect()} == {0.25}
    model = t.fit(docs, empty)
    assert t.keep_clean(docs, model).count() == 5 and t.keep_clean(docs, model).columns == docs.columns
    nothing = docs.filter(F.lit(False))
    assert t.score(nothing, model).count() == 0 and q.score(nothing, q.fit(docs, empty)).count() == 0


def test_sample_skips_what_does_not_fit_and_collects_the_rest_only(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from buyerlens.llm.labelled import collect_bounded

    ids = [r["i"] for r in spark.range(20).select(F.col("id").alias("i")).orderBy(F.xxhash64("id")).collect()]
    sizes = {i: 1000 if n in (0, 7) else 10 for n, i in enumerate(ids)}
    texts = spark.createDataFrame([(i, i % 2, "x" * sizes[i]) for i in ids], "ord long, y int, text string")
    kind, got = type(texts), []
    monkeypatch.setattr(kind, "toArrow", lambda self, f=kind.toArrow: got.append(f(self)) or got[-1])
    rows, y = collect_bounded(texts, lambda col: [[1] * len(t) for t in col.to_pylist()], "int", 100)
    want = sorted([i for i in ids if sizes[i] == 10][:10])
    assert [len(r) for r in rows] == [10] * 10 and y.tolist() == [i % 2 for i in want]
    assert [sum(len(v) for v in t.column("features").to_pylist()) for t in got] == [100]
    assert pa.types.is_list(got[0].column("features").type)
