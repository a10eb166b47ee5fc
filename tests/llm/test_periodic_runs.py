import hashlib
import re
import zlib

import numpy as np
import pytest

from buyerlens.llm.periodic_runs import find_runs, looped_text, op11_periodic_runs, periodic_runs
from buyerlens.llm.text import U64, mix

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(seq, least=0):
    """Every maximal repetition of two periods or more, smallest period of each stretch."""
    found = {}
    for q in range(1, len(seq) // 2 + 1):
        i = 0
        while i + q < len(seq):
            j = i
            while j + q < len(seq) and seq[j] == seq[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, 2 * q))


def caught(texts):
    ids = [np.array(t, np.uint64) for t in texts]
    bounds = np.cumsum([0, *[len(t) + 1 for t in ids]])
    w = np.concatenate([np.append(mix(t + U64(7)), mix(np.array([i + (1 << 40)], np.uint64))) for i, t in enumerate(ids)])
    runs = find_runs(w, bounds)
    out = [[] for _ in texts]
    for s, e, q in runs.tolist():
        t = int(np.searchsorted(bounds, s, side="right")) - 1
        out[t].append((s - int(bounds[t]), e - s, q))
    return [sorted(r) for r in out]


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_equal_all_repetitions():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, k, n).tolist() for k in (1, 2, 3, 8) for n in (0, 1, 2, 3, 7, 31, 64, 200)]
    for _ in range(60):  # repeated pieces in and around noise
        t = []
        for _ in range(rng.integers(1, 5)):
            root = rng.integers(0, 4, rng.integers(1, 60)).tolist()
            t += rng.integers(0, 50, rng.integers(0, 9)).tolist() + root * rng.integers(1, 5) + root[:rng.integers(0, len(root))]
        texts.append(t)
    texts += [thue_morse(1024), fibonacci(800), [0] * 700, [0] * 300 + [1] + [0] * 300, ([0] * 40 + [1]) * 12,
              ([0] * 30 + [1] + [0] * 31 + [1]) * 5, [0, 1] * 150 + [1] + [0, 1] * 150]
    got = caught(texts)
    for t, g in zip(texts, got):
        assert g == [(s, n, q) for s, n, q in brute(t)], t[:50]


def test_one_word_a_million_times():
    runs = find_runs(np.append(np.full(1_000_000, 5, np.uint64), U64(9)), np.array([0, 1_000_001]))
    assert runs.tolist() == [[0, 1_000_000, 1]]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall((text or "").encode()))
    runs = brute(words, 12)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, sf001):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    out = op11_periodic_runs(spark, sf001)
    assert dict(out.dtypes)["exponent_milli"] == "bigint" and dict(out.dtypes)["n_runs"] == "bigint"
    got = {r["doc_id"]: tuple(r)[:8] for r in out.collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 10
    short = [i for i, t in docs.items() if len((t or "").split()) < 1500]
    assert len(short) > 100
    for i in short:
        assert got[i] == expected(i, docs[i])


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40_000)) + " again and" * 9
    data = [(1, None, "x"), (1, "", "x"), (None, "a b " * 8, "x"), (None, "a b " * 8, "x"), (3, long, "x"),
            (4, "é é\x0b" * 14, "x"), (5, " \t\n", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, runs string")
    rows = periodic_runs(docs).collect()
    assert len(rows) == len(data)
    by = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"][-40:]) for r in rows))
    assert [r[2] for r in by if r[0] == 0] == [[(0, 16, 2)]] * 2 and by[0][3] == "a b"
    assert [r[1:] for r in by if r[0] == 1] == [(0, [], "")] * 2 and [r[1:] for r in by if r[0] == 5] == [(0, [], "")]
    assert [r[1:3] for r in by if r[0] == 3] == [(40_018, [(40_000, 18, 2)])]
    assert [r[1:] for r in by if r[0] == 4] == [(14, [(0, 14, 1)], "é é")]
    assert periodic_runs(docs.filter("doc_id = 99")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 30])
def test_looped_words(spark, n):
    words = [f"v{i}" for i in range(n)]
    ids = list(range(200))
    df = spark.createDataFrame([(i, " ".join(words)) for i in ids] + [(None, "a  b")], "doc_id long, text string")
    from pyspark.sql import functions as F
    got = {r[0]: r[1] for r in df.select("doc_id", looped_text(F.col("doc_id"), F.col("text"))).collect()}
    assert got.pop(None) == "a  b"
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids)
    assert all(got[i].split() == planted(i, words) for i in ids)
