import hashlib
import random

import numpy as np
import pytest

from buyerlens.llm.suffix_dedup import _blind_trie, common_prefix, deep_shallow_sort, op1_suffix_dedup, remove_repeats


def brute(texts, width):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for r in raw:
        for i in range(len(r) - width + 1):
            w = r[i:i + width]
            count[w] = count.get(w, 0) + 1
    out = []
    for r in raw:
        hit = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if count[r[i:i + width]] > 1:
                hit[i:i + width] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[:-1].astype(int), [0]])) == 1)
        kept = bytes(b for b, h in zip(r, hit) if not h)
        out.append((len(r), int(hit.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r for r in remove_repeats(df, **kw).collect()}
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for _, r in sorted(rows.items())]


def words(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.mark.parametrize("seed,group", [(0, 256), (1, 3), (2, 5), (3, 256)])
def test_matches_brute_force(spark, seed, group):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    passages = [words(rng, 12, vocab) for _ in range(3)]
    texts = [None, "", "short", "ab " * 60, "ab " * 45 + "x" + "ab " * 30, "z" * 200, "z" * 150]
    base = words(rng, 60, vocab)
    for i in range(40):
        kind = i % 5
        if kind == 0:
            t = words(rng, 30, vocab) + " " + rng.choice(passages) + " " + words(rng, 20, vocab)
        elif kind == 1:
            w = base.split()
            w[rng.randrange(len(w))] = "EDIT%d" % i
            t = " ".join(w)
        elif kind == 2:
            t = rng.choice(passages)[rng.randint(0, 20):] + words(rng, 3, vocab)
        elif kind == 3:
            t = words(rng, 5, vocab) + "\n" + (passages[0] + "\n") * rng.randint(1, 3)
        else:
            t = base if i % 2 else words(rng, 50, vocab)
        texts.append(t)
    assert got(spark, texts, width=40, gram=12, group=group) == brute(texts, 40)


def test_row_longer_than_a_block(spark):
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(97, 123, 1_300_000, dtype=np.uint8)).decode()
    texts = [long + long[700_000:700_600], "q" + long[524_000:525_000], long[:399]]
    rows = got(spark, texts, width=400, gram=128)
    assert [r[1] for r in rows] == [600 + 600 + 1000, 1000, 0]
    assert [r[2] for r in rows] == [3, 1, 0]


def test_empty_table_and_repeated_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0
    text = "abcdefgh" * 10
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "q" * 50 + text[:44])], "doc_id long, text string")
    rows = remove_repeats(df, width=40, gram=12).collect()
    assert sorted(r["n_removed"] for r in rows) == sorted(b[1] for b in brute([text, text, text, "q" * 50 + text[:44]], 40))


def test_deep_shallow_sort_orders_and_measures():
    rng = random.Random(3)
    for _ in range(200):
        pool = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 30))]
        pool += [p + b"xyz" for p in pool[:5]] + pool[:3]
        strings = [np.frombuffer(p, np.uint8) for p in pool]
        order, lcp = deep_shallow_sort(strings, shallow=rng.choice([0, 2, 8, 100]))
        assert [pool[k] for k in order] == sorted(pool)
        assert all(lcp[i] == common_prefix(strings[order[i - 1]], strings[order[i]]) for i in range(1, len(order)))


def test_blind_trie_keeps_equal_strings_together():
    strings = [np.frombuffer(s, np.uint8) for s in (b"aab", b"aa", b"aab", b"aac")]
    assert [k for k, _ in _blind_trie([0, 1, 2, 3], strings, 1)] == [1, 0, 2, 3]


def test_kept_text_is_what_the_digest_is_of(spark, sf001):
    rows = remove_repeats(spark.read.parquet(f"{sf001}/documents.parquet"))
    for r in rows.collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    out = op1_suffix_dedup(spark, sf001)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in out.collect() if not r["n_removed"])
