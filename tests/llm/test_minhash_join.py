import random
import re
from itertools import combinations

from buyerlens.llm.minhash_join import near_duplicates


def sets_of(text, k):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) >= k:
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets))


def check(spark, rows, k=5, percent=80):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id int")
    out = near_duplicates(df, shingle=k, percent=percent).collect()
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)
    assert have == brute(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)


def test_groups_match_brute_force(spark):
    rng = random.Random(1)
    vocab = ["w%d" % i for i in range(300)]
    rows = [(None, "a b c d e f"), (900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One  TWO"),
            (905, "a b c d e f"), (906, "A b c d e f")]
    n = 0
    common = " ".join(rng.choice(vocab) for _ in range(30))
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, " ".join(w) + (" " + common if g % 3 == 0 else "")))
            n += 1
    check(spark, rows)
    check(spark, rows, k=4, percent=60)


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "e%d" % rng.randrange(10_000)
        rows.append((i, " ".join(w)))
    check(spark, rows, k=4)


def test_empty_table_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (6, "a b c d e f g"), (7, "q r s t u v")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(5, 5), (5, 5), (6, 5), (7, 7)]
