import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from buyerlens.llm.divergence import OP13_SQL, Transducer, audit, op13_divergence, recount, vocabulary

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spans(terms):
    ends = np.cumsum([len(t) for t in terms])
    return np.frombuffer(b"".join(terms), np.uint8), ends - np.array([len(t) for t in terms]), ends


def test_transducer_gives_every_place_and_is_minimal():
    rng = random.Random(4)
    for size in (1, 2, 50, 3000):
        terms = sorted({bytes(rng.choices(b"abc\xc3\xff", k=rng.randint(1, 9))) for _ in range(size)})
        machine = Transducer.from_bytes(Transducer.build(terms).to_bytes())
        assert machine.ordinals(*spans(terms)).tolist() == list(range(len(terms)))
        others = [t for t in {bytes(rng.choices(b"abcd", k=rng.randint(1, 10))) for _ in range(2000)} if t not in set(terms)]
        assert (machine.ordinals(*spans(others)) == -1).all()
        # right languages of the states are the sets of endings of all prefixes
        ends = defaultdict(set)
        for t in terms:
            for k in range(len(t) + 1):
                ends[t[:k]].add(t[k:])
        assert len(machine.final) == len({frozenset(x) for x in ends.values()})


def expected(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(FOLD))) for text, lang, source in rows]
    held = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(set)
    for (lang, t), n in held.items():
        if n >= min_docs:
            kept[lang].add(t)
    groups = defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang, source].update(t for t in terms if t in kept[lang])
    out = set()
    for (lang, source), own in groups.items():
        words, all_ = kept[lang], Counter()
        for (other, _), c in groups.items():
            if other == lang:
                all_ += c

        def p(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(words))

        found = sorted((-sum(abs(p(own, t) - p(c, t)) for t in words), s.encode()) for (l, s), c in groups.items() if l == lang and s != source)
        out |= {(lang, source, "pair", s.decode(), -v, k) for k, (v, s) in enumerate(found, 1)}
        found = sorted((p(all_, t) - p(own, t), t.encode()) for t in words if own[t] and p(own, t) > p(all_, t))
        out |= {(lang, source, "term", t.decode(), -v, k) for k, (v, t) in enumerate(found[:top], 1)}
    return out


SCHEMA = "text string, lang string, source string, term string, ord int"


def noisy(n, seed=9):
    rng = random.Random(seed)
    vocab = ["a", "B", "ab", "Abc", "é", "É", "ßa", "z" * 40, "日本", "b-c", "x_y", "tie1", "tie2"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "42 !!"]) if rng.random() < 0.05 else " ".join(rng.choices(vocab, k=rng.randint(1, 30)))
        rows.append((text, rng.choice(["en", "en", "en", None, "", "q"]), rng.choice(["s1", "s1", "s1", "s2", None, "é", "Z"])))
    rows += [("only here", "lone", "s1"), (None, "none", "s1"), ("zz", "none", "s2"), rows[0], rows[0]]
    rows.append(("alpha " * 300_000 + "omega", "en", "s2"))
    return rows


def test_audit_equals_brute_force(spark):
    rows = noisy(400)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    want = expected(rows, 5, 7)
    got = audit(df, min_docs=5, top_terms=7)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[2] for r in got} == {"pair", "term"} and any(r[4] == 0 for r in got if r[0] == "none")


def test_many_ranges_and_passes_give_the_same(spark):
    rows = noisy(200)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in audit(df, min_docs=5, top_terms=50, range_terms=3, pass_bytes=700).collect()]
    assert set(got) == expected(rows, 5, 50) and len(got) == len(set(got))
    terms, ranges = vocabulary(df.fillna("").select("text", "lang", "source"), 5, 3)
    assert ranges.count() > 10 and ranges.agg({"n": "max"}).first()[0] == 3
    places = defaultdict(list)
    for r in terms.collect():
        places[r["lang"]].append((r["ord"], r["term"].encode()))
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == list(range(len(found))) and [t for _, t in found] == sorted(t for _, t in found)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert audit(df).count() == 0
    assert audit(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).count() == 0
    assert sorted(tuple(r) for r in audit(spark.createDataFrame([("a", "l", "s", "", 1), ("b", "l", "t", "", 1)], SCHEMA)).collect()) == [
        ("l", "s", "pair", "t", 0, 1), ("l", "t", "pair", "s", 0, 1)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({OP13_SQL})").fetchall()
    got = [tuple(r) for r in op13_divergence(spark, path).collect()]
    assert len(got) == len(want) and set(got) == set(want)
    assert sum(r[2] == "term" for r in got) > 100
