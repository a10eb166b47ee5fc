import numpy as np

from buyerlens.llm import mixing
from buyerlens.llm.mixing import OTHER, TOPIC_WORD, TOPICS, Targets, mixed, rake, sampled

SCHEMA = "doc_id long, text string, source string, lang string, weight string"


def rows(n=600):
    rng = np.random.default_rng(0)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 10))) for _ in range(rng.integers(5, 40))]
        out.append((i, " ".join(words), "big" if i % 3 else f"s{i % 9}", "en" if i % 4 else "de", ""))
    return out


def test_rake_meets_margins():
    rng = np.random.default_rng(1)
    own = rng.random(24) + 0.1
    a, b = np.arange(24) % 4, np.arange(24) // 8
    w, sweeps = rake(own, [(a, np.array([.1, .2, .3, .4])), (b, np.array([.5, .25, .25]))])
    assert np.allclose(np.bincount(a, weights=w), [.1, .2, .3, .4]) and np.allclose(np.bincount(b, weights=w), [.5, .25, .25])
    # raking keeps the interaction: odds ratios of the own totals
    own, w = own.reshape(6, 4), w.reshape(6, 4)
    assert np.allclose(w[0, 0] * w[1, 1] / w[0, 1] / w[1, 0], own[0, 0] * own[1, 1] / own[0, 1] / own[1, 0])


def test_expected_tokens_meet_targets(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    targets = Targets(source={"big": 0.4}, lang={"de": 0.5, "en": 0.5}, topic=1.0)
    out = {r["doc_id"]: r for r in sampled(df, targets).collect()}
    assert len(out) == len(data)
    assert all(out[i]["n_tokens"] == len(t.split()) for i, t, *_ in data)
    expect = {i: r["probability"] * r["n_tokens"] for i, r in out.items()}
    total = sum(expect.values())
    assert abs(sum(v for i, v in expect.items() if data[i][2] == "big") / total - 0.4) < 1e-6
    assert abs(sum(v for i, v in expect.items() if data[i][3] == "de") / total - 0.5) < 1e-6
    assert max(r["probability"] for r in out.values()) == 1.0
    kept = {i for i, r in out.items() if r["kept"]}
    assert abs(sum(out[i]["n_tokens"] for i in kept) / total - 1) < 0.15
    same = mixed(df, targets)
    assert same.columns == df.columns and {r["doc_id"] for r in same.collect()} == kept
    half = sampled(df, targets, keep_share=0.3).collect()
    assert abs(sum(r["probability"] * r["n_tokens"] for r in half) / sum(r["n_tokens"] for r in half) - 0.3) < 1e-6


def test_topics_are_majority_votes(spark):
    out = sampled(spark.createDataFrame(rows(40), SCHEMA)).collect()
    texts = {r[0]: r[1] for r in rows(40)}
    single = {}
    for r in out:
        long = [w for w in texts[r["doc_id"]].split() if len(w) >= TOPIC_WORD]
        assert r["topic"] in ({str(t) for t in range(TOPICS)} if long else {"-1"})
        if len(set(long)) == 1:
            assert single.setdefault(long[0], r["topic"]) == r["topic"]


def test_edges(spark):
    data = [(1, None, None, None, ""), (2, "", "a", "en", ""), (None, "w w w", "a", "en", ""), (3, "x y", "b", "en", ""),
            (3, "x y", "b", "en", ""), (4, "word " * 50_000, "a", "de", "")]
    df = spark.createDataFrame(data, SCHEMA)
    out = sampled(df).collect()
    assert len(out) == 6 and len({(r["doc_id"], r["kept"]) for r in out if r["doc_id"] == 3}) == 1
    assert all(r["kept"] for r in out if r["n_tokens"] == 0 and r["probability"] == 1)
    assert mixed(df).columns == df.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert sampled(empty).count() == 0 and mixed(empty).count() == 0
    assert OTHER == "other"


def many_sources():
    return [(i, "w " * 30, "hot" if i % 3 == 0 else f"s{i % 300}", "en" if i % 5 else "de", "") for i in range(900)]


def test_small_sources_are_raked_to_their_own_targets(spark):
    out = sampled(spark.createDataFrame(many_sources(), SCHEMA), Targets(source=0.5, lang=1.0, topic=1.0)).collect()
    own, expect = {}, {}
    for r in out:
        own[r["source"]] = own.get(r["source"], 0) + r["n_tokens"] ** 1.0
        expect[r["source"]] = expect.get(r["source"], 0) + r["n_tokens"] * r["probability"]
    goal = {k: v ** 0.5 for k, v in own.items()}
    assert len(own) == 201
    for k, v in goal.items():
        assert abs(expect[k] / sum(expect.values()) - v / sum(goal.values())) < 1e-6


def test_cells_on_executors_give_the_same_mix(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data + [(10_000, "", "new", "en", ""), (10_001, None, None, None, "")], SCHEMA)
    for targets, share in ((Targets(), None), (Targets(source={"big": 0.4}, lang={"de": 0.5, "en": 0.5}, topic=0.5), 0.3)):
        monkeypatch.setattr(mixing, "LOCAL_CELLS", 50_000)
        near = {r["doc_id"]: r for r in sampled(df, targets, share).collect()}
        monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
        far = {r["doc_id"]: r for r in sampled(df, targets, share).collect()}
        assert near.keys() == far.keys()
        assert all(abs(far[i]["probability"] - r["probability"]) < 1e-6 and abs(far[i]["weight"] - r["weight"]) < 1e-6 for i, r in near.items())
        same = mixed(df, targets, share)
        assert same.columns == df.columns and {r["doc_id"] for r in same.collect()} == {i for i, r in far.items() if r["kept"]}
