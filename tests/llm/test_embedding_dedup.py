import numpy as np
import pytest

from buyerlens.llm.embedding_dedup import make_plan, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows
          if i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {}
    root = {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, x, p), (j, y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] = links.get(i, 0) + 1
                links[j] = links.get(j, 0) + 1
                r, s = find(i), find(j)
                root[max(r, s)] = min(r, s)
    return {i: (links.get(i, 0), find(i)) for i in root}


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_links_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        center = rng.standard_normal(16)
        for k in range(20):
            v = center + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35])
            rows.append((len(rows), v.astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(10)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, rows[0][1], None), (n + 3, [float("nan")] * 16, 0),
             (n + 4, [1.0, None] + [0.0] * 14, 0), (n + 5, [float("inf")] + [0.0] * 15, 0), (n + 6, [1.0, 2.0], 1),
             (n + 7, [2.0, 4.0], 1), (n + 8, [], 1)]
    out = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), block_rows=block_rows).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == brute(rows, 0.93)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_null_ids_and_empty_table(spark):
    rows = [(None, [1.0, 0.0], 0, ""), (3, [1.0, 0.0], 0, ""), (3, [1.0, 0.0], 0, "")]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["kept"]) for r in out) == [(-1, 0, True), (3, 1, True), (3, 1, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_follows_the_number_of_vectors():
    assert make_plan(50_000).bits > make_plan(1000).bits
    for n in (2, 1000, 10 ** 9):
        p = make_plan(n)
        meet = (1 - np.arccos(0.93) / np.pi) ** p.bits
        assert (1 - meet) ** p.tables <= 1e-6
