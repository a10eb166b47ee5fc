"""Trees and forests whose subtrees never leave the executors (M3, M4).

A leaderboard needs a forest's predictions of the left-out fold, not the forest, so no tree is
collected.  A table of up to ``boosting.TASK_ROWS`` rows is broadcast as bins and a task grows whole trees.  In a
larger one, nodes of more than ``LOCAL_ROWS`` rows are split level by level in shared passes like those of
``operators.boosting`` (the driver gets one split per such node).  The rows of a smaller node, in its bag or
left out, then meet in one task, which grows the subtree and predicts the left-out rows with it.

Splits are those of Spark ML: ``MAX_BINS`` bins with cuts half-way between values, weights of a bag drawn
from Poisson(1) by a hash of key and tree, a feature subset for each node, largest gain of the variance
(of a 0/1 label it is half the Gini impurity), no smallest gain or leaf.  A class is predicted by the mean
of its share in the leaves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from buyerlens import params
from buyerlens.operators import boosting as bo
from buyerlens.session import ship_package, write_shared

#: Bins of a feature, quantiles they are chosen from, and rows of a node that one task finishes.
MAX_BINS, GRID, LOCAL_ROWS = 32, 1024, 1 << 16
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_SQUARED = bo.BoostSpec("squared")


@dataclass(frozen=True)
class ForestSpec:
    """Trees, their depth, the features a node may use (``all``, ``sqrt`` or ``third``), and whether bags are drawn."""
    trees: int = 100
    depth: int = 20
    features: str = "all"
    bags: bool = True
    classify: bool = False
    seed: int = params.SEED

    def subset(self, n: int) -> int:
        return {"all": n, "sqrt": math.ceil(math.sqrt(n)), "third": math.ceil(n / 3)}[self.features]


def bag(keys: np.ndarray, tree: int, spec: ForestSpec) -> np.ndarray:
    """How often each row is in the bag of a tree."""
    if not spec.bags:
        return np.ones(len(keys))
    x = keys.astype(np.uint64) ^ np.uint64((spec.seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD6E8FEB86659FD93) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0 ** 53, side="right").astype(float)


def split_points(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Cuts of each feature: half-way between its values if they are few, else between quantiles."""
    at = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, F.lit(10_000)).alias(f"q{i}") for i, f in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        q = np.array(row[i] if row[i] is not None else [], float)
        values = np.unique(q)
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) >= MAX_BINS:
            at_values = q[(np.arange(1, MAX_BINS) * GRID) // MAX_BINS]
            middle = middle[np.unique(np.minimum(np.searchsorted(values, at_values), len(middle) - 1))]
        out.append(middle)
    return out


# ------------------------------------------------------------------ in one task
def grow_and_predict(bins, y, w, held, spec: ForestSpec, depth: int, n_bins: int, rng) -> np.ndarray:
    """Grow the subtree of these rows level by level, ``depth`` levels at most; the means of the leaves that the
    ``held`` rows end in.  Nodes that no held row comes to are not grown."""
    middle = float((w * y).sum() / w.sum())
    y = y - middle
    out = np.zeros(len(held))
    rows, at = np.arange(len(y)), np.zeros(len(y), np.int64)
    left_out, held_at = np.arange(len(held)), np.zeros(len(held), np.int64)
    n, features, flat = 1, bins.shape[1], np.ascontiguousarray(bins).reshape(-1)
    for level in range(depth + 1):
        weight, wy = w[rows], w[rows] * y[rows]
        total, sums = np.bincount(at, weight, n), np.bincount(at, wy, n)
        out[left_out] = (sums / total)[held_at]
        if level == depth:
            break
        chosen = np.sort(np.argsort(rng.random((n, features)), axis=1)[:, :spec.subset(features)], axis=1)
        gain, feature, cut = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for candidate in chosen.T:
            index = at * n_bins + flat.take(rows * features + candidate.take(at))
            lw = np.bincount(index, weight, n * n_bins).reshape(n, n_bins).cumsum(axis=1)
            ls = np.bincount(index, wy, n * n_bins).reshape(n, n_bins).cumsum(axis=1)
            rw, rs = total[:, None] - lw, sums[:, None] - ls
            score = np.where((lw > 0) & (rw > 0), ls * ls / np.maximum(lw, 1) + rs * rs / np.maximum(rw, 1), -np.inf)
            best = score.argmax(axis=1)
            found = score[np.arange(n), best] - sums * sums / total
            better = found > gain
            gain[better], feature[better], cut[better] = found[better], candidate[better], best[better]
        noise = 1e-12 * np.bincount(at, wy * y[rows], n)
        splits = (gain > noise) & (np.bincount(held_at, minlength=n) > 0)
        rank = np.cumsum(splits) - 1
        rows, at, left_out, held_at = (*_descend(bins, rows, at, splits, rank, feature, cut), *_descend(held, left_out, held_at, splits, rank, feature, cut))
        n = 2 * int(splits.sum())
        if not n:
            break
    return out + middle


def _descend(bins, rows, at, splits, rank, feature, cut):
    go = splits[at]
    rows, at = rows[go], at[go]
    return rows, 2 * rank.take(at) + (bins.reshape(-1).take(rows * bins.shape[1] + feature.take(at)) > cut.take(at))


# ------------------------------------------------------------------ the table
_TABLE = "h long, y double, fold int, bins binary"


def _bin(batches, features, cuts):
    for batch in batches:
        bins = bo.bin_rows([batch.column(f) for f in features], cuts)
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bins.shape[1]), batch.num_rows, [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("__h"), batch.column("__y"), batch.column("__fold"), raw], ["h", "y", "fold", "bins"])


@dataclass
class BinnedTable:
    """Key hash, label, fold and bins of all rows, dealt over all cores; ``sent`` are the same in memory, if they are few."""
    rows: DataFrame
    n_features: int
    n_bins: int
    sent: object = None

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], label: str, key: str, fold_col: str) -> "BinnedTable":
        spark = df.sparkSession
        ship_package(spark)
        rows = df.select(*features, F.xxhash64(key).alias("__h"), F.col(label).cast("double").alias("__y"), F.col(fold_col).cast("int").alias("__fold"))
        cuts = split_points(rows.where("__y is not null"), features)
        stored = write_shared(rows.mapInArrow(partial(_bin, features=list(features), cuts=cuts), _TABLE))
        n = max(spark.sparkContext.defaultParallelism, stored.rdd.getNumPartitions())
        sent = None
        if LOCAL_ROWS < stored.count() <= bo.TASK_ROWS:
            keys, y, fold, bins = _columns(stored.toArrow(), len(features))
            order = np.lexsort((y, keys))  # sums do not depend on the order of arrival
            sent = spark.sparkContext.broadcast(tuple(c[order] for c in (keys, y, fold, bins)))
        return cls(stored.repartition(n, "h"), len(features), max([len(c) for c in cuts], default=0) + 1, sent)


def _columns(batch, n_features):
    keys, fold = (np.asarray(batch.column(c)) for c in ("h", "fold"))
    bins = batch.column("bins")
    if isinstance(bins, pa.ChunkedArray):
        bins = np.concatenate([bo._matrix(c, np.uint8, n_features) for c in bins.chunks])
    else:
        bins = bo._matrix(bins, np.uint8, n_features)
    return keys, np.asarray(batch.column("y").fill_null(np.nan)), fold, bins


# ------------------------------------------------------------------ whole trees
def _whole_trees(batches, sent, spec, fold, n_bins, tasks):
    """Sum and number of the predictions that the trees of a task make for each left-out row."""
    keys, y, folds, bins = sent.value
    seen, own = (folds != fold) & ~np.isnan(y), folds == fold
    held_keys, held = keys[own], bins[own]
    for batch in batches:
        for task in batch.column("id").to_pylist():
            total, trees = np.zeros(len(held)), range(task, spec.trees, tasks)
            for tree in trees if len(held) and seen.any() else ():
                w = bag(keys, tree, spec)
                use = np.flatnonzero(seen & (w > 0))
                total += grow_and_predict(bins[use], y[use], w[use], held, spec, spec.depth, n_bins,
                                          np.random.default_rng([spec.seed, 1, fold, tree, 0]))
            yield pa.RecordBatch.from_arrays([pa.array(held_keys, pa.int64()), pa.array(total), pa.array(np.full(len(held), len(trees)))],
                                             ["h", "total", "trees"])


# ------------------------------------------------------------------ large nodes
def _node_features(spec: ForestSpec, tree: int, node: int, n: int) -> np.ndarray:
    return np.random.default_rng([spec.seed, tree, node]).permutation(n)[:spec.subset(n)]


def _count(blocks, trees, asked, spec, fold, n_features, n_bins):
    """Histograms of the asked ``(tree, node)`` pairs over the rows of a partition."""
    hist = {}
    for keys, y, folds, bins in blocks:
        seen = (folds != fold) & ~np.isnan(y)
        for tree in sorted({t for t, _ in asked}):
            at, w = bo.route(trees[tree], bins), bag(keys, tree, spec) * seen
            for i, (t, node) in enumerate(asked):
                if t != tree:
                    continue
                rows = np.flatnonzero((at == node) & (w > 0))
                sums = hist.setdefault(i, np.zeros((3, n_features, n_bins)))
                for j in _node_features(spec, tree, node, n_features).tolist():
                    for part, x in enumerate((w[rows] * y[rows], w[rows], None)):
                        sums[part, j] += np.bincount(bins[rows, j], x, n_bins)
    for i, sums in hist.items():
        flat = sums.reshape(3, -1)
        cell = np.flatnonzero(flat[2])
        if len(cell):
            yield (0, i), (cell, flat[:, cell])


def split_large(table: BinnedTable, spec: ForestSpec, fold: int) -> tuple[list[bo.Tree], list[set]]:
    """The trees down to nodes of at most ``LOCAL_ROWS`` rows, and the nodes of each that are left to grow."""
    trees, left = [bo.Tree() for _ in range(spec.trees)], [{0} for _ in range(spec.trees)]
    if table.rows.where((F.col("fold") != fold) & F.col("y").isNotNull()).count() <= LOCAL_ROWS:
        return trees, left
    held = table.rows.mapInArrow(lambda batches: batches, _TABLE).rdd.mapPartitions(partial(_rows_as_arrays, n_features=table.n_features))
    held = held.persist(StorageLevel.MEMORY_AND_DISK)
    large = [(t, 0) for t in range(spec.trees)]
    cells = table.n_features * table.n_bins
    while large:
        asked, large = large[:max(bo.PASS_CELLS // cells, 1)], large[max(bo.PASS_CELLS // cells, 1):]
        work = partial(_count, trees=[t.arrays() for t in trees], asked=asked, spec=spec, fold=fold, n_features=table.n_features, n_bins=table.n_bins)
        found = bo.best_of_pass(held.mapPartitions(work), [_SQUARED], table.n_bins, table.n_features)
        for i, (t, node) in enumerate(asked):
            gain, feature, cut, g, h, n, gl, hl, nl = found.get((0, i), (-np.inf, 0, 0, 0.0, 0.0, 0, 0.0, 0.0, 0))
            tree, depth = trees[t], trees[t].depth[node] + 1
            left[t].discard(node)
            tree.value[node] = g / h if h else 0.0
            if not gain > 1e-12 * abs(g * g / max(h, 1)) or depth > spec.depth:
                continue
            tree.feature[node], tree.cut[node] = feature, cut
            tree.left[node], tree.right[node] = tree.add(gl / hl, nl, depth), tree.add((g - gl) / (h - hl), n - nl, depth)
            for child, rows in ((tree.left[node], nl), (tree.right[node], n - nl)):
                if depth < spec.depth and rows > 1:
                    if rows > LOCAL_ROWS:
                        large.append((t, child))
                    else:
                        left[t].add(child)
    held.unpersist()
    return trees, left


def _rows_as_arrays(rows, n_features):
    part = list(rows)
    if part:
        keys, y, fold = np.array([r[0] for r in part], np.int64), np.array([np.nan if r[1] is None else r[1] for r in part]), np.array([r[2] for r in part])
        yield keys, y, fold, np.frombuffer(b"".join(r[3] for r in part), np.uint8).reshape(len(part), n_features)


# ------------------------------------------------------------------ subtrees
_DEALT = "tree int, node int, chunk long, held boolean, rows long, block binary"


def _deal(batches, sent, spec, fold, n_features):
    """The rows of each node that a task finishes, packed; left-out rows of finished leaves need not meet."""
    trees, left = sent.value
    for batch in batches:
        keys, y, folds, bins = _columns(batch, n_features)
        if not len(keys):
            continue
        own, out = folds == fold, []
        for t, (tree, nodes) in enumerate(zip(trees, left)):
            at = bo.route(tree, bins)
            grows = np.isin(at, list(nodes))
            fits = ~own & grows & ~np.isnan(y) & (bag(keys, t, spec) > 0)
            for held, use in ((False, fits), (True, own)):
                for node in np.unique(at[use]).tolist():
                    rows = np.flatnonzero(use & (at == node))
                    raw = keys[rows].tobytes() + y[rows].tobytes() + bins[rows].tobytes()
                    out.append((t, node, 0 if node in nodes else int(keys[rows[0]]), held, len(rows), raw))
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["tree", "node", "chunk", "held", "rows", "block"])


def _unpack(table, held: bool, n_features):
    parts = [(r["rows"], r["block"]) for r in table.to_pylist() if r["held"] is held]
    keys = np.concatenate([np.frombuffer(b, np.int64, n) for n, b in parts] or [np.zeros(0, np.int64)])
    y = np.concatenate([np.frombuffer(b, np.float64, n, 8 * n) for n, b in parts] or [np.zeros(0)])
    bins = np.concatenate([np.frombuffer(b, np.uint8, n * n_features, 16 * n).reshape(n, n_features) for n, b in parts]
                          or [np.zeros((0, n_features), np.uint8)])
    order = np.argsort(keys, kind="stable")  # sums do not depend on the order of arrival
    return keys[order], y[order], bins[order]


def _finish(key, table, sent, spec, fold, n_features, n_bins):
    tree, node = key[0].as_py(), key[1].as_py()
    trees, left = sent.value
    held_keys, _, held = _unpack(table, True, n_features)
    keys, y, bins = _unpack(table, False, n_features)
    if node in left[tree] and len(keys) and len(held):
        rng = np.random.default_rng([spec.seed, 1, fold, tree, node])
        value = grow_and_predict(bins, y, bag(keys, tree, spec), held, spec, spec.depth - int(trees[tree]["depth"][node]), n_bins, rng)
    else:
        value = np.full(len(held), float(trees[tree]["value"][node]))
    return pa.table({"h": pa.array(held_keys, pa.int64()), "value": pa.array(value, pa.float64())})


def fold_predictions(table: BinnedTable, spec: ForestSpec, fold: int) -> DataFrame:
    """``h, prediction`` of the rows of ``fold`` by the forest of the other rows, stored."""
    spark = table.rows.sparkSession
    sc = spark.sparkContext
    if table.sent is not None:
        tasks = min(spec.trees, 4 * sc.defaultParallelism)
        sums = spark.range(0, tasks, 1, tasks).mapInArrow(
            partial(_whole_trees, sent=table.sent, spec=spec, fold=fold, n_bins=table.n_bins, tasks=tasks), "h long, total double, trees long")
        return _decided(sums.groupBy("h").agg((F.sum("total") / F.sum("trees")).alias("prediction")), spec)
    trees, left = split_large(table, spec, fold)
    arrays = [{**t.arrays(), "depth": np.array(t.depth)} for t in trees]
    sent = sc.broadcast((arrays, left))
    groups = max(1, min(sum(len(nodes) for nodes in left), 10_000))
    sizes = {"spec": spec, "fold": fold, "n_features": table.n_features}
    dealt = (table.rows.mapInArrow(partial(_deal, sent=sent, **sizes), _DEALT).repartition(groups, "tree", "node", "chunk"))
    values = dealt.groupBy("tree", "node", "chunk").applyInArrow(
        partial(_finish, sent=sent, n_bins=table.n_bins, **sizes), "h long, value double")
    return _decided(values.groupBy("h").agg(F.avg("value").alias("prediction")), spec)


def _decided(mean: DataFrame, spec: ForestSpec) -> DataFrame:
    """Means of a forest's predictions, or the classes they decide for, stored."""
    if spec.classify:
        mean = mean.select("h", (F.round("prediction", 12) > 0.5).cast("double").alias("prediction"))
    return write_shared(mean)
