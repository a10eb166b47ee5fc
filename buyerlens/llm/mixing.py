"""Mixing sources to target weights by iterative proportional fitting (operator 5).

Documents fall into cells (source, language, topic).  The cells' token totals
are raked until the source, language and topic marginals meet their targets;
a document is kept with probability ``min(1, scale * raked / own)`` of its
cell, by a draw that depends on its id only.

Every category has its own target, however small.  Up to ``LOCAL_CELLS`` cells
are raked on the driver; more stay a DataFrame, where each sweep is one pass
that finds the factors of the sources and sends the (language, topic) totals
to the driver, and documents are joined with their cells.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from buyerlens.llm.text import FOLDED_BYTE, U64, column_bytes, mix, row_groups, span_hashes, word_spans
from buyerlens.session import ship_package, write_shared

TOPICS = 8
#: Words of at least this many bytes vote for a topic.
TOPIC_WORD = 6
LOCAL_CELLS = 50_000
OTHER = "other"


@dataclass
class Targets:
    """Wanted token shares.  A dict names shares (the rest goes to ``other``); a number flattens
    the measured shares of all categories to that power (1 keeps them, 0 makes them equal)."""
    source: dict[str, float] | float = 0.9
    lang: dict[str, float] | float = 0.9
    topic: dict[str, float] | float = 0.9


@dataclass
class Mix:
    """Probability of each cell, in ``prob`` or, for many cells, in ``table``; ``names`` are the
    categories that a dict of targets names (None: every category is its own)."""
    names: dict[str, set | None]
    prob: dict[tuple, float] = field(default_factory=dict)
    weight: dict[tuple, float] = field(default_factory=dict)
    shares: dict[str, dict] = field(default_factory=dict)
    sweeps: int = 0
    table: DataFrame | None = None


def topics_and_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Topic (-1: no long word) and number of words of each row.  Every long word votes for the
    topic its hash names; the most votes win, ties go to the smallest topic."""
    s, e = word_spans(data, offsets)
    n = len(offsets) - 1
    row = np.searchsorted(offsets, s, side="right") - 1
    tokens = np.bincount(row, minlength=n)
    long = e - s >= TOPIC_WORD
    vote = (span_hashes(data, s[long], e[long], FOLDED_BYTE) % U64(TOPICS)).astype(np.int64)
    votes = np.bincount(row[long] * TOPICS + vote, minlength=n * TOPICS).reshape(n, TOPICS)
    return np.where(votes.any(axis=1), votes.argmax(axis=1), -1), tokens


def draws(doc_ids: pa.Array, tokens: np.ndarray) -> np.ndarray:
    """Uniform number of each document, from its id (null id: from its word count)."""
    missing = np.asarray(doc_ids.is_null())
    ids = np.asarray(doc_ids.fill_null(0)).astype(np.int64)
    key = np.where(missing, -1 - tokens, ids).astype(np.int64).view(np.uint64)
    return (mix(mix(key + U64(0x9E3779B97F4A7C15)) + missing.astype(np.uint64)) >> U64(11)).astype(float) / 2.0 ** 53


def _profile(batches):
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        topic, tokens = [], []
        for i, j in row_groups(offsets):
            a, b = topics_and_tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            topic.append(a)
            tokens.append(b)
        topic = np.concatenate(topic) if topic else np.zeros(0, np.int64)
        tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "source", "lang")]
            + [pa.array(topic).cast(pa.string()), pa.array(tokens.astype(np.int64)),
               pa.array(draws(batch.column("doc_id"), tokens))],
            ["doc_id", "source", "lang", "topic", "n_tokens", "draw"])


def profiles(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, draw`` of every row; null source or lang is ''."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")])
    return rows.mapInArrow(_profile, "doc_id long, source string, lang string, topic string, "
                                     "n_tokens long, draw double")


def rake(own: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], sweeps: int = 1000,
         tolerance: float = 1e-10) -> tuple[np.ndarray, int]:
    """Scale positive cell totals until each margin ``(category of each cell, target share)`` is met.
    Targets of categories without a cell are spread over the others."""
    w = own / own.sum()
    for sweep in range(1, sweeps + 1):
        worst = 0.0
        for code, target in margins:
            have = np.bincount(code, weights=w, minlength=len(target))
            goal = np.where(have > 0, target, 0.0)
            goal = goal / goal.sum()
            factor = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            worst = max(worst, float(np.abs(goal - have).max()))
            w = w * factor[code]
        if worst < tolerance:
            break
    return w, sweep


def _target(kind, total: dict[str, float]) -> dict[str, float]:
    whole = sum(total.values())
    if isinstance(kind, dict):
        share = {c: kind.get(c, 0.0) for c in total}
        share[OTHER] = share.get(OTHER, 0.0) or max(0.0, 1.0 - sum(v for c, v in kind.items() if c != OTHER))
        return share
    share = {c: (t / whole) ** kind for c, t in total.items() if t > 0}
    rest = sum(share.values())
    return {c: v / rest for c, v in share.items()}


def _source_pass(batches, given, kind, langs: dict, topics: dict, weights: bool):
    """One row per batch with the (language, topic) totals once every source has its target; with
    ``weights`` one row per cell with its weight."""
    g, h, whole, norm = given.value
    for batch in batches:
        total = np.zeros((len(g), len(h)))
        out: list[tuple] = []
        for source, cells in zip(batch.column("source").to_pylist(), batch.column("cells")):
            v = cells.values
            l_, t_ = v.field("lang").to_pylist(), v.field("topic").to_pylist()
            i, j = np.array([langs[x] for x in l_]), np.array([topics[x] for x in t_])
            own = v.field("t").to_numpy().astype(float) / whole
            target = kind.get(source, 0.0) if isinstance(kind, dict) else own.sum() ** kind / norm
            have = float((own * g[i] * h[j]).sum())
            factor = target / have if have > 0 else 0.0
            if weights:
                out += [(source, x, y, float(w), float(o * whole)) for x, y, w, o in zip(l_, t_, factor * g[i] * h[j], own)]
            else:
                np.add.at(total, (i, j), factor * own * g[i] * h[j])
        if weights:
            kinds = [pa.string()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)],
                                             ["source", "lang", "topic", "weight", "t"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])


def _rake_table(cells: DataFrame, targets: Targets, mix_: Mix, keep_share: float | None, sweeps: int = 1000,
                tolerance: float = 1e-10) -> None:
    """``rake`` for cells that stay a DataFrame.  After the source step the language and topic steps
    need the (language, topic) totals only."""
    sc = cells.sparkSession.sparkContext
    pairs = cells.groupBy("lang", "topic").agg(F.sum("t").alias("t")).collect()
    whole = float(sum(r["t"] for r in pairs))
    codes, goals = [], []
    for c in ("lang", "topic"):
        total: dict[str, float] = {}
        for r in pairs:
            total[r[c]] = total.get(r[c], 0.0) + r["t"]
        mix_.shares[c] = _target(getattr(targets, c), total)
        codes.append({k: i for i, k in enumerate(sorted(total))})
        goals.append(np.array([mix_.shares[c].get(k, 0.0) for k in sorted(total)]))
    sources = cells.groupBy("source").agg(F.sum("t").alias("s"), F.collect_list(F.struct("lang", "topic", "t")).alias("cells"))
    sources, kind, norm = write_shared(sources), targets.source, 1.0
    if isinstance(kind, dict):  # few sources: the named ones and the rest
        kind = mix_.shares["source"] = _target(kind, {r["source"]: float(r["s"]) for r in sources.select("source", "s").collect()})
    else:
        norm = sources.agg(F.sum(F.pow(F.col("s") / whole, F.lit(float(kind))))).first()[0]
    g, h = (np.ones(len(v)) for v in goals)

    def run(weights, schema):
        given = sc.broadcast((g, h, whole, norm))
        return sources.select("source", "cells").mapInArrow(partial(
            _source_pass, given=given, kind=kind, langs=codes[0], topics=codes[1], weights=weights), schema)

    for mix_.sweeps in range(1, sweeps + 1):
        total = sum(np.frombuffer(r["total"]).reshape(len(g), len(h)) for r in run(False, "total binary").toLocalIterator())
        total, worst = total / total.sum(), 0.0
        for axis, goal in ((0, goals[0]), (1, goals[1])):
            have = total.sum(axis=1 - axis)
            goal = np.where(have > 0, goal, 0.0) / goal[have > 0].sum()
            factor = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            worst = max(worst, float(np.abs(goal - have).max()))
            total = total * (factor[:, None] if axis == 0 else factor)
            g, h = (g * factor, h) if axis == 0 else (g, h * factor)
        if worst < tolerance:
            break
    table = write_shared(run(True, "source string, lang string, topic string, weight double, t double"))
    low, high = table.agg(F.min(F.when(F.col("weight") > 0, F.col("weight"))), F.max("weight")).first()
    scale = 1 / high
    if keep_share is not None:
        lo, hi = 0.0, 1 / max(low, 1e-300)
        for _ in range(10):
            mids = np.linspace(lo, hi, 34)[1:-1]
            got = table.agg(*[F.sum(F.least(F.lit(1.0), F.col("weight") * float(m)) * F.col("t")) for m in mids]).first()
            n = sum(v < keep_share * whole for v in got)
            lo, hi = ([lo, *mids][n], [*mids, hi][n])
        scale = hi
    mix_.table = table.select("source", "lang", "topic", "weight", F.least(F.lit(1.0), F.col("weight") * float(scale)).alias("probability"))


def _cell_columns(names: dict[str, set | None]) -> list:
    return [F.col(c) if n is None else (F.when(F.col(c).isin(*n), F.col(c)).otherwise(OTHER).alias(c) if n else F.lit(OTHER).alias(c))
            for c, n in names.items()]


def fit_mix(rows: DataFrame, targets: Targets, keep_share: float | None = None) -> Mix:
    """Rake the cells of ``profiles()`` rows.  ``keep_share`` is the wanted share of all tokens; by
    default the largest sample is drawn that has the targets' shares without repeating a document."""
    fields = ("source", "lang", "topic")
    names = {}
    for c in fields:
        kind = getattr(targets, c)
        names[c] = set(kind) - {OTHER} if isinstance(kind, dict) else None
    table = write_shared(rows.groupBy(*_cell_columns(names)).agg(F.sum("n_tokens").alias("t")).filter("t > 0"))
    mix_ = Mix(names)
    if table.count() > LOCAL_CELLS:
        _rake_table(table, targets, mix_, keep_share)
        return mix_
    cells = table.collect()
    if not cells:
        return mix_
    cells.sort(key=lambda r: tuple(r[c] for c in fields))
    own = np.array([float(r["t"]) for r in cells])
    margins = []
    for c in fields:
        total: dict[str, float] = {}
        for r in cells:
            total[r[c]] = total.get(r[c], 0.0) + r["t"]
        share = _target(getattr(targets, c), total)
        cats = {k: i for i, k in enumerate(sorted(total))}
        margins.append((np.array([cats[r[c]] for r in cells]), np.array([share.get(k, 0.0) for k in cats])))
        mix_.shares[c] = share
    raked, mix_.sweeps = rake(own, margins)
    weight = raked / (own / own.sum())
    prob = weight / weight.max()
    if keep_share is not None:
        lo, hi = 0.0, 1.0 / max(weight[weight > 0].min(), 1e-300)
        for _ in range(200):
            mid = (lo + hi) / 2
            if (np.minimum(1, mid * weight) * own).sum() < keep_share * own.sum():
                lo = mid
            else:
                hi = mid
        prob = np.minimum(1, hi * weight)
    for r, p, w in zip(cells, prob, weight):
        key = tuple(r[c] for c in fields)
        mix_.prob[key], mix_.weight[key] = float(p), float(w)
    return mix_


def cell_of(mix_: Mix, source: str, lang: str, topic: str) -> tuple:
    return tuple(v if mix_.names[c] is None or v in mix_.names[c] else OTHER for c, v in (("source", source), ("lang", lang), ("topic", topic)))


def _decide(batches, mix_):
    """Append each profile row's weight, probability and decision; cells without tokens are kept."""
    for batch in batches:
        m = mix_.value
        keys = [cell_of(m, *k) for k in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "topic")))]
        prob = np.array([m.prob.get(k, 1.0) for k in keys], float)
        weight = np.array([m.weight.get(k, 1.0) for k in keys], float)
        kept = batch.column("draw").to_numpy() < prob
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "source", "lang", "topic", "n_tokens")]
            + [pa.array(weight), pa.array(prob), pa.array(kept)],
            ["doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept"])


def _profiled(batch):
    """Profile batches of a batch of documents with any columns."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    text = lambda c: get(c).cast(pa.string()).fill_null("")
    rows = pa.RecordBatch.from_arrays([get("doc_id").cast(pa.int64()), text("source"), text("lang"),
                                       get("text").cast(pa.string())], ["doc_id", "source", "lang", "text"])
    return _profile([rows])


def _select(batches, mix_):
    for batch in batches:
        kept = [d.column("kept") for d in _decide(_profiled(batch), mix_)]
        yield batch.filter(pa.concat_arrays(kept)) if kept else batch


def _numbered(batches):
    """Each document as a struct, next to its cell and draw."""
    for batch in batches:
        for p in _profiled(batch):
            n = pa.StructArray.from_arrays([p.column(c) for c in ("source", "lang", "topic", "draw")], ["source", "lang", "topic", "draw"])
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, batch.schema.names), n], ["row", "n"])


def sampled(docs: DataFrame, targets: Targets | None = None, keep_share: float | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, kept`` for every row of
    ``docs(doc_id, text, source, lang)``; ``weight`` is the raked over the measured share of its cell.

    Null and empty texts have no tokens and take their cell's probability (1 if the cell has no
    tokens at all).  Rows with equal doc_id share one draw.  Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = write_shared(profiles(docs))
    mix_ = fit_mix(rows, targets or Targets(), keep_share)
    if mix_.table is not None:
        return _with_cells(rows, mix_).select(
            "doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("kept"))
    fitted = docs.sparkSession.sparkContext.broadcast(mix_)
    return rows.mapInArrow(partial(_decide, mix_=fitted), "doc_id long, source string, lang string, topic string, "
                           "n_tokens long, weight double, probability double, kept boolean")


def _with_cells(rows: DataFrame, mix_: Mix) -> DataFrame:
    """Rows with the weight and probability of their cell, 1 if it has no tokens."""
    fields = ("source", "lang", "topic")
    cells = mix_.table.select(*[F.col(c).alias("_" + c) for c in fields], F.col("weight").alias("_w"), F.col("probability").alias("_p"))
    keys = zip(_cell_columns(mix_.names), fields)
    met = rows.withColumns({"_k_" + c: k for k, c in keys}).join(
        cells, [F.col("_k_" + c) == F.col("_" + c) for c in fields], "left")
    return met.select(*[rows[c] for c in rows.columns], F.coalesce("_w", F.lit(1.0)).alias("weight"),
                      F.coalesce("_p", F.lit(1.0)).alias("probability"))


def mixed(docs: DataFrame, targets: Targets | None = None, keep_share: float | None = None) -> DataFrame:
    """The sampled rows of ``docs``, with all their columns."""
    ship_package(docs.sparkSession)
    rows = write_shared(profiles(docs))
    mix_ = fit_mix(rows, targets or Targets(), keep_share)
    if mix_.table is not None:
        schema = T.StructType([T.StructField("row", docs.schema), T.StructField("n", T.StructType(
            [T.StructField(c, T.StringType()) for c in ("source", "lang", "topic")] + [T.StructField("draw", T.DoubleType())]))])
        met = _with_cells(docs.mapInArrow(_numbered, schema).select("row", "n.*"), mix_)
        return met.filter(F.col("draw") < F.col("probability")).select("row.*")
    fitted = docs.sparkSession.sparkContext.broadcast(mix_)
    return docs.mapInArrow(partial(_select, mix_=fitted), docs.schema)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"))
