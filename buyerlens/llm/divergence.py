"""Source divergence audit over a minimal acyclic transducer vocabulary (operator 13).

A first pass counts, per language, the documents of each term.  The terms that
enough documents hold are sorted and dealt into ranges, and a task builds one
minimal acyclic transducer for each range by adding its terms in order (states
that can no longer change are merged with equal ones).  A transition carries
the number of terms of the range before those it leads to, so the outputs on a
term's path add up to its lexicographic ordinal.

A second pass streams the whole text through the transducers and counts
``(lang, source, ordinal)``.  Tasks get the transducers as broadcasts of at
most ``PASS_BYTES``; a larger vocabulary takes several passes over the text.
Ordinals replace terms in all later shuffles and break ties.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from buyerlens.llm.text import column_bytes, row_groups, words
from buyerlens.session import ship_package, write_shared

MIN_DOCS = 30
TOP_TERMS = 50
#: Added to every count, and the number that probabilities are scaled to.
SMOOTHING, SCALE = 5, 1_000_000_000
#: Terms of one transducer, and the bytes of transducers in one broadcast.
RANGE_TERMS = 20_000
PASS_BYTES = 32 << 20
GROUP_BYTES = 4 << 20
#: Ordinals whose probabilities one task compares at a time, for all sources of a language.
BLOCK = 2048

# Bytes of terms, lower-cased; all other bytes become blanks.
_TERM_BYTES = np.full(256, 0x20, np.uint8)
_TERM_BYTES[0x61:0x7B] = _TERM_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERM_BYTES[0x80:] = np.arange(0x80, 0x100)


class Transducer:
    """Minimal acyclic automaton of a sorted term list that maps each term to its place in the list."""

    def __init__(self, keys, targets, outputs, final, root: int):
        # transition ``keys`` are state * 256 + byte, ascending
        self.keys, self.targets, self.outputs, self.final, self.root = keys, targets, outputs, final, root

    @classmethod
    def build(cls, terms: list[bytes]) -> "Transducer":
        """``terms`` are distinct and ascend by bytes."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        sizes: list[int] = []

        def freeze(path, depth):
            while len(path) > depth + 1:
                final, labels, targets = path.pop()
                state = (final, tuple(labels), tuple(targets))
                at = known.get(state)
                if at is None:
                    at = known[state] = len(states)
                    states.append(state)
                    sizes.append(final + sum(sizes[t] for t in targets))
                path[-1][2].append(at)

        # open states along the last term: [final, bytes, target of each byte but the last]
        path, last = [[False, [], []], [False, [], []]], b""
        for term in terms:
            same = len(os.path.commonprefix([last, term]))
            freeze(path, same + 1)
            for byte in term[same:]:
                path[-1][1].append(byte)
                path.append([False, [], []])
            path[-1][0] = True
            last = term
        freeze(path, 0)
        keys, targets, outputs = [], [], []
        for at, (final, labels, to) in enumerate(states):
            before = int(final)
            for label, target in zip(labels, to):
                keys.append(at * 256 + label)
                targets.append(target)
                outputs.append(before)
                before += sizes[target]
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32),
                   np.array([s[0] for s in states], bool), len(states) - 1)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), len(self.final), self.root], np.int64)
        return b"".join(a.tobytes() for a in (head, self.keys, self.targets, self.outputs, self.final))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Transducer":
        n, m, root = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24
        parts = []
        for kind, size, width in ((np.int64, n, 8), (np.int32, n, 4), (np.int32, n, 4), (bool, m, 1)):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += size * width
        return cls(*parts, root)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each byte span in the term list, or -1; all spans advance one byte at a time."""
        out = np.full(len(starts), -1, np.int64)
        live, state, place = np.arange(len(starts)), np.full(len(starts), self.root), np.zeros(len(starts), np.int64)
        step = 0
        while len(live):
            done = starts[live] + step == ends[live]
            if done.any():
                hit = done & self.final[state]
                out[live[hit]] = place[hit]
                live, state, place = live[~done], state[~done], place[~done]
            if not len(live) or not len(self.keys):
                break
            key = state * 256 + data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, place = self.targets[at].astype(np.int64), place[ok] + self.outputs[at]
            step += 1
        return out


class Vocabulary:
    """Transducers of consecutive term ranges per language: rows of ``lang, first term, ordinal of it, transducer``."""

    def __init__(self, ranges: list[tuple[str, str, int, bytes]]):
        self.of: dict[str, tuple[list, list, list]] = {}
        for lang, first, base, raw in sorted(ranges, key=lambda r: (r[0], r[1].encode())):
            firsts, bases, machines = self.of.setdefault(lang, ([], [], []))
            firsts.append(first.encode())
            bases.append(base)
            machines.append(Transducer.from_bytes(raw))

    def ordinals(self, lang: str, data, starts, ends) -> np.ndarray:
        out = np.full(len(starts), -1, np.int64)
        if lang not in self.of:
            return out
        firsts, bases, machines = self.of[lang]
        if len(machines) == 1:
            part = np.zeros(len(starts), np.int64)
        else:
            raw = data.tobytes()
            part = np.array([bisect_right(firsts, raw[a:b]) - 1 for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        for k, machine in enumerate(machines):
            at = np.flatnonzero(part == k)
            found = machine.ordinals(data, starts[at], ends[at])
            out[at] = np.where(found >= 0, found + bases[k], -1)
        return out


def _term_groups(batches):
    """Per few megabytes of text: rows, bytes, term spans, the text of each term, its number among the distinct terms
    and a place of each distinct term."""
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        for i, j in row_groups(offsets, GROUP_BYTES):
            part = _TERM_BYTES[data[offsets[i]:offsets[j]]]
            h, s, e, ends = words(part, offsets[i:j + 1] - offsets[i])
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            yield batch.slice(i, j - i), part, s, e, np.repeat(np.arange(j - i), np.diff(ends)), back.reshape(-1), at


def _codes(*columns) -> tuple[np.ndarray, list]:
    """Number of each row's combination of string values, and the combinations."""
    rows = list(zip(*[c.to_pylist() for c in columns]))
    known: dict[tuple, int] = {}
    return np.array([known.setdefault(r, len(known)) for r in rows], np.int64), list(known)


def _document_counts(batches):
    for rows, part, s, e, text, term, at in _term_groups(batches):
        lang, names = _codes(rows.column("lang"))
        m = max(len(at), 1)
        held = np.unique(text * m + term)  # each term once a document
        pair, docs = np.unique(lang[held // m] * m + held % m, return_counts=True)
        raw = part.tobytes()
        first = at[pair % m] if len(pair) else at[:0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k][0] for k in (pair // m).tolist()], pa.string()),
             pa.array([raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())], pa.binary()).cast(pa.string()),
             pa.array(docs, pa.int64())], ["lang", "term", "docs"])


def _recount(batches, sent):
    vocabulary = Vocabulary(sent.value)
    for rows, part, s, e, text, term, at in _term_groups(batches):
        group, names = _codes(rows.column("lang"), rows.column("source"))
        m = max(len(at), 1)
        pair, counts = np.unique(group[text] * m + term, return_counts=True)
        which, first = pair // m, at[pair % m] if len(pair) else at[:0]
        lang = np.array([n[0] for n in names], object)[which] if len(pair) else np.zeros(0, object)
        place = np.full(len(pair), -1, np.int64)
        for name in {n[0] for n in names}:
            own = np.flatnonzero(lang == name)
            distinct, back = np.unique(first[own], return_inverse=True)
            place[own] = vocabulary.ordinals(name, part, s[distinct], e[distinct])[back.reshape(-1)]
        kept = np.flatnonzero(place >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k][0] for k in which[kept].tolist()], pa.string()),
             pa.array([names[k][1] for k in which[kept].tolist()], pa.string()),
             pa.array(place[kept], pa.int64()), pa.array(counts[kept], pa.int64())], ["lang", "source", "ord", "n"])


def _build_ranges(batches, size: int):
    """One transducer for up to ``size`` consecutive terms of a language, and each term's place in its range."""
    number = TaskContext.get().partitionId() << 32
    lang, terms = None, []

    def close():
        nonlocal number
        raw = Transducer.build([t.encode() for t in terms]).to_bytes()
        k = len(terms)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (k + 1), pa.string()), pa.array([number] * (k + 1), pa.int64()),
             pa.array([*range(k), k], pa.int64()), pa.array([*terms, terms[0]], pa.string()),
             pa.array([None] * k + [raw], pa.binary())], ["lang", "range", "place", "term", "machine"])
        number += 1

    for batch in batches:
        for name, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
            if terms and (name != lang or len(terms) == size):
                yield from close()
                terms = []
            lang = name
            terms.append(term)
    if terms:
        yield from close()


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS, range_terms: int = RANGE_TERMS) -> tuple[DataFrame, DataFrame]:
    """``(terms, ranges)`` of ``docs(text, lang, source)``: ``lang, term, ord`` of every term in at least ``min_docs``
    documents of its language, and ``lang, first, base, n, machine`` of each range of consecutive terms."""
    kept = (docs.mapInArrow(_document_counts, "lang string, term string, docs long").groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term"))
    kept = write_shared(kept)
    built = write_shared(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(
        partial(_build_ranges, size=range_terms), "lang string, range long, place long, term string, machine binary"))
    # of a range: its terms before the others of its language; one row a range
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    ranges = built.filter("machine is not null").select("lang", "range", F.col("term").alias("first"), F.col("place").alias("n"), "machine")
    bases = ranges.select("lang", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    terms = built.filter("machine is null").join(bases, ["lang", "range"]).select("lang", "term", (F.col("place") + F.col("base")).alias("ord"))
    return terms, ranges.join(bases, ["lang", "range"]).select("lang", "first", "base", "n", "machine")


def recount(docs: DataFrame, ranges: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``lang, source, ord, n`` of every kept term that a source uses, from the text streamed through the transducers.

    Each pass broadcasts ranges of ``pass_bytes`` together (at least one, whose terms are bounded)."""
    spark = docs.sparkSession
    ranges = write_shared(ranges)
    sizes = ranges.select("lang", "first", F.octet_length("machine").alias("size")).orderBy("lang", "first").collect()  # one row a range
    passes, left = [], 0
    for r in sizes:
        if left < r["size"] or not passes:
            passes.append([])
            left = pass_bytes
        passes[-1].append((r["lang"], r["first"]))
        left -= r["size"]
    out = spark.createDataFrame([], "lang string, source string, ord long, n long")
    for part in passes:
        low, high = part[0], part[-1]
        at = F.struct("lang", "first")
        chosen = ranges.filter((at >= F.struct(F.lit(low[0]), F.lit(low[1]))) & (at <= F.struct(F.lit(high[0]), F.lit(high[1]))))
        sent = spark.sparkContext.broadcast([(r["lang"], r["first"], r["base"], bytes(r["machine"])) for r in chosen.collect()])
        counted = write_shared(docs.mapInArrow(partial(_recount, sent=sent), out.schema)
                               .groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")))
        sent.destroy()
        out = counted if len(passes) == 1 else out.unionAll(counted)
    return out


def _probability(n, total, size) -> F.Column:
    """``1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * size))`` in whole numbers."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + F.lit(SMOOTHING).cast("decimal(1,0)"))
    under = total.cast("decimal(19,0)") + F.lit(SMOOTHING).cast("decimal(1,0)") * size.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def _distances(key, table):
    """Sums of absolute differences between all sources of one language over one block of ordinals."""
    lang, block = key[0].as_py(), key[1].as_py()
    ord_ = table.column("ord").to_numpy(zero_copy_only=False).astype(float)
    base = np.isnan(ord_)
    source, p = table.column("source").to_pylist(), table.column("p").to_numpy()
    frame = np.flatnonzero(base)
    names = sorted(source[k] for k in frame.tolist())
    number = {name: k for k, name in enumerate(names)}
    where = np.array([number[x] for x in source], np.int64)
    width = min(max(int(table.column("size")[int(frame[0])].as_py()) - block * BLOCK, 0), BLOCK)
    matrix = np.zeros((len(names), width), np.int64)
    matrix[where[frame]] = p[frame][:, None]
    used = np.flatnonzero(~base)
    matrix[where[used], ord_[used].astype(np.int64) - block * BLOCK] = p[used]
    left, right = np.triu_indices(len(names), 1)
    value = np.concatenate([np.zeros(0, np.int64), *[np.abs(matrix[k + 1:] - matrix[k]).sum(axis=1) for k in range(len(names) - 1)]])
    take = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "a": take.take(pa.array(left)), "b": take.take(pa.array(right)),
                     "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, range_terms: int = RANGE_TERMS,
          pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(text, lang, source)``; null strings are read as ''.

    Part ``pair`` compares a source with every other one of its language (``value``: summed distance of
    their smoothed term shares, 0 without kept terms), part ``term`` lists the ``top_terms`` kept terms it
    uses most above its language's share.  Every row is a document, repeated ones too; groups without terms
    take part; other columns are ignored; an empty table gives no rows.  A task holds one block of
    ordinals for all sources of a language.
    """
    ship_package(docs.sparkSession)

    def read(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    docs = docs.select(read("text"), read("lang"), read("source"))
    terms, ranges = vocabulary(docs, min_docs, range_terms)
    counts = recount(docs, ranges, pass_bytes)
    sizes = terms.groupBy("lang").agg(F.count("*").alias("size"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = write_shared(docs.groupBy("lang", "source").count().drop("count")
                          .join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
                          .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "size")]))
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "ord", "size", _probability(F.col("n"), F.col("total"), F.col("size")).alias("p"))
    # pair: every block of ordinals gets all sources of its language with the share of an unused term
    unused = F.when(F.col("size") > 0, _probability(F.lit(0), F.col("total"), F.greatest("size", F.lit(1)))).otherwise(F.lit(0).cast("long"))
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(size - 1) div {BLOCK}"), F.lit(0).cast("long")))
    frame = groups.select("lang", F.explode(blocks).alias("block"), "source", F.lit(None).cast("long").alias("ord"), "size", unused.alias("p"))
    dense = frame.unionAll(shares.select("lang", F.expr(f"ord div {BLOCK}").alias("block"), "source", "ord", "size", "p"))
    sums = (dense.groupBy("lang", "block").applyInArrow(_distances, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    group = Window.partitionBy("lang", "source")
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value").select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value",
        F.row_number().over(group.orderBy(F.desc("value"), "item")).alias("rank"))
    # term: shares above the language's own, ties by ordinal
    lang_n = counts.groupBy("lang", "ord").agg(F.sum("n").alias("lang_n"))
    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    own = (shares.join(lang_n, ["lang", "ord"]).join(lang_total, "lang")
           .select("lang", "source", "ord", (F.col("p") - _probability(F.col("lang_n"), F.col("lang_total"), F.col("size"))).alias("value"))
           .filter("value > 0").withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "ord")))
           .filter(F.col("rank") <= top_terms))
    top = own.join(terms, ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionAll(top)


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
cnt AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source) LEFT JOIN sizes USING (lang)),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
                1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (g.n + 5 * g.v) AS p
         FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
lang_n AS (SELECT lang, sum(n)::HUGEINT AS n FROM g GROUP BY lang),
lang_p AS (SELECT cnt.lang, term, 1 + 1000000000::HUGEINT * (sum(c)::HUGEINT + 5) // (any_value(l.n) + 5 * any_value(s.v)) AS q
           FROM cnt JOIN lang_n l ON l.lang = cnt.lang JOIN sizes s ON s.lang = cnt.lang GROUP BY cnt.lang, term),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
tops AS (SELECT lang, source, term AS item, p - q AS value FROM grid JOIN lang_p USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value,
                      (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM tops)
WHERE rank <= 50
"""
