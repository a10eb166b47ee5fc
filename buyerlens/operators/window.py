"""Window operators (W1-W4) and ordering helpers.

Global running sums and row numbers (G7)
---------------------------------------
An un-partitioned ``Window.orderBy`` moves every row into one task.  Instead,
``ordered_scan``:

1. range-partitions the rows on (group keys, order keys) - balanced even when
   one score value holds a third of the rows, since the order includes a
   unique tie-breaker - and sorts within partitions;
2. tags rows with their partition index and checkpoints to the reliable
   checkpoint directory (``spark.checkpoint.dir``), which fixes partition
   contents and survives executor loss;
3. collects one summary row per partition (first/last group, row count and
   column sums of the boundary groups) - bounded by the partition count, like
   ``zipWithIndex`` - and turns it into per-partition start offsets;
4. runs a vectorised per-partition scan (Arrow batches via ``mapInArrow``)
   that adds the offsets.  Columns pass through as Arrow arrays, so long and
   decimal values are kept as they are, and NULL is a group of its own.

Only the boundary-group offsets travel to the driver; rows never do.

Ties (rows equal in the leading order columns) get the position of their first
row and their size in the same scan: the summaries also hold the length of each
partition's first run of ties, so the size of a run that crosses partitions is
known before the scan, and a run inside a partition is looked ahead to its end.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from buyerlens.session import ensure_checkpoint_dir, ship_package


def _order_spec(order_by: Sequence) -> list[tuple[str, bool]]:
    """[(column, ascending)] from column names (ascending) or (name, asc) tuples."""
    out = []
    for c in order_by:
        if isinstance(c, str):
            out.append((c, True))
        else:
            name, asc = c
            out.append((name, bool(asc)))
    return out


def _sort_cols(spec):
    return [F.col(n).asc_nulls_first() if a else F.col(n).desc_nulls_last() for n, a in spec]


def ordered_scan(df: DataFrame, order_by: Sequence, partition_by: Sequence[str] = (),
                 sum_cols: Sequence[str] = (), pos_col: str = "_pos",
                 cum_prefix: str = "cum_", num_partitions: int | None = None,
                 tie_cols: Sequence[str] = ()) -> DataFrame:
    """Row number (1-based) and running sums within ``partition_by`` groups in
    the total order ``order_by``; exact and distributed.

    ``order_by`` is a list of column names or ``(name, ascending)`` tuples and
    must make the order total (append the key as tie-breaker).
    Adds ``pos_col`` and ``cum_<c>`` for every ``c`` in ``sum_cols``.  With ``tie_cols``, the first
    columns of ``order_by``, also ``tie_first`` and ``tie_n``: the position of the first row that equals
    this one in them, and the number of such rows (NULL equals NULL).  A run of ties that starts and ends
    inside a partition is held in memory up to its end, one that crosses partitions is not.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spec = _order_spec(order_by)
    groups = list(partition_by)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_sort = [F.col(g).asc_nulls_first() for g in groups] + _sort_cols(spec)
    ranged = (df.repartitionByRange(n, *part_sort).sortWithinPartitions(*part_sort)
              .withColumn("__pid", F.spark_partition_id()))
    ranged = ranged.checkpoint(eager=True)

    sums = list(sum_cols)
    ties = groups + list(tie_cols) if tie_cols else None
    run_schema = [T.StructField("rows", T.LongType()), T.StructField("first_key", T.StringType()),
                  T.StructField("last_key", T.StringType()), T.StructField("first_n", T.LongType()),
                  T.StructField("last_n", T.LongType()),
                  *[T.StructField(f"last_s{j}", T.DoubleType()) for j in range(len(sums))]]
    stat_schema = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("groups", T.StructType(run_schema))]
                               + ([T.StructField("ties", T.StructType(run_schema[:5]))] if ties else []))

    def part_stats(it):
        state = _ScanState(groups, sums, None)
        tied = _ScanState(ties, [], None) if ties else None
        for batch in it:
            state.run(batch)
            if tied:
                tied.run(batch)
        if state.pid is None:
            return
        rec = {"pid": state.pid, "groups": state.summary()}
        if tied:
            rec["ties"] = tied.summary()
        yield pa.RecordBatch.from_pylist([rec], to_arrow_schema(stat_schema))

    # One summary row per non-empty partition: bounded metadata, the same
    # pattern zipWithIndex uses.
    stats = [r.asDict(True) for r in sorted(ranged.mapInArrow(part_stats, stat_schema).collect(), key=lambda r: r["pid"])]
    offsets = _carried({r["pid"]: r["groups"] for r in stats}, len(sums))
    runs = _edge_runs({r["pid"]: r["ties"] for r in stats}) if ties else {}

    out_fields = [f for f in ranged.schema.fields if f.name != "__pid"]
    out_schema = T.StructType(out_fields + [T.StructField(pos_col, T.LongType())]
                              + [T.StructField(cum_prefix + c, T.DoubleType()) for c in sums]
                              + ([T.StructField(c, T.LongType()) for c in ("tie_first", "tie_n")] if ties else []))
    offsets_b = spark.sparkContext.broadcast((offsets, runs))

    def positioned(it, tied):
        """Batches with their positions and sums, and the position of each row in its run of ties."""
        state = _ScanState(groups, sums, offsets_b.value[0])
        for batch in it:
            if batch.num_rows:
                pos, cums = state.run(batch)
                at = tied.run(batch)[0] if tied else None
                names = [n for n in batch.schema.names if n != "__pid"]
                cols = [batch.column(n) for n in names] + [pa.array(pos)] + [pa.array(c, pa.float64()) for c in cums]
                names = names + [pos_col] + [cum_prefix + c for c in sums]
                if tied:
                    cols, names = cols + [pa.array(pos - at + 1)], names + ["tie_first"]
                yield pa.RecordBatch.from_arrays(cols, names), at

    def scan(it):
        if not ties:
            yield from (batch for batch, _ in positioned(it, None))
            return
        edges = offsets_b.value[1]
        tied = _ScanState(ties, [], {pid: (e["before"], []) for pid, e in edges.items()})
        rows = positioned(it, tied)
        for first in rows:  # the state knows its partition once a batch is read
            yield from _with_sizes(itertools.chain([first], rows), edges[tied.pid])

    return ranged.mapInArrow(scan, out_schema)


def _carried(stats: dict, n_sums: int) -> dict:
    """Rows and sums of the groups that go on from the partitions before, by partition.  ``stats`` are in order."""
    offsets = {}
    carry_key, carry_n, carry_s = None, 0, [0.0] * n_sums
    for pid, r in stats.items():
        if carry_key is not None and r["first_key"] == carry_key:
            offsets[pid] = (carry_n, list(carry_s))
        else:
            offsets[pid] = (0, [0.0] * n_sums)
        base_n, base_s = offsets[pid] if r["first_n"] == r["rows"] else (0, [0.0] * n_sums)
        carry_key = r["last_key"]
        carry_n = base_n + r["last_n"]
        carry_s = [b + r[f"last_s{j}"] for j, b in enumerate(base_s)]
    return offsets


def _edge_runs(stats: dict) -> dict:
    """Of each partition: rows before it in its first run of ties, length and whole size of its first run, first row
    and whole size of its last one.  ``stats`` are in order."""
    before = {pid: n for pid, (n, _) in _carried(stats, 0).items()}
    out, later, key = {}, 0, None  # rows of the run that starts the partitions after this one, and its key
    for pid, r in reversed(stats.items()):
        after = later if r["last_key"] == key else 0
        single = r["first_n"] == r["rows"]
        out[pid] = {"before": before[pid], "first_n": r["first_n"],
                    "first_size": before[pid] + r["first_n"] + (after if single else 0),
                    "last_at": r["rows"] if single else r["rows"] - r["last_n"], "last_size": r["last_n"] + after}
        key, later = r["first_key"], r["first_n"] + (after if single else 0)
    return out


def _with_sizes(rows, edge: dict):
    """Batches with the size of each row's run of ties.  The first and the last run of the partition are known from
    ``edge``; rows of another run wait until it ends."""
    def sized(batch, size):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(size)], [*batch.schema.names, "tie_n"])

    held, waiting, seen = [], 0, 0
    for batch, at in rows:
        n = batch.num_rows
        lo, hi = (min(max(edge[c] - seen, 0), n) for c in ("first_n", "last_at"))
        if lo:
            yield sized(batch.slice(0, lo), np.full(lo, edge["first_size"]))
        starts = lo + np.flatnonzero(at[lo:hi] == 1)
        closed = seen + hi >= edge["last_at"]
        first = int(starts[0]) if len(starts) else hi
        if len(starts) or closed:
            total = waiting + first - lo
            for part in [*held, batch.slice(lo, first - lo)]:
                if part.num_rows:
                    yield sized(part, np.full(part.num_rows, total))
            held, waiting = [], 0
            ends = np.append(starts, hi) if closed else starts
            cut = int(ends[-1]) if len(ends) else hi
            if cut > first:
                size = np.diff(ends)
                yield sized(batch.slice(first, cut - first), np.repeat(size, size))
        else:
            cut = lo
        if cut < hi:
            held.append(batch.slice(cut, hi - cut))
            waiting += hi - cut
        if hi < n:
            yield sized(batch.slice(hi), np.full(n - hi, edge["last_size"]))
        seen += n


def _changed(batch: pa.RecordBatch, groups) -> np.ndarray:
    """Whether each row's group differs from the row before it; NULL equals NULL and NaN equals NaN."""
    out = np.ones(batch.num_rows, dtype=bool)
    out[1:] = False
    for g in groups:
        a, b = batch.column(g).slice(1), batch.column(g).slice(0, batch.num_rows - 1)
        differs = pc.not_equal(a, b)
        if pa.types.is_floating(a.type):
            differs = pc.and_(differs, pc.invert(pc.and_(pc.is_nan(a), pc.is_nan(b))))
        differs = pc.or_(pc.fill_null(differs, False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= np.asarray(differs)
    return out


class _ScanState:
    """Running row count and sums of the current group across Arrow batches of
    one partition (rows arrive sorted by group, then order keys)."""

    def __init__(self, groups, sums, offsets):
        self.groups, self.sums, self.offsets = groups, sums, offsets
        self.pid, self.rows, self.first_key, self.first_n = None, 0, None, 0
        self.key, self.n, self.s = None, 0, [0] * len(sums)

    def _key(self, batch, row) -> str:
        values = (batch.column(g)[row].as_py() for g in self.groups)
        return repr(tuple(v + 0.0 if isinstance(v, float) else v for v in values))  # 0.0 equals -0.0

    def summary(self) -> dict:
        """Rows and first and last group of what was read, with their lengths, and the last one's sums."""
        return {"rows": self.rows, "first_key": self.first_key, "last_key": self.key, "first_n": self.first_n,
                "last_n": self.n, **{f"last_s{j}": float(v) for j, v in enumerate(self.s)}}

    def run(self, batch):
        """Positions and running sums of the batch's rows; integer columns are summed exactly."""
        n = batch.num_rows
        if n == 0:
            return None
        first = self._key(batch, 0)
        if self.pid is None:
            self.pid = batch.column("__pid")[0].as_py()
            self.first_key = self.key = first
            if self.offsets is not None:
                self.n, s0 = self.offsets.get(self.pid, (0, [0] * len(self.sums)))
                self.s = list(s0)
        change = _changed(batch, self.groups)
        change[0] = first != self.key
        gid = np.cumsum(change)
        start = np.concatenate([[0], np.flatnonzero(change[1:]) + 1])
        begin = start[gid - gid[0]]
        cont = gid == 0                      # rows continuing the carried group
        pos = np.arange(1, n + 1) - begin + np.where(cont, self.n, 0)
        cums = []
        for j, c in enumerate(self.sums):
            col = batch.column(c)
            if pa.types.is_integer(col.type) or pa.types.is_boolean(col.type):
                v = np.asarray(pc.fill_null(col.cast(pa.int64()), 0))
                total = np.concatenate([[0], np.cumsum(v)])
                cs = total[1:] - total[begin] + np.where(cont, int(self.s[j]), 0)
            else:
                v = np.asarray(pc.fill_null(col.cast(pa.float64()), 0.0))
                cs = pd.Series(v).groupby(gid).cumsum().to_numpy() + np.where(cont, self.s[j], 0.0)
            cums.append(cs)
        if self.first_n == self.rows:  # all rows so far are of the first group
            self.first_n += int(start[1] if len(start) > 1 else n) if not change[0] else 0
        self.rows += n
        self.key, self.n = self._key(batch, n - 1), int(pos[-1])
        self.s = [cs[-1].item() for cs in cums]
        return pos.astype(np.int64), cums


# ---------------------------------------------------------------------------
# W1-W4
# ---------------------------------------------------------------------------

def tie_rank(total) -> Column:
    """Average rank of a row's ties, from an ``ordered_scan`` with ``tie_cols``, as a share of ``total``."""
    return (F.col("tie_first") - 1 + (F.col("tie_n") + 1) / 2.0) / total


def pct_rank_desc(df: DataFrame, score: str, out: str = "n", key: str | None = None) -> DataFrame:
    """``rank(pct=True, ascending=False)`` with average ties.

    rank = (#rows with a larger score) + (ties + 1) / 2, divided by the number
    of non-NULL scores; NULL scores get a NULL rank.  One ordered scan, which also
    measures the ties; ``key`` (unique, any order) splits a hot score over partitions.
    """
    scan = ordered_scan(df, [(score, False)] + ([(key, True)] if key else []), pos_col="__pos", tie_cols=[score])
    total = scan.agg(F.count(score).alias("__N"))
    rank = F.when(F.col(score).isNotNull(), tie_rank(F.col("__N")))
    return scan.crossJoin(F.broadcast(total)).select(*df.columns, rank.alias(out))


def running_sum(df: DataFrame, order_by: Sequence, cols: Sequence[str],
                prefix: str = "cum_") -> DataFrame:
    """``cumsum`` in a total order, distributed (see ``ordered_scan``)."""
    return ordered_scan(df, order_by, sum_cols=cols, cum_prefix=prefix, pos_col="_pos")


def sort_desc(df: DataFrame, col: str, key: str = "ID_BUYER") -> DataFrame:
    """O1: sort by a score descending, key as tie-breaker (total order)."""
    return df.orderBy(F.desc(col), F.asc(key))


def top_k(df: DataFrame, col: str, k: int, key: str = "ID_BUYER") -> DataFrame:
    """O2: first ``k`` rows of O1 - planned as TakeOrderedAndProject."""
    return sort_desc(df, col, key).limit(k)


def argmax_first(df: DataFrame, value: str, arg: str) -> DataFrame:
    """``arg`` at the maximum of ``value``, the smallest ``arg`` on ties."""
    return df.agg(F.max_by(F.col(arg), F.struct(F.col(value), -F.col(arg))).alias(arg),
                  F.max(value).alias(value))



def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles, exact and distributed.

    Spark's exact ``percentile`` merges a map of every distinct value into a
    single buffer per group, i.e. one task holds the whole column.  Here the
    columns are unpivoted to ``(group..., column_name, v)``, ranked within
    each (group, column) with the ordered scan, and only the (at most two)
    rows around each position ``p * (n - 1)`` are kept and interpolated as
    ``lo + (hi - lo) * frac``.  NULLs are ignored.

    Returns ``(group..., column_name, p, value)``.
    """
    groups = list(group_cols)
    long = df.select(*[F.col(g) for g in groups], F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v"))
        for c in cols])).alias("__s")).select(*groups, "__s.column_name", "__s.v")
    long = long.where(F.col("v").isNotNull())
    keys = groups + ["column_name"]
    ranked = ordered_scan(long, [("v", True)], partition_by=keys, pos_col="__pos")
    # one row per (group, column): bounded by groups x columns
    counts = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    grid = df.sparkSession.createDataFrame([(float(p),) for p in probs], "p double")
    want = (counts.crossJoin(F.broadcast(grid))
            .withColumn("__h", F.col("p") * (F.col("__n") - 1).cast("double"))
            .withColumn("__lo", F.floor("__h").cast("long"))
            .withColumn("__hi", F.ceil("__h").cast("long"))
            # the join key holds the position, so no (group, column) gathers its rows in one task
            .withColumn("__pos", F.explode(F.array_distinct(F.array(F.col("__lo") + 1, F.col("__hi") + 1)))))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys] + [F.col("r.__pos") == F.col("w.__pos")]
    picks = ranked.alias("r").join(want.alias("w"), functools.reduce(lambda a, b: a & b, same)).select(
        *[F.col(f"r.{c}") for c in keys], "v", "r.__pos", "p", "__h", "__lo", "__hi")
    agg = picks.groupBy(*keys, "p", "__h", "__lo").agg(
        F.max(F.when(F.col("__pos") - 1 == F.col("__lo"), F.col("v"))).alias("__vlo"),
        F.max(F.when(F.col("__pos") - 1 == F.col("__hi"), F.col("v"))).alias("__vhi"))
    value = F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * (F.col("__h") - F.col("__lo"))
    return agg.select(*keys, "p", value.alias("value"))
