"""Exact or bounded-error percentiles per group by distributed multi-select.

A piece (a day, a quarter, any set of rows) is summarised as sorted runs of values by group, stored
column-wise. Pieces are combined by union; nothing else is needed to select over several of them.
With ``error`` 0 the runs hold the values themselves and percentiles are exact; with ``error`` e each
value is moved to a grid whose steps are a factor (1 + e) ** 2 apart, so runs have a bounded number
of entries and every percentile is within e of the exact one, relatively.

Selection narrows, for all groups and percentiles at once, the ranges that hold the wanted ranks. In
each round partitions propose the medians of what they hold of a range (and of its halves and
quarters); the weighted medians of the proposals become pivots; one pass counts below, at and above
them; and the values of the ranges that are left, with the next proposals, are written to a table that
the next round reads in place of the last one. When a range holds few values they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.joins import lookup
from lodespark.storage import drop_path, new_path, stored

#: Levels of halving in one round: 2 ** HALVINGS - 1 pivots for each open range.
HALVINGS = 3
#: A range with no more values than this is sorted.
FINISH = 256
#: Targets (group and percentile) whose ranges are held at once; more are selected in turns.
TARGETS = 50_000
#: Values that one task sorts at a time when it makes runs.
RUN_ROWS = 2_000_000
#: Shares of a range whose values are proposed: the medians of it, of its halves, of their halves.
_SHARES = np.arange(1, 2**HALVINGS) / 2**HALVINGS


def measurements(traces: DataFrame, value: str = "duration_ms") -> DataFrame:
    """Rows whose value is a measurement: neither null, NaN, infinite nor negative, with a trace_id."""
    v = F.col(value)
    return traces.where(F.col("trace_id").isNotNull() & v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))


def _code() -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), "phase"), F.lit("-")), F.coalesce(F.concat(F.lit("="), "function_name"), F.lit("-")))


def quarter(ts: str = "ts") -> Column:
    """The piece of a row by its time: four a year; rows without time are a piece of their own (0)."""
    return F.coalesce(F.year(ts) * 4 + F.quarter(ts), F.lit(0)).cast("int")


def summarise(traces: DataFrame, value: str = "duration_ms", error: float = 0.0, piece: Column | None = None) -> DataFrame:
    """piece, phase, function_name, n, values (sorted, distinct), counts (null where all are 1): the runs of all pieces of a table.

    Each trace_id counts once over all pieces: in the first one (the least ``piece``) that has it.
    Redelivered rows are equal; should they differ, the greatest value and the smallest group code stand.
    The shuffle carries 28 bytes a row, combined before it, so an id redelivered any number of times is
    one row. The groups' names are joined to the runs afterwards.
    """
    rows = measurements(traces, value)
    at = (F.lit(0) if piece is None else piece).cast("int")
    once = rows.groupBy("trace_id").agg(F.min(_code()).alias("code"), F.max(F.col(value).cast("double")).alias("v"), F.min(at).alias("piece")).select("code", "v", "piece")
    step = 2 * np.log1p(error)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            code, v, piece = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            if step:
                on = v > 0
                v[on] = np.exp(np.round(np.log(v[on]) / step) * step)
            order = np.lexsort((v, code, piece))
            code, v, piece = code[order], v[order], piece[order]
            other = np.r_[True, (code[1:] != code[:-1]) | (piece[1:] != piece[:-1])]
            at = np.flatnonzero(other | np.r_[True, v[1:] != v[:-1]])
            counts = np.diff(np.r_[at, len(v)])
            cuts = np.flatnonzero(other[at])
            ends = np.r_[cuts[1:], len(at)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(at)].astype(np.int32)), pa.array(v[at]))
            heavy = np.add.reduceat(counts > 1, cuts) > 0
            count_lists = [counts[a:b].astype(np.int64) if h else None for a, b, h in zip(cuts, ends, heavy, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(code[at[cuts]]), pa.array(piece[at[cuts]]), pa.array(np.add.reduceat(counts, cuts)), lists, pa.array(count_lists, pa.list_(pa.int64()))],
                names=["code", "piece", "n", "values", "counts"],
            )

        for b in batches:
            held.append((b.column(0).to_numpy(), np.array(b.column(1).to_numpy(zero_copy_only=False)), b.column(2).to_numpy()))
            size += b.num_rows
            if size >= RUN_ROWS:
                yield flush()
                size = 0
        if size:
            yield flush()

    names = rows.select("phase", "function_name", _code().alias("code")).groupBy("code").agg(F.min("phase").alias("phase"), F.min("function_name").alias("function_name"))
    out = once.mapInArrow(runs, "code long, piece int, n long, values array<double>, counts array<long>")
    return lookup(out, stored(names, "names"), ["code"], "inner").select("piece", "phase", "function_name", "n", "values", "counts")


Sorted = tuple[np.ndarray, np.ndarray]


def _merged(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> Sorted:
    """Sorted values and, before each and at the end, how many stand there."""
    v = np.concatenate([x[0] for x in parts])
    if all(x[1] is None for x in parts):
        v.sort()
        return v, np.arange(len(v) + 1)
    c = np.concatenate([np.ones(len(x[0]), np.int64) if x[1] is None else x[1] for x in parts])
    order = np.argsort(v, kind="stable")
    return v[order], np.r_[0, np.cumsum(c[order])]


@dataclass(frozen=True)
class _Open:
    """Ranges by number: of which source's rows they take the values between ``low`` and ``high``, both excluded, and which numbers each source has."""

    low: np.ndarray
    high: np.ndarray
    of: dict[object, list[int]]

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Range, sorted values, counts before each: what this task holds of each range. Sources are the runs' names, or the numbers of former ranges."""
        held: dict[object, list] = {}
        for b in batches:
            fields = b.schema.names
            keys = [[(k, x) for x in b.column(fields.index(k)).to_pylist()] for k in ("phase", "function_name")] if "phase" in fields else [b.column(fields.index("r")).to_pylist()]
            values, counts = b.column(fields.index("values")), b.column(fields.index("counts"))
            for i in range(b.num_rows):
                one = None
                for key in keys:
                    if key[i] in self.of:
                        one = one or (values[i].values.to_numpy(), counts[i].values.to_numpy() if counts[i].is_valid else None)
                        held.setdefault(key[i], []).append(one)
        for key in list(held):
            v, upto = _merged(held.pop(key))
            for r in self.of[key]:
                a, b = np.searchsorted(v, self.low[r], "right"), np.searchsorted(v, self.high[r], "left")
                if b > a:
                    yield r, v[a:b], upto[a : b + 1] - upto[a]


def percentiles(runs: DataFrame, ps: list[float], kinds: tuple[str, ...] = ("phase", "function_name"), finish: int = FINISH, max_targets: int = TARGETS, log: list[int] | None = None) -> DataFrame:
    """kind, key, n, p, value: for each group the smallest value at or below which at least p of its n values lie.

    ``runs``: a stored table of runs, or several united. A null phase or function_name is no group.
    Groups are taken in turns of at most ``max_targets`` targets, so what the driver holds and sends
    is bounded however many groups there are. ``log`` gets the number of values that each round keeps.
    """
    spark = runs.sparkSession
    sized = [runs.where(F.col(k).isNotNull()).select(F.lit(k).alias("kind"), F.col(k).alias("key"), "n").groupBy("kind", "key").agg(F.sum("n").alias("n")) for k in kinds]
    groups = sized[0]
    for s in sized[1:]:
        groups = groups.unionByName(s)
    schema = "kind string, key string, n long, p double, value double"
    per_turn = max(1, max_targets // max(1, len(ps)))
    parts: list[DataFrame] = []
    turn: list = []
    for g in groups.toLocalIterator():
        turn.append((g["kind"], g["key"], g["n"]))
        if len(turn) == per_turn:
            parts.append(_select_turn(spark, runs, turn, ps, finish, schema, log))
            turn = []
    if turn:
        parts.append(_select_turn(spark, runs, turn, ps, finish, schema, log))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _select_turn(spark: SparkSession, runs: DataFrame, groups: list[tuple[str, str, int]], ps: list[float], finish: int, schema: str, log: list[int] | None) -> DataFrame:
    """Rounds of proposing, counting and keeping what is left, until each target is found or its range is small."""
    g_of = np.repeat(np.arange(len(groups)), len(ps))
    p_of = np.tile(np.array(ps, float), len(groups))
    n_of = np.array([g[2] for g in groups], np.int64)[g_of]
    rank = np.clip(np.ceil(p_of * n_of).astype(np.int64), 1, n_of)  # wanted rank from 1, within the range
    value = np.full(len(g_of), np.nan)
    r_of = g_of.copy()  # at first the range of a target is its group
    left = np.array([g[2] for g in groups], np.int64)
    ranges = _Open(np.full(len(groups), -np.inf), np.full(len(groups), np.inf), {(k, name): [i] for i, (k, name, _) in enumerate(groups)})
    source, path = runs, None

    while (wide := np.unique([r for r in r_of[np.isnan(value)] if left[r] > finish])).size:
        pivots = _pivots(source, ranges, wide, path is not None)
        counted = _count(source, ranges, pivots)
        low, high, n, of, child = [], [], [], {}, {}
        for t in np.flatnonzero(np.isnan(value)):
            r = int(r_of[t])
            piv, i, start, end = pivots.get(r, np.empty(0)), 0, 0, int(left[r])
            if len(piv):
                below, upto = counted[r]
                i = int(np.searchsorted(upto, rank[t]))  # the first pivot with at least rank values up to it
                if i < len(piv) and below[i] < rank[t]:
                    value[t] = piv[i]
                    continue
                start, end = int(upto[i - 1]) if i else 0, int(below[i]) if i < len(piv) else end
            if (r, i) not in child:
                child[r, i] = len(low)
                low.append(piv[i - 1] if i else ranges.low[r])
                high.append(piv[i] if i < len(piv) else ranges.high[r])
                n.append(end - start)
                for source_key in ((groups[r][0], groups[r][1]),) if path is None else (r,):
                    of.setdefault(source_key, []).append(child[r, i])
            rank[t] -= start
            r_of[t] = child[r, i]
        if not low:
            break
        ranges, left = _Open(np.array(low), np.array(high), of), np.array(n, np.int64)
        last, path = path, new_path(spark, "left")
        source.mapInArrow(_keep(ranges), _LEFT).write.parquet(path)
        source = spark.read.schema(_LEFT).parquet(path)
        ranges = _Open(ranges.low, ranges.high, {r: [r] for r in range(len(low))})
        if last:
            drop_path(spark, last)
        if log is not None:
            log.append(int(left.sum()))

    found = np.flatnonzero(~np.isnan(value))
    done = spark.createDataFrame([(groups[g_of[t]][0], groups[g_of[t]][1], int(n_of[t]), float(p_of[t]), float(value[t])) for t in found], schema) if found.size else None
    rest = np.flatnonzero(np.isnan(value))
    if not rest.size:
        return done
    small = _sort_small(source if path else source.mapInArrow(_keep(ranges), _LEFT))
    meta = spark.createDataFrame([(int(r_of[t]), groups[g_of[t]][0], groups[g_of[t]][1], int(n_of[t]), float(p_of[t]), int(rank[t])) for t in rest], "r int, kind string, key string, n long, p double, wanted long")
    ranked = small.join(F.broadcast(meta), "r").select("kind", "key", "n", "p", F.expr("filter(vs, x -> x.upto >= wanted)[0].v").alias("value"))  # meta: TARGETS rows at most
    return ranked.unionByName(done) if done is not None else ranked


_LEFT = "r int, n long, proposed array<double>, values array<double>, counts array<long>"


def _proposals(v: np.ndarray, upto: np.ndarray) -> np.ndarray:
    return v[np.searchsorted(upto, np.ceil(upto[-1] * _SHARES), "left") - 1]


def _keep(ranges: _Open):  # noqa: ANN202  a function for mapInArrow
    """What a task holds of each range, with what it proposes for the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, v, upto in ranges.parts(batches):
            counts = None if upto[-1] == len(v) else np.diff(upto)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r], pa.int32()), pa.array([upto[-1]], pa.int64()), pa.array([_proposals(v, upto)], pa.list_(pa.float64())), pa.array([v], pa.list_(pa.float64())), pa.array([counts], pa.list_(pa.int64()))],
                names=["r", "n", "proposed", "values", "counts"],
            )

    return run


def _pivots(source: DataFrame, ranges: _Open, wide: np.ndarray, kept: bool) -> dict[int, np.ndarray]:
    """For each wide range the sorted weighted medians of what partitions propose; kept slices have their proposals beside them."""
    if kept:
        rows = source.select("r", "n", F.posexplode("proposed").alias("j", "v"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r, v, upto in ranges.parts(batches):
                k = len(_SHARES)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, r, np.int32)), pa.array(np.full(k, upto[-1])), pa.array(np.arange(k, dtype=np.int32)), pa.array(_proposals(v, upto))], names=["r", "n", "j", "v"])

        rows = source.mapInArrow(run, "r int, n long, j int, v double")
    # a median between two values is a pivot too: it lies within the range and parts it
    medians = rows.groupBy("r", "j").agg(F.expr("percentile(v, 0.5d, n)").alias("m"))
    open_, out = set(wide.tolist()), {}
    for x in medians.collect():  # at most 2 ** HALVINGS - 1 a range, and TARGETS of those
        if x["r"] in open_:
            out.setdefault(x["r"], set()).add(x["m"])
    return {r: np.array(sorted(m)) for r, m in out.items()}


def _count(source: DataFrame, ranges: _Open, pivots: dict[int, np.ndarray]) -> dict[int, Sorted]:
    """For each range, by pivot: how many of its values lie below it, and how many up to it."""
    only = _Open(ranges.low, ranges.high, {k: rs for k, rs in ranges.of.items() if any(r in pivots for r in rs)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, v, upto in only.parts(batches):
            if r in pivots:
                piv = pivots[r]
                cols = [np.full(len(piv), r), np.arange(len(piv)), upto[np.searchsorted(v, piv, "left")], upto[np.searchsorted(v, piv, "right")]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["r", "j", "below", "upto"])

    sums = source.mapInArrow(run, "r long, j long, below long, upto long").groupBy("r", "j").agg(F.sum("below").alias("below"), F.sum("upto").alias("upto"))
    out = {r: (np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)) for r, p in pivots.items()}
    for x in sums.collect():
        out[x["r"]][0][x["j"]], out[x["r"]][1][x["j"]] = x["below"], x["upto"]
    return out


def _sort_small(left: DataFrame) -> DataFrame:
    """r and vs: the few values left of each range in order, each with how many lie up to it."""
    each = left.select("r", F.explode(F.arrays_zip("values", F.coalesce("counts", F.transform("values", lambda _: F.lit(1).cast("long"))).alias("counts"))).alias("x"))
    rows = each.groupBy("r", F.col("x.values").alias("v")).agg(F.sum("x.counts").alias("c"))
    listed = rows.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("l"))
    zero = F.array().cast("array<struct<v:double,upto:bigint>>")
    add = F.aggregate("l", zero, lambda a, x: F.concat(a, F.array(F.struct(x["v"].alias("v"), (F.coalesce(F.try_element_at(a, F.lit(-1))["upto"], F.lit(0)) + x["c"]).cast("long").alias("upto")))))
    return listed.select("r", add.alias("vs"))


def trace_percentiles(traces: DataFrame, ps: list[float], error: float = 0.0, piece: Column | None = None) -> DataFrame:
    """Percentiles of a table of traces by phase and by function_name; the runs of its pieces are stored once."""
    return percentiles(stored(summarise(traces, error=error, piece=piece), "runs"), ps)
