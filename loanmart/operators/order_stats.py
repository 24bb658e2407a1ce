"""Exact order statistics and quantiles without gathering a column anywhere.

The built-in ``percentile`` keeps every distinct value of a group in one task,
which a continuous column of a large table does not survive.  Here each wanted
rank is narrowed down until a value hits it, all columns and ranks in the same two
jobs per round:

1. one bounded sketch (``percentile_approx``) per column and open interval proposes
   values at and around the ranks, and the least and greatest value of the interval,
2. one exact count per column of rows between and at the proposals says which rank
   is hit (ties of any size are settled here) and which interval holds the others.

A round shrinks an interval by about accuracy / 4 and always ends at least its two
outermost values, so two or three rounds cover 10^12 rows; where the sketch is exact,
one does.  Results never depend on the sketch being right.  The path is the same for
any number of rows, and only parameters reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

SKETCH_ACCURACY = 5_000


@dataclass
class _Interval:
    """Open interval (low, high) of one target; ``first`` values lie at or below low."""

    name: str
    low: object
    high: object
    first: int
    size: int
    ranks: list[int]


def order_statistics(
    df: DataFrame,
    targets: dict[str, tuple[Column, Iterable[int]]],
    sizes: dict[str, int],
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, dict[int, object]]:
    """Values at 0-based ranks of each target's values in ascending order; NULL and NaN are no values.

    ``targets`` maps a name to (value expression, ranks); ``sizes`` holds the number
    of values of each.
    """
    found: dict[str, dict[int, object]] = {name: {} for name in targets}
    wanted = {name: sorted(set(ranks)) for name, (_, ranks) in targets.items() if sizes[name]}
    kinds = df.select(*[targets[name][0].alias(name) for name in wanted]).schema if wanted else []
    # integers and doubles can't share a column without losing digits
    for whole in (True, False):
        names = [f.name for f in kinds if isinstance(f.dataType, T.IntegralType) == whole and wanted[f.name]]
        values = {}
        for name in names:
            c = targets[name][0].cast("long" if whole else "double")
            values[name] = c if whole else F.when(~F.isnan(c), c)
        pending = [_Interval(name, None, None, 0, sizes[name], wanted[name]) for name in names]
        while pending:
            proposals = _propose(df, values, pending, accuracy, whole)
            marks = _count(df, values, proposals, whole)
            pending = _settle(pending, marks, found)
    return found


def _propose(df, values, intervals: list[_Interval], accuracy: int, whole: bool) -> dict[str, list]:
    """Sorted proposals of each target that still has open ranks."""
    slack = 2.0 / accuracy
    near: list[list[float]] = []
    for w in intervals:
        at = [(r - w.first + 0.5) / w.size for r in w.ranks]
        near.append(sorted({min(max(p + d, 0.0), 1.0) for p in at for d in (-slack, 0.0, slack)}))
    shares = sorted({p for some in near for p in some})
    place = {p: i for i, p in enumerate(shares)}
    by_name: dict[str, list[int]] = {}
    for i, w in enumerate(intervals):
        by_name.setdefault(w.name, []).append(i)
    kind = "bigint" if whole else "double"
    cells = [x for name, own in by_name.items() for x in (_interval_of(F.col(name), intervals, own, kind), F.col(name))]
    long = df.select(*[values[name].alias(name) for name in by_name]).select(F.stack(F.lit(len(by_name)), *cells).alias("at", "v"))
    rows = long.where("at is not null").groupBy("at").agg(
        F.percentile_approx("v", shares, accuracy).alias("near"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    out: dict[str, set] = {name: set() for name in by_name}
    for r in rows.collect():
        w = intervals[r["at"]]
        out[w.name].update({r["low"], r["high"], *(r["near"][place[p]] for p in near[r["at"]])})
        if isinstance(r["low"], int):
            # the sketch works on doubles, too coarse for wide integers: halving always ends
            out[w.name].add((r["low"] + r["high"]) // 2)
    return {name: sorted(found) for name, found in out.items()}


def _interval_of(v: Column, intervals: list[_Interval], own: list[int], kind: str) -> Column:
    """Number of the interval a value lies in; NULL for values in none."""
    at = F.lit(None).cast("int")
    for i in own:
        inside = v.isNotNull()
        if intervals[i].low is not None:
            inside = inside & (v > F.lit(intervals[i].low).cast(kind))
        if intervals[i].high is not None:
            inside = inside & (v < F.lit(intervals[i].high).cast(kind))
        at = F.when(inside, F.lit(i)).otherwise(at)
    return at


def _count(df, values, proposals: dict[str, list], whole: bool) -> dict[str, list[tuple]]:
    """(proposal, number of values below it, number at or below it) of each target."""
    names = list(proposals)
    marks_of = [np.array(proposals[name], dtype=np.int64 if whole else np.float64) for name in names]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a task: at 2 j + 1 values equal to the j-th proposal, at 2 j those before it."""
        totals = [np.zeros(2 * len(marks) + 1, dtype=np.int64) for marks in marks_of]
        for batch in batches:
            for column, marks, total in zip(batch.columns, marks_of, totals):
                v = column.drop_null().to_numpy(zero_copy_only=False)
                total += np.bincount(np.searchsorted(marks, v, "left") + np.searchsorted(marks, v, "right"), minlength=len(total))
        found = [(k, place, total[place]) for k, total in enumerate(totals) for place in np.flatnonzero(total)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["target", "place", "n"])

    counted = df.select(*[values[name].alias(name) for name in names]).mapInArrow(placed, "target int, place int, n long")
    rows = counted.groupBy("target", "place").agg(F.sum("n").alias("n")).collect()
    counts = {(names[r["target"]], r["place"]): r["n"] for r in rows}
    marks: dict[str, list[tuple]] = {}
    for name, some in proposals.items():
        before, marks[name] = 0, []
        for j, v in enumerate(some):
            before += counts.get((name, 2 * j), 0)
            marks[name].append((v, before, before + counts.get((name, 2 * j + 1), 0)))
            before = marks[name][-1][2]
    return marks


def _settle(intervals: list[_Interval], marks: dict[str, list[tuple]], found) -> list[_Interval]:
    remaining: dict[tuple, _Interval] = {}
    for w in intervals:
        for r in w.ranks:
            hit = [v for v, lt, le in marks[w.name] if lt <= r < le]
            if hit:
                found[w.name][r] = hit[0]
                continue
            low, first = max(
                [(v, le) for v, _, le in marks[w.name] if le <= r], key=lambda m: m[1], default=(w.low, w.first)
            )
            high, end = min(
                [(v, lt) for v, lt, _ in marks[w.name] if lt > r],
                key=lambda m: m[1],
                default=(w.high, w.first + w.size),
            )
            key = (w.name, low, high)
            if key in remaining:
                remaining[key].ranks.append(r)
            else:
                remaining[key] = _Interval(w.name, low, high, first, end - first, [r])
    return list(remaining.values())


ARRAY_VALUES = 512


def array_order_statistics(df: DataFrame, column: str, length: int, ranks: Iterable[int], size: int, few: int = 0) -> list[tuple[bool, dict[int, float]]]:
    """(only these, values at 0-based ranks) of each place of an array column of doubles: :func:`order_statistics` for many ranks.

    ``size`` is the number of rows.  Places of at most ``few`` different values have all of these, in ascending order, and True.
    """
    found: dict[str, dict[int, float]] = {str(k): {} for k in range(length)}
    values = {str(k): F.col(column)[k] for k in range(length)}
    pending = [_Interval(name, None, None, 0, size, sorted(set(ranks))) for name in found]
    rare: dict[str, list[float]] = {}
    first = True
    while pending:
        proposals: dict[str, list[float]] = {}
        for w, (whole, some) in zip(pending, _different(df, column, pending)):
            if first and whole and len(some) <= few:
                rare[w.name] = some
            else:
                proposals.setdefault(w.name, []).extend(some)
        pending, first = [w for w in pending if w.name in proposals], False
        marks = _count(df, {name: values[name] for name in proposals}, {name: sorted(some) for name, some in proposals.items()}, False) if pending else {}
        pending = _settle(pending, marks, found)
    return [(name in rare, dict(enumerate(rare[name])) if name in rare else found[name]) for name in found]


def _thin(values: np.ndarray, most: int = ARRAY_VALUES) -> np.ndarray:
    return values if len(values) <= most else values[np.linspace(0, len(values) - 1, most).astype(np.int64)]


def _different(df: DataFrame, column: str, intervals: list[_Interval]) -> list[tuple[bool, list[float]]]:
    """(all of them, different values inside in ascending order) of every interval: the outermost and some between."""
    by_place: dict[int, list[int]] = {}
    for i, w in enumerate(intervals):
        by_place.setdefault(int(w.name), []).append(i)
    limits = [(w.low, w.high) for w in intervals]
    kind = "at int, whole boolean, some array<double>"

    def table(found: dict[int, tuple[bool, np.ndarray]], build) -> pa.Table | pa.RecordBatch:
        arrays = [pa.array(found, pa.int32()), pa.array([w for w, _ in found.values()], pa.bool_()), pa.array([v for _, v in found.values()], pa.list_(pa.float64()))]
        return build(arrays, names=["at", "whole", "some"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[bool, np.ndarray]] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for k, own in by_place.items():
                v = np.unique(x[:, k])
                for i in own:
                    low, high = limits[i]
                    some = v[0 if low is None else np.searchsorted(v, low, "right") : len(v) if high is None else np.searchsorted(v, high, "left")]
                    if len(some):
                        whole, before = found.get(i, (True, some[:0]))
                        some = np.union1d(before, some)
                        found[i] = (whole and len(some) <= ARRAY_VALUES, _thin(some))
        yield table(found, pa.RecordBatch.from_arrays)

    def merged(part: pa.Table) -> pa.Table:
        some = np.unique(part["some"].combine_chunks().flatten().to_numpy())
        whole = all(part["whole"].to_pylist()) and len(some) <= ARRAY_VALUES
        return table({part["at"][0].as_py(): (whole, _thin(some))}, pa.Table.from_arrays)

    got = df.select(column).mapInArrow(run, kind).groupBy("at").applyInArrow(merged, kind).toArrow()
    found = {at: (whole, some) for at, whole, some in zip(*(got[c].to_pylist() for c in ("at", "whole", "some")))}
    return [found.get(i, (True, [])) for i in range(len(intervals))]


def non_null_counts(df: DataFrame, columns) -> dict[str, int]:
    """Numbers of values; a NaN is none."""
    kinds = dict(df.dtypes)
    value = {c: F.when(~F.isnan(F.col(c)), F.col(c)) if kinds[c] in ("double", "float") else F.col(c) for c in columns}
    return df.agg(*[F.count(v).alias(c) for c, v in value.items()]).first().asDict()


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, Iterable[float]],
    counts: dict[str, int] | None = None,
) -> dict[str, dict[float, float | None]]:
    """Linearly interpolated quantiles of several columns: {column: {p: value}}.

    A column without values has only None.
    """
    counts = counts or non_null_counts(df, wanted)
    positions = {c: {p: p * (counts[c] - 1) for p in ps} for c, ps in wanted.items()}
    targets = {
        c: (
            F.col(c),
            [r for at in positions[c].values() for r in (math.floor(at), math.ceil(at))] if counts[c] else [],
        )
        for c in wanted
    }
    values = order_statistics(df, targets, counts)
    out: dict[str, dict[float, float | None]] = {}
    for c, ps in positions.items():
        out[c] = {}
        for p, at in ps.items():
            if not counts[c]:
                out[c][p] = None
                continue
            low, high = values[c][math.floor(at)], values[c][math.ceil(at)]
            out[c][p] = float(low + (high - low) * (at - math.floor(at)))
    return out


def approx_quantiles(
    df: DataFrame, wanted: dict[str, Iterable[float]], accuracy: int = 10_000
) -> dict[str, dict[float, float | None]]:
    """One-pass bounded sketch; rank error at most 1 / accuracy."""
    wanted = {c: list(ps) for c, ps in wanted.items()}
    row = df.agg(*[F.percentile_approx(c, ps, accuracy).alias(c) for c, ps in wanted.items()]).first()
    return {
        c: {p: None if row[c] is None else float(row[c][i]) for i, p in enumerate(ps)}
        for c, ps in wanted.items()
    }
