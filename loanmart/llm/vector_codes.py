"""Compressed vector codes: every part of a vector is replaced by the nearest entry of its codebook.

Components are integers, so distances, ties and means are exact.  Codebooks are improved by ball k-means.  An
entry and the parts it is nearest to are a ball.  A ball's radius (the farthest of its parts, plus
what the entry moved) says which entries can take parts from it: those at most twice the radius away, its neighbours.  A
ball that did not move, with neighbours that did not move, is stable: its parts keep entry and
distance unread.  Elsewhere a part is measured to its own entry first.  If that is less than half the distance to the next
entry, the part lies in the core and stays.  Else it lies in a ring: only entries at most twice its distance
from the own one can be nearer, and only these are compared.

Rows are quantised and written once; a round reads and writes rows with their codes, tasks add up sums by entry, Spark merges
them.  The driver sees codebooks only, entries x length numbers whatever the number of rows.

Defined cases: vectors that are null or hold null or non-finite components are left out; components beyond ``LIMIT`` (2 ** 24 after
scaling) count as the limit; vectors shorter than the longest, and lengths that parts don't divide, are filled up with zeros;
rows of one id are rows of their own, and start a codebook in order of their components; a null id is larger than
all others; fewer rows than entries make a smaller codebook; null labels are one label; an empty
table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import stored
from .common import smallest

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 24
CHUNK = 512  # parts of a ball that are compared at a time, in the order of their rings
PIVOTS = 16  # entries a part without a ball is measured to first


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vector: Column, length: int) -> Column:
    """Scaled and floored components, filled up with zeros."""
    limit = F.lit(float(LIMIT))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE).cast("double"), limit), -limit).cast("int"))
    return F.concat(whole, F.array_repeat(F.lit(0), F.lit(length) - F.size(vector)))


@dataclass
class Balls:
    """The codebook of one part position, with what a round may skip."""

    entries: np.ndarray  # (entries, width) whole numbers
    order: np.ndarray  # other entries by distance from each
    apart: np.ndarray  # those squared distances, ascending
    stable: np.ndarray  # neither it nor a neighbour moved

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None, far: np.ndarray | None = None) -> Balls:
        """``far`` are the squared radii around the entries ``before``."""
        wide = entries.astype(object) if _too_wide(entries, entries) else entries
        between = ((wide[:, None, :] - wide[None, :, :]) ** 2).sum(axis=2).astype(np.int64)
        order = np.argsort(between, axis=1, kind="stable")
        stable = np.zeros(len(entries), dtype=bool)
        if before is not None:
            shift = ((entries - before) ** 2).sum(axis=1)
            moved = shift > 0
            # a radius around the new entry, rounded up
            reach = np.array([(_root(f) + _root(s)) ** 2 for f, s in zip(far, shift)], dtype=np.int64)
            neighbour = between <= 4 * reach[:, None]
            stable = ~moved & ~(neighbour & moved[None, :]).any(axis=1)
        return cls(entries, order, np.take_along_axis(between, order, 1), stable)

    def nearest(self, x: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of every part, and how many distances were taken; -1 in ``code`` is no ball yet."""
        code, dist = code.copy(), dist.copy()
        fresh = np.flatnonzero(code < 0)
        taken = 0
        if len(fresh):
            pivots = np.arange(0, len(self.entries), max(1, len(self.entries) // PIVOTS))
            code[fresh] = pivots[_distances(x[fresh], self.entries[pivots]).argmin(axis=1)]
            taken += len(fresh) * len(pivots)
        known = np.zeros(len(x), dtype=bool)
        known[fresh] = True
        live = np.flatnonzero(known | ~self.stable[code])
        dist[live] = ((x[live] - self.entries[code[live]]) ** 2).sum(axis=1)
        taken += len(live)
        by_ball = live[np.argsort(code[live], kind="stable")]
        balls, starts = np.unique(code[by_ball], return_index=True)
        for ball, rows in zip(balls, np.split(by_ball, starts[1:])):
            # an entry more than twice the own distance away is farther than the own one
            ring = np.searchsorted(self.apart[ball], 4 * dist[rows], side="right")
            outside = ring > 1
            rows, ring = rows[outside], ring[outside]
            by_ring = np.argsort(ring, kind="stable")
            rows, ring = rows[by_ring], ring[by_ring]
            for lo in range(0, len(rows), CHUNK):
                part, reach = rows[lo : lo + CHUNK], int(ring[min(lo + CHUNK, len(rows)) - 1])
                candidates = np.sort(self.order[ball, :reach])
                found = _distances(x[part], self.entries[candidates])
                # the first of equal ones has the lowest index
                at = found.argmin(axis=1)
                code[part], dist[part] = candidates[at], found[np.arange(len(part)), at]
                taken += found.size
        return code, dist, taken


def _root(square: int) -> int:
    whole = math.isqrt(int(square))
    return whole if whole * whole == square else whole + 1


def _too_wide(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether a sum of products can pass what a double holds exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    return 4 * x.shape[1] * top * top >= 1 << 53


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if _too_wide(x, c):
        return np.stack([((x - e) ** 2).sum(axis=1) for e in c], axis=1)
    xf, cf = x.astype(np.float64), c.astype(np.float64)
    return ((xf * xf).sum(axis=1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(axis=1)).astype(np.int64)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


_KIND = "vec_id long, label string, q array<int>, codes array<int>, dist array<long>"


def _assigner(balls: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: list[Balls] = balls.value
        width = books[0].entries.shape[1]
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("q"), PARTS * width).astype(np.int64).reshape(len(batch), PARTS, width)
            codes, dist = _matrix(batch.column("codes"), PARTS), _matrix(batch.column("dist"), PARTS)
            found = [book.nearest(x[:, p], codes[:, p], dist[:, p]) for p, book in enumerate(books)]
            codes, dist = (np.stack([f[i] for f in found], axis=1) for i in (0, 1))
            kept = [batch.column(c) for c in ("vec_id", "label", "q")]
            yield pa.RecordBatch.from_arrays([*kept, _rows(codes, pa.int32()), _rows(dist, pa.int64())], names=["vec_id", "label", "q", "codes", "dist"])

    return run


def _summer(entries: int, width: int):
    """Totals by (part, entry, place); place -1 has the number of parts and the largest distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, entries, width + 1), dtype=np.int64)
        top = np.zeros((PARTS, entries), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("q"), PARTS * width).astype(np.int64).reshape(len(batch), PARTS, width)
            codes, dist = _matrix(batch.column("codes"), PARTS), _matrix(batch.column("dist"), PARTS)
            for p in range(PARTS):
                order = np.argsort(codes[:, p], kind="stable")
                if len(order):
                    own, starts, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                    total[p, own, 1:] += np.add.reduceat(x[order, p], starts, axis=0)
                    total[p, own, 0] += n
                    top[p, own] = np.maximum(top[p, own], np.maximum.reduceat(dist[order, p], starts))
        part, entry, place = np.nonzero(np.broadcast_to(total[:, :, :1] > 0, total.shape))
        largest = np.where(place == 0, top[part, entry], 0)
        columns = [part.astype(np.int32), entry.astype(np.int32), (place - 1).astype(np.int32), total[part, entry, place], largest]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "place", "total", "top"])

    return run


def _updated(rows: DataFrame, books: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Codebooks at the means of their parts, and the squared radii around the old entries."""
    entries, width = books[0].shape
    partial = rows.select("q", "codes", "dist").mapInArrow(_summer(entries, width), "part int, entry int, place int, total long, top long")
    sums = partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.max("top").alias("top")).toArrow()
    part, entry, place, total, top = (sums[c].to_numpy() for c in ("part", "entry", "place", "total", "top"))
    table, far = np.zeros((PARTS, entries, width + 1), dtype=np.int64), np.zeros((PARTS, entries), dtype=np.int64)
    table[part, entry, place + 1] = total
    far[part[place < 0], entry[place < 0]] = top[place < 0]
    n = table[:, :, :1]
    return [np.where(n[p] > 0, table[p, :, 1:] // np.maximum(n[p], 1), books[p]) for p in range(PARTS)], far


def encode(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
           entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, q, codes, dist) of every usable row, and the codebooks by part."""
    spark = vectors.sparkSession
    v = F.col("vector")
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").alias("vector"))
    named = named.where(finite(v))
    longest = named.agg(F.max(F.size(v))).first()[0] or 1
    width = -(-longest // PARTS)
    none = F.array_repeat(F.lit(-1), PARTS).alias("codes"), F.array_repeat(F.lit(0).cast("long"), PARTS).alias("dist")
    rows = stored(named.select("vec_id", "label", quantised(v, PARTS * width).alias("q"), *none), "quantised")
    first = smallest(rows.select("vec_id", "q"), entries, F.col("vec_id").asc_nulls_last(), F.col("q").asc())
    if not first:
        return rows, [np.zeros((0, width), dtype=np.int64)] * PARTS
    start = np.array([r["q"] for r in first], dtype=np.int64).reshape(len(first), PARTS, width)
    books = [start[:, p] for p in range(PARTS)]
    balls = [Balls.of(b) for b in books]
    for done in range(rounds + 1):
        rows = stored(rows.mapInArrow(_assigner(spark.sparkContext.broadcast(balls)), _KIND), "coded")
        if done < rounds:
            before = books
            books, far = _updated(rows, before)
            balls = [Balls.of(b, a, f) for b, a, f in zip(books, before, far)]
    return rows, books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def code_report(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **options) -> DataFrame:
    """Code and error of every usable row, and the error of all rows of its label."""
    rows, books = encode(vectors, vec_id, embedding, label, **options)
    code = F.concat(*[F.lpad(F.lower(F.hex(F.col("codes")[p])), 2, "0") for p in range(PARTS)])
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, b: a + b)
    rows = rows.select("vec_id", code.alias("code"), error.alias("error"), "label")
    # sums have one row a label; a join splits a label that most rows have, a window could not
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
