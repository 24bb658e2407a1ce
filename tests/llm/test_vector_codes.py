import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from loanmart.llm import vector_codes
from loanmart.llm.common import smallest
from loanmart.llm.vector_codes import Balls, code_report
from pyspark.sql import functions as F

KIND = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("codes", T.StringType()), T.StructField("q", T.StringType()), T.StructField("part", T.StringType()),
])


def plain(rows, entries=256, rounds=4):
    """Lloyd's rounds with Python numbers and every distance."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(q) for _, q, _ in kept), default=0)
    w = max(1, -(-longest // 4))
    kept = [(i, q + [0] * (4 * w - len(q)), lab) for i, q, lab in kept]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[q[p * w : p * w + w] for _, q, _ in start] for p in range(4)]

    def assign():
        out = []
        for _, q, _ in kept:
            best = []
            for p in range(4):
                part = q[p * w : p * w + w]
                best.append(min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[p])))
            out.append(best)
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(4):
            members = {}
            for (_, q, _), best in zip(kept, got):
                members.setdefault(best[p][1], []).append(q[p * w : p * w + w])
            for j, parts in members.items():
                books[p][j] = [sum(c) // len(parts) for c in zip(*parts)]
    got, by_label = assign(), {}
    for (_, _, lab), best in zip(kept, got):
        by_label[lab] = by_label.get(lab, 0) + sum(d for d, _ in best)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), by_label[lab], sha)
                   for (i, _, lab), best in zip(kept, got)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "x", "x") for i, v, lab in rows], KIND)


def found(report):
    return sorted((tuple(r) for r in report.collect()), key=str)


def clustered(n, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (12, dims))
    x = centers[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, dims))
    return x.astype(np.float32)


@pytest.mark.parametrize("entries,spread", [(8, 0.05), (40, 0.3), (256, 0.01)])
def test_equals_all_distances(spark, entries, spread):
    x = clustered(400, 16, entries, spread)
    rows = [(int(i * 7 % 401), v.tolist(), i % 3 if i % 5 else None) for i, v in enumerate(x)]
    assert found(code_report(frame(spark, rows).repartition(5), entries=entries)) == plain(rows, entries)


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    # few values, so that many distances are equal, and a hot group of copies
    rows = [(i, (rng.integers(-2, 3, 8) / 1024).tolist(), int(rng.integers(0, 2))) for i in range(150)]
    rows += [(1000 + i, [0.5] * 8, 1) for i in range(80)]
    rows += [(3, [0.25] * 8, 0), (3, [-0.25] * 8, None), (None, [0.1] * 8, None), (5000, None, 1), (5001, [float("nan")] * 8, 1),
             (5002, [float("inf")] + [0.0] * 7, 1), (5003, [None] + [0.0] * 7, 1), (5004, [], 7), (5005, [0.1] * 3, 7)]
    assert found(code_report(frame(spark, rows), entries=20)) == plain(rows, 20)


def test_few_rows_and_none(spark):
    rows = [(2, [0.1, 0.2, 0.3, 0.4, 0.5], 1), (1, [-0.1, -0.2, -0.3, -0.4, -0.5], None)]
    assert found(code_report(frame(spark, rows))) == plain(rows)
    assert code_report(frame(spark, [])).count() == 0
    assert code_report(frame(spark, [(1, None, 1)])).count() == 0
    assert found(code_report(frame(spark, [(1, [], 1)])))[0][1:3] == ("00000000", 0)


def test_large_components_are_limited(spark):
    rows = [(1, [1e30, -1e30, 1.0, 2.0], 1), (2, [16384.0, -16384.0, 1.0, 2.0], 1), (3, [100.0, 5000.0, -3.0, 0.0], 2)]
    a, b, c = found(code_report(frame(spark, rows), entries=3))
    assert a[2] == b[2] == 0 and a[1] == b[1] != c[1]
    wide = [(i, [float(v) for v in np.random.default_rng(i).integers(-16000, 16000, 8)], 0) for i in range(60)]
    assert found(code_report(frame(spark, wide), entries=9)) == plain(wide, 9)


def test_rings_and_stable_balls_skip_distances():
    x = np.floor(clustered(3000, 8, 1) * 1024).astype(np.int64)
    books = Balls.of(x[:64])
    code, dist, first = books.nearest(x, np.full(len(x), -1), np.zeros(len(x), dtype=np.int64))
    assert first < len(x) * 64
    again = Balls.of(x[:64], x[:64], np.array([dist[code == j].max(initial=0) for j in range(64)]))
    assert again.stable.all()
    same, unread, taken = again.nearest(x, code, dist)
    assert taken == 0 and (same == code).all() and (unread == dist).all()
    moved = x[:64].copy()
    moved[5] += 3
    some = Balls.of(moved, x[:64], np.array([dist[code == j].max(initial=0) for j in range(64)]))
    assert some.stable.any() and not some.stable[5]
    got, near, taken = some.nearest(x, code, dist)
    every = ((x[:, None, :] - moved[None]) ** 2).sum(axis=2)
    assert (got == every.argmin(axis=1)).all() and (near == every.min(axis=1)).all() and taken < first


def test_smallest_rows(spark):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 37, F.lit(500)).alias("x"), F.col("id").alias("y")).repartition(9)
    got = [(r["x"], r["y"]) for r in smallest(rows, 11, F.col("x"), F.col("y"), fan_in=(4, 2))]
    assert got == sorted((i * 37 % 500, i) for i in range(1000))[:11]
