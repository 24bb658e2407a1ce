"""Shards of near equal bytes by sampled splitters.

Rows are ordered by (hash of the text, hash of the id, a written row number), so copies of
a text lie side by side and still no key holds more than one row.  A size-weighted sample of
keys is drawn, its quantiles cut the order into many small ranges, and ranges found
overfull by an exact sum are sampled and cut again.  Shards are whole runs of this order:
a row's place in it, in bytes, is the sum of the ranges before plus a running sum in its range.

Defined cases: a null text has no bytes (size 1) and the checksum of nothing, 0; a row longer
than a range keeps a range of its own; rows equal in id and text are interchangeable; an empty
table gives no rows; columns of the input named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import stored

RANGES_PER_SHARD = 16
SAMPLE_PER_RANGE = 16
OVERFULL = 2.0


def text_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def _hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def keyed(docs: DataFrame, doc_id: str, text: str, *kept: Column) -> DataFrame:
    """(row, key, size, ...), written once: the row number is fixed from here on."""
    t = F.col(f"`{text}`")
    first, second = F.xxhash64(F.coalesce(t, F.lit(""))), F.xxhash64(F.col(f"`{doc_id}`"), F.lit(1))
    out = docs.select(text_bytes(t).alias("size"), first.alias("a"), second.alias("b"), *kept)
    out = out.withColumn("row", F.monotonically_increasing_id())
    key = F.concat(_hex(F.col("a")), _hex(F.col("b")), _hex(F.col("row")))
    return stored(out.withColumn("key", key).drop("a", "b"), "keys")


def in_range(key: Column, splitters: list[str]) -> Column:
    """Number of splitters at or below the key."""
    at = np.array(splitters, dtype="S48")

    @F.pandas_udf("int")
    def locate(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, keys.to_numpy().astype("S48"), side="right").astype("int32"))

    return locate(key)


def _sample(rows: DataFrame, n: int, seed: int) -> list[str]:
    """Keys of n rows, drawn without replacement with chances in proportion to size."""
    u = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = rows.select("key", (-F.log(u) / F.col("size")).alias("late")).orderBy("late", "key").limit(n)
    return sorted(r["key"] for r in drawn.collect())


def _quantiles(sample: list[str], pieces: int) -> list[str]:
    return sorted({sample[i * len(sample) // pieces] for i in range(1, pieces)}) if sample else []


def splitters(rows: DataFrame, ranges: int) -> tuple[list[str], DataFrame]:
    """Boundaries of about ``ranges`` ranges, and (range, bytes, before) of each."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    found = _quantiles(_sample(rows, ranges * SAMPLE_PER_RANGE, 0), ranges)
    seed = 0
    while True:
        seed += 1
        sums = rows.groupBy(in_range(F.col("key"), found).alias("range")).agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("longest")
        )
        sums = stored(sums, "ranges")
        # a row that fills a range by itself can't be cut further
        limit = OVERFULL * total / max(ranges, 1)
        over = sums.where((F.col("bytes") > limit + F.col("longest")) & (F.col("n") > 1)).collect()
        if not over:
            before = F.sum("bytes").over(
                Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
            )
            return found, stored(sums.withColumn("before", F.coalesce(before, F.lit(0))), "ranges")
        pieces = {r["range"]: math.ceil(r["bytes"] * ranges / total) for r in over}
        inside = rows.where(in_range(F.col("key"), found).isin(*pieces))
        drawn = _sample(inside, SAMPLE_PER_RANGE * sum(pieces.values()), seed)
        at = np.searchsorted(np.array(found, dtype="S48"), np.array(drawn, dtype="S48"), side="right")
        more = set(found)
        for r, n in pieces.items():
            own = [k for k, i in zip(drawn, at) if i == r]
            more.update(_quantiles(own, min(n, len(own))) if len(own) > 1 else own)
        found = sorted(more)


def placed(rows: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to keyed rows."""
    found, sums = splitters(rows, shards * RANGES_PER_SHARD)
    total = rows.agg(F.sum("size")).first()[0] or 1
    ranged = rows.withColumn("range", in_range(F.col("key"), found))
    ordered = Window.partitionBy("range").orderBy("key")
    within = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    ranged = ranged.withColumn("within", F.coalesce(within, F.lit(0)))
    ranged = ranged.join(sums.select("range", "before"), "range")
    middle = (F.col("before") + F.col("within")).cast("decimal(38,0)") * 2 + F.col("size")
    shard = F.floor(middle * shards / (2 * F.lit(total).cast("decimal(20,0)"))).cast("int")
    ranged = ranged.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    own = Window.partitionBy("range", "shard").orderBy("key")
    ranged = stored(
        ranged.withColumn("at", F.row_number().over(own)).drop("key", "before", "within"), "placed"
    )
    counts = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(
        counts.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier")),
        "offsets",
    )
    slot = (F.col("earlier") + F.col("at") - 1).cast("long")
    return ranged.join(counts, ["shard", "range"]).withColumn("slot", slot).drop("range", "at", "earlier")


def shard_report(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Size, checksum, shard and slot of every row, without its text."""
    rows = keyed(docs, doc_id, text, F.col(f"`{doc_id}`").alias("doc_id"), text_crc32(F.col(f"`{text}`")).alias("text_crc32"))
    return placed(rows, shards)


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with all their columns, and the shard and slot each goes to."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    packed = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc")
    rows = keyed(docs, doc_id, text, packed)
    at = placed(rows.select("row", "key", "size"), shards).select("row", "shard", "slot")
    return rows.join(at, "row").select("doc.*", "shard", "slot")
