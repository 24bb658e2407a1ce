"""As-of joins: to every row the latest row of another table that is not after it.

For tables of any size.  (A history of a few rows is better carried as a literal, see ``registry.active_deployment``.)

The left side takes part with its distinct (keys, time) only, the right side with one row of each.  Both are put in
one sequence, dealt by ranges of (keys, time): a hot key covers many ranges, and no two points are equal, so no range is
overfull.  Inside a range the last row is carried on by a window; over the borders of ranges goes the last row of every
key in each range, a table of at most (keys + ranges) rows.  The result comes back to the left rows by an equi-join.

Rows of the left side without a match, or with NULL in a key or the time, get NULLs.  Right rows with NULL there match
nothing.  Of right rows with equal keys and time the greatest wins, by the columns in their order (NULL is least).  Copies
on the left stay copies.  Columns of the right side must have an order (no maps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import stored


def asof_join(left: DataFrame, right: DataFrame, time: tuple[str, str], by=()) -> DataFrame:
    """``left`` with the columns of ``right`` (its time column too, without ``by``) of the latest row not after it.

    ``time`` names the time columns of both sides; ``by`` the key columns, named alike on both.
    """
    by, (left_time, right_time) = list(by), time
    values = [c for c in right.columns if c not in by]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    kept = {c: f"_k{i}" for i, c in enumerate(by)}  # inner names clash with no column
    keys = list(kept.values())

    def points(df: DataFrame, at: str, *more) -> DataFrame:
        present = F.col(f"`{at}`").isNotNull()
        for c in by:
            present = present & F.col(f"`{c}`").isNotNull()
        return df.where(present).select(*[F.col(f"`{c}`").alias(k) for c, k in kept.items()], F.col(f"`{at}`").alias("_at"), *more)

    row = F.struct(*[F.col(f"`{c}`") for c in (right_time, *[c for c in values if c != right_time])])
    known = points(right, right_time, row.alias("_row")).groupBy(*keys, "_at").agg(F.max("_row").alias("_row"))
    asked = points(left, left_time).distinct()
    # a right row at the very time of a left one comes before it
    both = asked.withColumns({"_row": F.lit(None).cast(known.schema["_row"].dataType), "_asks": F.lit(1)}).unionByName(known.withColumn("_asks", F.lit(0)))
    ranges = stored(both.repartitionByRange(*keys, "_at", "_asks").withColumn("_range", F.spark_partition_id()), "asof")
    inside = Window.partitionBy("_range", *keys).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranges.groupBy("_range", *keys).agg(F.max("_row").alias("_end"))
    carried = ends.select("_range", *keys, F.last("_end", ignorenulls=True).over(earlier).alias("_end")).where("_end is not null")
    here = ranges.withColumn("_row", F.last("_row", ignorenulls=True).over(inside)).where("_asks = 1")
    found = here.join(carried, ["_range", *keys], "left").select(*keys, "_at", F.coalesce("_row", "_end").alias("_row")).where("_row is not null")
    joined = left.join(found, [F.col(f"`{left_time}`") == F.col("_at"), *[left[f"`{c}`"] == F.col(k) for c, k in kept.items()]], "left")
    return joined.select(*[left[f"`{c}`"] for c in left.columns], *[F.col("_row")[c].alias(c) for c in values])
