"""Mixing sources to target weights, with exact budgets and epochs.

Every row gets a hash-random key, which orders the rows of its source.  A source's order
is cut into ranges of equal key width (keys are uniform, so ranges hold about equally
many rows, and a source with a third of all rows just has more of them in use).  Sums
per range and their running sum say in which range the budget ends; only that range's
rows are sorted and summed one by one.  What comes out is a table of one cut per
source, and taking rows is a projection against it: no text is shuffled.

Defined cases: a null source is a source of its own, after all others; null and empty
texts have size 0 and are never the ones cut; rows that agree in id and text share their
key, and where the budget ends among them they share what is left evenly; an empty
table gives an empty mix; further columns, whatever their names, pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import stored
from .common import with_rank

ROWS_PER_RANGE = 20_000
MAX_RANGE_BITS = 24
SEED = 42


def mix_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Uniform over 128 bits, the same on every engine and run."""
    whole = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed)), text)
    return F.md5(whole.cast("binary"))


def _range_of(key: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(key, 1, 6), 16, 10).cast("int"), MAX_RANGE_BITS - bits)


def targets(sizes: DataFrame, weights: tuple[int, ...], total: int, max_epochs: int) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size).

    Weights go round in the order of the sources.  Each round takes the sources whose share
    exceeds ``max_epochs`` times their size out at that size and deals the rest anew; a
    round is one aggregate of three numbers.
    """
    ranked = with_rank(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
    )
    ranked = stored(ranked.withColumn("weight", weight).drop("rank"), "sources")
    most = F.col("source_size") * max_epochs
    capped = F.lit(False)
    taken_out = -1
    while True:
        n, size, free = ranked.agg(
            F.count_if(capped), F.sum(F.when(capped, most)), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        if not free:
            return ranked.withColumn("target", most.cast("double"))
        share = F.col("weight") * F.lit(float(total - (size or 0)) / float(free))
        if n == taken_out:
            return ranked.withColumn("target", F.when(capped, most.cast("double")).otherwise(share))
        taken_out, capped = n, capped | (share > most)


def cuts(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: target, whole epochs, and where the last, partial one ends.

    ``rows`` holds (source, key, size) and should be a stored table.  Rows with a key below
    ``cut_key`` are taken once more, rows at it give ``cut_words`` words each.
    """
    n = rows.count()
    bits = min(MAX_RANGE_BITS, max(0, math.ceil(math.log2(max(n, 1) / ROWS_PER_RANGE))))
    ranged = rows.withColumn("range", _range_of(F.col("key"), bits))
    sums = stored(ranged.groupBy("source", "range").agg(F.sum("size").alias("words")), "range_sums")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    total = sums.agg(F.sum("words")).first()[0] or 0
    budget = targets(sizes, weights, total, max_epochs)
    size = F.col("source_size")
    epochs = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(max_epochs))).otherwise(0)
    budget = budget.withColumn("epochs", epochs.cast("long"))
    budget = stored(
        budget.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * size).cast("long")), "budgets"
    )
    by_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(by_source), F.lit(0)))
    b, s, r = budget.alias("b"), before.alias("s"), ranged.alias("r")
    ends = (
        b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")))
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        .select("b.source", "range", (F.col("rest") - F.col("before")).alias("left"))
    )
    ends = stored(ends, "ends").alias("e")
    near = (
        r.join(ends, F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.range") == F.col("e.range")))
        .groupBy(F.col("r.source").alias("source"), "key", "left")
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("each"))
    )
    ordered = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum("words").over(ordered), F.lit(0)))
    last = near.where(
        (F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))
    ).select(
        "source",
        F.col("key").alias("cut_key"),
        F.expr("(left - before) div copies").alias("cut_words"),
    )
    last = last.alias("l")
    return stored(
        b.join(last, F.col("b.source").eqNullSafe(F.col("l.source")), "left").select(
            "b.*", "cut_key", F.coalesce("cut_words", F.lit(0)).alias("cut_words")
        ),
        "cuts",
    )


def taken_words(size: Column, key: Column, cut: str = "cut") -> Column:
    at = F.col(f"{cut}.cut_key")
    more = F.when(key < at, size).when(key == at, F.col(f"{cut}.cut_words")).otherwise(0)
    return F.col(f"{cut}.epochs") * size + more


def measured(docs: DataFrame, size: Column, doc_id: str, text: str, source: str) -> DataFrame:
    """The narrow rows the plan is made from: (doc_id, source, key, size), written once."""
    return stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            mix_key(F.col(doc_id), F.col(text)).alias("key"),
            size.cast("long").alias("size"),
        ),
        "sizes",
    )


def mix_report(docs: DataFrame, size: Column, doc_id="doc_id", text="text", source="source", **options) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes from it."""
    rows = measured(docs, size, doc_id, text, source)
    cut = cuts(rows, **options).alias("cut")
    r = rows.alias("r")
    return r.join(cut, F.col("r.source").eqNullSafe(F.col("cut.source"))).select(
        "r.doc_id",
        "r.size",
        "cut.source_size",
        "cut.target",
        taken_words(F.col("r.size"), F.col("r.key")).cast("long").alias("taken"),
        F.col("r.source").alias("source"),
    )


def mix(docs: DataFrame, size: Column, doc_id="doc_id", text="text", source="source", **options) -> DataFrame:
    """The mixed rows: every document once per epoch it is taken in, with all its columns.

    Texts stay whole: the document at the cut counts as taken if at least half of it is.
    Documents without words carry nothing and stay once.
    """
    cut = cuts(measured(docs, size, doc_id, text, source), **options).alias("cut")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(f"`{source}`").alias("from"),
        mix_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("key"),
        size.cast("long").alias("words"),
    )
    words = F.col("words")
    copies = F.when(words > 0, F.round(taken_words(words, F.col("key")) / words)).otherwise(1).cast("int")
    spread = packed.join(cut, F.col("from").eqNullSafe(F.col("cut.source"))).select("doc", copies.alias("copies"))
    spread = spread.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"))
    return spread.select("doc.*")
