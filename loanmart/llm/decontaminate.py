"""Benchmark decontamination: which documents contain which test items, in DataFrame functions only.

Texts become sets of hashed five-word shingles.  An item with n shingles counts as contained
if ceil(0.8 n) of them occur in the document, so at most n - ceil(0.8 n) may be missing:
of its n - ceil(0.8 n) + 1 smallest hashes (its MinHash sketch, whose length follows the
item's size) at least one must occur.  Items are partitioned by size; in a partition of
small items sketches reach further up the hash range, and a document shingle is looked up only
if it lies below the highest cut.  Candidates, a small share of all documents, are then verified by
exact shingle containment.  No document is missed, however long it is.

Words are runs of letters and digits, compared in lower case.  Defined cases: a null or empty
text, or one without words, holds nothing and is held nowhere; a text of fewer than five words is
one shingle of all its words, so such an item is found only in a text of just these words; items
with equal texts are all reported; repeated documents are reported once per (id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import stored

SHINGLE = 5
CONTAINMENT = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """One hash per shingle, in text order, repeats included."""
    held = words(text)

    def hashed(w: Column) -> Column:
        n = F.size(w)
        whole = F.array(F.xxhash64(w))
        rolled = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(n >= width, rolled).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    # the words are made once and bound, not once per shingle
    return F.get(F.transform(F.array(held), hashed), F.lit(0))


def item_shingles(benchmark: DataFrame, item_id: str, text: str, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, hashes, n, needed, sketch) of every item that has words."""
    hashes = F.array_sort(F.array_distinct(shingle_hashes(F.col(f"`{text}`"))))
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), hashes.alias("hashes"))
    items = items.withColumn("n", F.size("hashes")).where("n > 0")
    items = items.withColumn("needed", F.ceil(F.lit(containment) * F.col("n")).cast("int"))
    return items.withColumn("sketch", F.slice("hashes", 1, F.col("n") - F.col("needed") + 1))


def contained_items(
    docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, text_hash, item_id, shared, n_shingles, containment) of all pairs that reach the containment."""
    items = stored(item_shingles(benchmark, item_id, item_text, containment), "items")
    # partitions of about equal item size: the cut of each is the highest hash of its sketches
    sized = items.withColumn("part", F.floor(F.log2("n")).cast("int"))
    cuts = sized.groupBy("part").agg(F.max(F.element_at("sketch", -1)).alias("cut"))
    cut = cuts.agg(F.max("cut")).first()[0]
    index = stored(items.select(F.explode("sketch").alias("hash"), "item_id"), "index")
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    named = named.withColumn("text_hash", F.xxhash64("text"))
    limit = F.lit(cut if cut is not None else -(1 << 63))
    low = F.filter(shingle_hashes(F.col("text")), lambda h: h <= limit)
    probes = named.select("doc_id", "text_hash", F.explode(low).alias("hash"))
    candidates = stored(probes.join(index, "hash").select("doc_id", "text_hash", "item_id").distinct(), "candidates")
    c, d = candidates.alias("c"), named.alias("d")
    keys = candidates.select("doc_id", "text_hash").distinct().alias("k")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    found = d.join(keys, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    found = stored(found.select("doc_id", "text_hash", F.array_distinct(shingle_hashes(F.col("text"))).alias("held")), "found")
    f = found.alias("f")
    same = F.col("c.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("c.text_hash") == F.col("f.text_hash"))
    pairs = c.join(f, same).select("c.*", "held").join(items.select("item_id", "hashes", "n", "needed"), "item_id")
    shared = F.size(F.array_intersect("held", "hashes"))
    return (
        pairs.select("doc_id", "text_hash", "item_id", shared.cast("long").alias("shared"), "n", "needed")
        .where("shared >= needed")
        .select(
            "doc_id", "text_hash", "item_id", "shared", F.col("n").cast("long").alias("n_shingles"),
            (F.col("shared") / F.col("n")).alias("containment"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", **options) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    leaks = stored(contained_items(docs, benchmark, doc_id, text, **options), "leaks").alias("l")
    d = docs.alias("d")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("l.doc_id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("l.text_hash"))
    return d.join(leaks, same, "left_anti")
