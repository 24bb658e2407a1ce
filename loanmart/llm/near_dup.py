"""Near-duplicates by DartMinHash signatures, banded joins and exact verification.

Signatures.  Every element of a text (a five-word shingle, with weight 1 or its count) owns a
region of width weight.  Darts fall on the region at hashed places, ranks and coordinates, one per unit
of area; the darts a text gets are those on its own regions up to a rank at which all coordinates
are likely hit (a text with a coordinate left throws on to twice the rank).  The earliest dart per
coordinate is the signature, and two texts agree on a coordinate with the chance of their
weighted Jaccard similarity.  A text of n elements costs O(n + t log t).

Join.  Texts equal word by word collapse to classes first.  Classes that agree on a band meet: each
member of a bucket is verified against the bucket's smallest member.  Where a bucket still spans several
components, it gets further leaders for some rounds, first those with most links, and in the end the members outside its main
component are compared with all members of other components inside a join that gives out links only.  Pairs already connected
need no look.  Verification compares whole shingle sets.  So no link between
components is lost, and no group is gathered or expanded into all its pairs.

Defined cases: null texts and texts without words link with nothing; a text of fewer than five
words is one shingle; repeated rows are copies like any other; a null id is larger than all ids; an
empty table gives no rows; further columns pass through ``deduplicate`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import stored
from .graph import components
from .words import Hasher, doc_words, mix64, shingles

SIMILARITY = 0.8
ROWS, BANDS = 5, 22
# estimates from a signature are off by 0.04; this far below the threshold none is missed
ESTIMATE_SLACK = 0.17
WIDTH = 5
_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
PAIRS = 1 << 20  # darts in memory at a time
ROUNDS = 2  # of one more leader per bucket, before all pairs that are left


def _salt(k: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)


def _darts(elements: np.ndarray, cells: np.ndarray, covered: np.ndarray | None):
    """Darts on unit cells of (element, rank): (index of the element, hash, cell).

    Whole regions get one dart per cell: all elements then throw alike, and each is earliest with the
    same chance.  Where ``covered`` says that regions are covered in part, numbers are Poisson, and darts
    that miss the covered part are dropped.
    """
    at = np.repeat(np.arange(len(elements)), cells)
    cell = (np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)).astype(np.uint64)
    dart = mix64(elements[at] ^ ((cell + np.uint64(1)) * _salt(0)))
    if covered is not None:
        n = np.searchsorted(_POISSON, (dart >> np.uint64(11)).astype(np.float64) / (1 << 53), side="right")
        again = np.repeat(np.arange(len(at)), n)
        turn = (np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        at, cell, dart = at[again], cell[again], mix64(dart[again] + (turn + np.uint64(1)) * _salt(1))
        inside = (mix64(dart + _salt(7)) >> np.uint64(11)).astype(np.float64) / (1 << 53) < covered[at]
        at, cell, dart = at[inside], cell[inside], dart[inside]
    return at, dart, cell


def signatures(elements: np.ndarray, owner: np.ndarray, rows: int, t: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(rows, t) signature of 32-bit numbers; elements of a row may repeat, rows without elements are zero.

    ``weights`` are positive reals; without them all are 1.
    """
    covered = None
    if weights is not None:
        # a region wider than one falls into units of width one; the last may be covered in part
        units = np.ceil(weights).astype(np.int64)
        at = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
        elements = mix64(np.repeat(elements, units) + at.astype(np.uint64) * _salt(3))
        owner, covered = np.repeat(owner, units), np.repeat(weights, units) - at
        if (covered >= 1).all():
            covered = None
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = np.full(rows * t, none, dtype=np.uint64)
    total = np.bincount(owner, covered, minlength=rows)
    up_to = np.where(total > 0, t * (np.log(t) + 3) / np.maximum(total, 1e-9), 0)
    todo = np.arange(rows)
    while len(todo):
        if len(todo) < rows:
            use = np.isin(owner, todo)
            some, of, part = elements[use], owner[use], None if covered is None else covered[use]
        else:
            some, of, part = elements, owner, covered
        cells = np.ceil(up_to)[of].astype(np.int64)
        ends = np.cumsum(cells)
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            here = slice(lo, hi)
            at, dart, cell = _darts(some[here], cells[here], None if part is None else part[here])
            # rank: the cell, then the dart's upper bits; a text that needs no whole cell stops within it
            time = (cell << np.uint64(48)) | (dart >> np.uint64(16))
            row = of[here][at]
            early = time < (up_to * 2.0**48).astype(np.uint64)[row]
            row, time, dart = row[early], time[early], dart[early]
            coordinate = ((dart & np.uint64(0xFFFFFF)) * np.uint64(t)) >> np.uint64(24)
            np.minimum.at(first, row * t + coordinate.astype(np.int64), time)
            lo = hi
        todo = np.flatnonzero((first.reshape(rows, t) == none).any(axis=1) & (total > 0))
        up_to[todo] *= 2
    first[first == none] = np.uint64(0)
    return mix64(first).reshape(rows, t).astype(np.uint32).view(np.int32)


def _per_text(column, hasher) -> Iterator[tuple]:
    """(first row, rows, words, owner): like ``doc_words``, with the parts of a long text put together."""
    held: list = []
    for first, rows, hashes, owner, _ in doc_words(column, hasher):
        if held and held[0][0] != first:
            yield held[0][0], 1, np.concatenate([h for _, h in held]), np.zeros(sum(len(h) for _, h in held), dtype=np.int64)
            held = []
        if rows == 1:
            held.append((first, hashes))
        else:
            yield first, rows, hashes, owner
    if held:
        yield held[0][0], 1, np.concatenate([h for _, h in held]), np.zeros(sum(len(h) for _, h in held), dtype=np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray, kind) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _sketch(weighted: bool, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = batch.column("text")
            content = np.zeros((len(texts), 2), dtype=np.uint64)
            counts = np.zeros(len(texts), dtype=np.int64)
            signed = np.zeros((len(texts), t), dtype=np.int32)
            for first, rows, hashes, owner in _per_text(texts, hasher):
                here = slice(first, first + rows)
                counts[here] = np.bincount(owner, minlength=rows)
                if len(hashes):
                    # the place in the text counts: two sums over (word, position)
                    begin = np.cumsum(counts[here]) - counts[here]
                    place = (np.arange(len(hashes)) - begin[owner]).astype(np.uint64)
                    heads = np.flatnonzero(counts[here])
                    for k in (0, 1):
                        mixed = mix64(hashes + (place + np.uint64(1)) * _salt(20 + k))
                        content[first + heads, k] = np.add.reduceat(mixed, begin[heads])
                elements, of = shingles(hashes, owner, rows, WIDTH)
                weights = None
                if weighted and len(elements):
                    order = np.lexsort((elements, of))
                    elements, of = elements[order], of[order]
                    new = np.flatnonzero(np.r_[True, (elements[1:] != elements[:-1]) | (of[1:] != of[:-1])])
                    weights = np.diff(np.r_[new, len(elements)]).astype(np.float64)
                    elements, of = elements[new], of[new]
                signed[here] = signatures(elements, of, rows, t, weights)
            keep = counts > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(content[:, 0].view(np.int64), mask=~keep),
                    pa.array(content[:, 1].view(np.int64), mask=~keep),
                    _lists(signed[keep].ravel(), np.where(keep, t, 0), pa.int32()),
                ],
                names=["doc_id", "text_hash", "c1", "c2", "signature"],
            )

    return run


def sketches(docs: DataFrame, doc_id="doc_id", text="text", weighted: bool = False, t: int = ROWS * BANDS) -> DataFrame:
    """(uid, doc_id, text_hash, c1, c2, signature) per row, written once; c1, c2 identify the sequence of words."""
    named = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text")
    )
    kind = "doc_id long, text_hash long, c1 long, c2 long, signature array<int>"
    rows = named.mapInArrow(_sketch(weighted, t), kind)
    return stored(rows.withColumn("uid", F.monotonically_increasing_id()), "sketches")


def _sets(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            values, lengths = [], np.zeros(len(batch), dtype=np.int64)
            for first, rows, hashes, owner in _per_text(batch.column("text"), hasher):
                elements, of = shingles(hashes, owner, rows, WIDTH)
                order = np.lexsort((elements, of))
                elements, of = elements[order], of[order]
                if len(elements):
                    new = np.r_[True, (elements[1:] != elements[:-1]) | (of[1:] != of[:-1])]
                    if weighted:
                        # the k-th time an element occurs is an element of its own
                        start = np.flatnonzero(new)
                        turn = np.arange(len(elements)) - np.repeat(start, np.diff(np.r_[start, len(elements)]))
                        elements = mix64(elements + turn.astype(np.uint64) * _salt(5))
                    else:
                        elements, of = elements[new], of[new]
                lengths[first : first + rows] = np.bincount(of, minlength=rows)
                values.append(elements.view(np.int64))
            flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), _lists(flat, lengths, pa.int64())], names=["uid", "held"])

    return run


def _bands(classes: DataFrame, rows: int, bands: int) -> DataFrame:
    keys = F.array(*[F.xxhash64(F.lit(k), F.slice("signature", k * rows + 1, rows)) for k in range(bands)])
    return classes.select("uid", F.explode(keys).alias("band"))


def _estimate(a: Column, b: Column) -> Column:
    """Share of equal coordinates: 1 - hamming distance, in one pass over both arrays."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


class _Verifier:
    """Checks pairs of classes on their whole shingle sets; the sets are made once."""

    def __init__(self, docs: DataFrame, classes: DataFrame, met: DataFrame, doc_id: str, text: str, weighted: bool, similarity: float):
        self.similarity = similarity
        self.signed = classes.select("uid", "signature")
        named = docs.select(
            F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text")
        ).alias("d")
        ends = classes.select("uid", "doc_id", "text_hash").join(met.select("uid").distinct(), "uid", "left_semi").alias("n")
        same = (F.col("d.text_hash") == F.col("n.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("n.doc_id"))
        held = named.join(ends, same).select("uid", "text").mapInArrow(_sets(weighted), "uid long, held array<long>")
        self.held = stored(held, "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those that reach the similarity."""
        near = pairs.join(self.signed.withColumnsRenamed({"uid": "a", "signature": "sa"}), "a")
        near = near.join(self.signed.withColumnsRenamed({"uid": "b", "signature": "sb"}), "b")
        near = near.where(self.close(F.col("sa"), F.col("sb"))).select("a", "b")
        return self.exact(near)

    def close(self, a: Column, b: Column) -> Column:
        return _estimate(a, b) >= self.similarity - ESTIMATE_SLACK

    def exact(self, near: DataFrame) -> DataFrame:
        near = stored(near, "pairs")
        both = near.join(self.held.withColumnsRenamed({"uid": "a", "held": "ha"}), "a")
        both = both.join(self.held.withColumnsRenamed({"uid": "b", "held": "hb"}), "b")
        shared = F.size(F.array_intersect("ha", "hb"))
        union = F.size("ha") + F.size("hb") - shared
        return stored(both.where(shared >= F.lit(self.similarity) * union).select("a", "b").distinct(), "links")


def _mixed(met: DataFrame, links: DataFrame) -> DataFrame:
    """(band, uid, root, low) of the buckets that span several components."""
    label = components(links).withColumnRenamed("node", "uid")
    met = met.select("band", "uid").join(label, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    spans = met.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return stored(met.join(spans.drop("high"), "band"), "mixed")


def near_duplicates(
    docs: DataFrame, doc_id="doc_id", text="text", similarity: float = SIMILARITY, weighted: bool = False,
    rows: int = ROWS, bands: int = BANDS,
) -> DataFrame:
    """(uid, doc_id, text_hash, class_id, kept) per row: class_id is the smallest id of its group, whose row is kept."""
    rows_ = sketches(docs, doc_id, text, weighted, rows * bands)
    worded = rows_.where("c1 is not null")
    firsts = stored(worded.groupBy("c1", "c2").agg(F.min("uid").alias("rep")), "firsts")
    members = worded.join(firsts, ["c1", "c2"]).select("uid", "rep")
    classes = stored(rows_.join(firsts, rows_["uid"] == firsts["rep"], "left_semi").select("uid", "doc_id", "text_hash", "signature"), "classes")
    band = stored(_bands(classes, rows, bands), "bands")
    leaders = band.groupBy("band").agg(F.min("uid").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = stored(band.join(leaders, "band"), "met")
    verifier = _Verifier(docs, classes, met, doc_id, text, weighted, similarity)
    links = verifier.links(met.where("uid <> leader").select(F.col("uid").alias("a"), F.col("leader").alias("b")).distinct())
    mixed = _mixed(met, links)
    left = mixed.where("root <> low").count()
    for turn in range(ROUNDS):
        if not left:
            break
        # one more leader per bucket: a text in the middle of a group, known by its many links; else any
        ends = links.select(F.col("a").alias("uid")).union(links.select(F.col("b").alias("uid")))
        degree = ends.groupBy("uid").agg(F.count(F.lit(1)).alias("degree"))
        known = mixed.join(degree, "uid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)) if turn % 2 == 0 else F.lit(0))
        chosen = F.max(F.struct("degree", F.xxhash64("uid", F.lit(turn)).alias("h"), "uid", "root"))
        led = known.groupBy("band").agg(chosen.alias("l")).select("band", F.col("l.uid").alias("b"), F.col("l.root").alias("rb"))
        pairs = mixed.join(led, "band").where("root <> rb").select(F.col("uid").alias("a"), "b").distinct()
        more = verifier.links(pairs)
        if more.isEmpty():
            break
        links = stored(links.unionByName(more).distinct(), "links")
        mixed = _mixed(met, links)
        left = mixed.where("root <> low").count()
    if left:
        # what leaders don't settle: every pair across components, compared inside the join, which
        # gives out links only; sets of 32-bit hashes do there, the exact check follows
        short = F.transform("held", lambda x: F.shiftrightunsigned(x, 33).cast("int")).alias("h")
        listed = mixed.join(verifier.held.select("uid", short), "uid")
        aside = listed.where("root <> low").select("band", F.col("uid").alias("a"), F.col("root").alias("ra"), F.col("h").alias("ha"))
        others = listed.select("band", F.col("uid").alias("b"), F.col("root").alias("rb"), "low", F.col("h").alias("hb"))
        # of two outside the main component one order is enough
        once = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("low")) | (F.col("a") < F.col("b")))
        least = similarity - 0.005
        both = F.size("ha") + F.size("hb")
        sizes = F.least(F.size("ha"), F.size("hb")) >= F.lit(least) * F.greatest(F.size("ha"), F.size("hb"))
        near = F.size(F.array_intersect("ha", "hb")) * F.lit(1 + least) >= F.lit(least) * both
        across = aside.join(others, (aside["band"] == others["band"]) & once & sizes & near)
        more = verifier.exact(across.select("a", "b").distinct())
        links = links.unionByName(more)
    grouped = stored(components(links), "components")
    label = grouped.select(F.col("node").alias("rep"), "root")
    rooted = members.join(label, "rep", "left").select("uid", F.coalesce("root", "rep").alias("root"))
    full = stored(rows_.select("uid", "doc_id", "text_hash").join(rooted, "uid", "left").withColumn("root", F.coalesce("root", "uid")), "rooted")
    # null ids come last in a group
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    best = full.groupBy("root").agg(F.min(order).alias("best"))
    best = best.select("root", F.col("best.doc_id").alias("class_id"), F.col("best.uid").alias("keeper"))
    return full.join(best, "root").select("uid", "doc_id", "text_hash", "class_id", (F.col("uid") == F.col("keeper")).alias("kept"))


def deduplicate(docs: DataFrame, doc_id="doc_id", text="text", **options) -> DataFrame:
    """One document of each group, with all its columns."""
    found = stored(near_duplicates(docs, doc_id, text, **options), "near_duplicates")
    kept = found.where("kept").select("doc_id", "text_hash").alias("k")
    d = docs.alias("d")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("k.text_hash"))
    out = d.join(kept, same, "left_semi")
    # rows equal in id and text can't be told apart by them: only one of each was kept
    repeated = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay")).where("n > stay and stay > 0")
    repeated = stored(repeated.select("doc_id", "text_hash"), "repeated")
    if repeated.isEmpty():
        return out
    r, o = repeated.alias("r"), out.alias("o")
    again = F.col(f"o.`{doc_id}`").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64(F.col(f"o.`{text}`")) == F.col("r.text_hash"))
    single = o.join(r, again, "left_semi").dropDuplicates([doc_id, text])
    return o.join(r, again, "left_anti").unionByName(single)
