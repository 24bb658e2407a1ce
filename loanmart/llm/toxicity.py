"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of three rows of a hashed table: of the word and of its first four
and five bytes, so that forms of a stem share what was learned.  Filters of several widths run
over the whole text, the maximum of each over all places is pooled, and a logistic unit makes
the score.  Thresholds for flagging are calibrated by language: texts are scored once, whole, and the labels
that the fit has not seen are counted by language and range of scores, each class weighted back to its true share.  One
label in ``RESERVED`` is never drawn for a fit whose thresholds are calibrated, so there are such labels at every size.
Languages of few toxic labels take the threshold of all together.  The score itself sees nothing but the text.

Training takes a bounded sample: in hash order, at most ``PER_CLASS`` labelled texts of either class and ``WORDS_PER_CLASS``
words of each, whole texts of any length up to that; it takes ``STEPS`` steps.  The share of toxic labels, which sets the score's
level, is counted over all labels that may be learned.  Scoring reads every text whole, in pieces of bounded size.

Defined cases: null texts and texts without words get the score of an empty text; a null id is not
held out and has no label; several labels of an id count by their mean, null labels not at all;
repeated rows get equal scores; without any usable label every score is 0, with texts of one
class only it is the share of toxic labels, and ``keep_clean`` keeps all in both cases; an empty table gives no rows; further columns, whatever their names, are kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import stored
from .common import smallest
from .near_dup import _lists
from .words import Hasher, doc_words

PER_CLASS = 4000
WORDS_PER_CLASS = 1_500_000
BUCKETS = 1 << 16
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
STEPS = 600
BATCH = 64
BATCH_WORDS = 60_000
RESERVED = 5
PREFIXES = (4, 5)
THRESHOLD = 0.3
LEAST_POSITIVES = 20
LEAST_TEXTS = 3
CHUNK_WORDS = 25_000
SCORE_BINS = 64  # per unit of log-odds, which are counted between -30 and 30


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def _ids(hashes: np.ndarray, cut: list[np.ndarray]) -> np.ndarray:
    """(words, 3) rows of the embedding table."""
    salted = [h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for k, h in enumerate([hashes, *cut])]
    return np.stack([(h >> np.uint64(20)) % np.uint64(BUCKETS) for h in salted], axis=1).astype(np.int32)


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # per width: (width, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    level: float
    thresholds: dict[str, float] = field(default_factory=dict)
    pooled: float = THRESHOLD  # of languages without one of their own
    drawn: dict[int, int] = field(default_factory=dict)  # by class: the last place in hash order that the fit has seen
    learned: bool = True

    @classmethod
    def fresh(cls, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 1 / np.sqrt(w * SIZE), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        table = rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
        return cls(table, filters, np.zeros(n, np.float32), rng.normal(0, 0.5, n).astype(np.float32), 0.0)

    def convolve(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings, responses at every place); windows end with their text."""
        emb = self.table[ids[:, 0]] + self.table[ids[:, 1]] + self.table[ids[:, 2]]
        flat = np.concatenate([f.transpose(1, 0, 2).reshape(SIZE, -1) for f in self.filters], axis=1)
        each = emb @ flat
        response = np.empty((len(ids), FILTERS * len(WIDTHS)), dtype=np.float32)
        at = 0
        for i, w in enumerate(WIDTHS):
            part = each[:, at : at + FILTERS].copy()
            for k in range(1, w):
                inside = (owner[k:] == owner[:-k])[:, None]
                part[:-k] += each[k:, at + k * FILTERS : at + (k + 1) * FILTERS] * inside
            response[:, i * FILTERS : (i + 1) * FILTERS] = part
            at += w * FILTERS
        return emb, response

    def pool(self, ids: np.ndarray, owner: np.ndarray, rows: int, windows: int | None = None) -> np.ndarray:
        """Maximum of every filter over each text, in chunks that overlap by the widest filter.

        With ``windows`` only so many first places count: a text may go on after the words given.
        """
        best = np.full((rows, FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
        reach = max(WIDTHS) - 1
        n = len(ids) if windows is None else windows
        for lo in range(0, n, CHUNK_WORDS):
            hi = min(lo + CHUNK_WORDS + reach, len(ids))
            own = owner[lo:hi]
            _, response = self.convolve(ids[lo:hi], own)
            use = min(CHUNK_WORDS, n - lo)
            response, own = response[:use], own[:use]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            top = np.maximum.reduceat(response, starts, axis=0)
            best[own[starts]] = np.maximum(best[own[starts]], top)
        return best

    def score(self, pooled: np.ndarray) -> np.ndarray:
        seen = np.maximum(np.where(np.isfinite(pooled), pooled, 0) + self.bias, 0)
        seen[~np.isfinite(pooled[:, 0])] = 0
        return 1 / (1 + np.exp(-(seen @ self.out + self.level).astype(np.float64)))


class _Adagrad:
    def __init__(self, shape, rate: float) -> None:
        self.sum, self.rate = np.full(shape, 1e-6, dtype=np.float32), rate

    def step(self, value: np.ndarray, grad: np.ndarray, rows=...) -> None:
        self.sum[rows] += grad * grad
        value[rows] -= self.rate * grad / np.sqrt(self.sum[rows])


def train(texts: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 0) -> Model:
    """Fit on lists of (words, 3) ids; gradients reach only the places that won the pooling."""
    model, rng = Model.fresh(seed), np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    by = {"table": _Adagrad(model.table.shape, 0.05), "bias": _Adagrad(n, 0.02), "out": _Adagrad(n, 0.02), "level": _Adagrad(1, 0.02)}
    by_filter = [_Adagrad(f.shape, 0.02) for f in model.filters]
    level = np.zeros(1, dtype=np.float32)
    usable = np.flatnonzero([len(t) > 0 for t in texts])
    # rows seen in too few texts say more about these texts than about words: they stay zero
    seen_in = np.zeros(BUCKETS, dtype=np.int32)
    for i in usable:
        seen_in[np.unique(texts[i])] += 1
    learned = seen_in >= LEAST_TEXTS
    model.table[~learned] = 0
    # as many steps whatever the size of the sample
    while steps > 0 and len(usable):
        order = rng.permutation(usable)
        reach = np.cumsum([len(texts[i]) for i in order])
        lo = 0
        while lo < len(order) and steps > 0:
            hi = int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + BATCH_WORDS, side="right"))
            some = order[lo : max(lo + 1, min(lo + BATCH, hi))]
            lo, steps = lo + len(some), steps - 1
            ids = np.concatenate([texts[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(texts[i]) for i in some])
            kept = rng.random(len(ids)) > 0.1
            kept[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])] = True
            ids, owner = ids[kept], owner[kept]
            emb, response = model.convolve(ids, owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            top = np.maximum.reduceat(response, starts, axis=0)
            place = np.where(response == top[owner], np.arange(len(ids))[:, None], len(ids))
            place = np.minimum.reduceat(place, starts, axis=0)
            seen = np.maximum(top + model.bias, 0)
            p = 1 / (1 + np.exp(-(seen @ model.out + level)))
            error = ((p - labels[some]) / len(some)).astype(np.float32)
            back = error[:, None] * model.out * (seen > 0)
            rows, grads = [], []
            for i, w in enumerate(WIDTHS):
                own, at = back[:, i * FILTERS : (i + 1) * FILTERS], place[:, i * FILTERS : (i + 1) * FILTERS]
                change = np.zeros_like(model.filters[i])
                for k in range(w):
                    to = np.minimum(at + k, len(ids) - 1)
                    g = own * ((at + k < len(ids)) & (owner[to] == np.arange(len(some))[:, None]))
                    change[k] = np.einsum("df,dfs->sf", g, emb[to])
                    rows.append(to.ravel())
                    grads.append((g[:, :, None] * model.filters[i][k].T).reshape(-1, SIZE))
                by_filter[i].step(model.filters[i], change)
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            live = np.abs(grads).max(axis=1) > 0
            rows, grads = ids[rows[live]].ravel(), np.repeat(grads[live], ids.shape[1], axis=0)
            touched, at = np.unique(rows, return_inverse=True)
            change = np.zeros((len(touched), SIZE), dtype=np.float32)
            np.add.at(change, at, grads)
            by["table"].step(model.table, change[learned[touched]], touched[learned[touched]])
            by["out"].step(model.out, (seen * error[:, None]).sum(axis=0))
            by["bias"].step(model.bias, back.sum(axis=0))
            by["level"].step(level, error.sum(keepdims=True))
    model.level = float(level[0])
    return model


def _best_threshold(counts: list[tuple[int, int, float, float]]) -> float:
    """Middle of the gap after which F1 is highest; (rows, toxic rows, lowest, highest score) by falling score."""
    n, toxic, low, high = (np.array(c, dtype=np.float64) for c in zip(*counts))
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())
    k = int(np.argmax(f1))
    return float((low[k] + (high[k + 1] if k + 1 < len(n) else 0.0)) / 2)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(plain=True)
    for batch in batches:
        found: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
        for first, rows, hashes, owner, cut in doc_words(batch.column("text"), hasher, PREFIXES):
            ids, ends = _ids(hashes, cut), np.cumsum(np.bincount(owner, minlength=rows))
            for i in range(rows):
                found[first + i].append(ids[ends[i - 1] if i else 0 : ends[i]])
        lengths = np.array([sum(len(x) for x in f) for f in found], dtype=np.int64)
        flat = [x.ravel() for f in found for x in f]
        flat = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), _lists(flat, lengths * 3, pa.int32())], names=["toxic", "tokens"])


def _known(labels: DataFrame, learnable: Column | None, doc_id: str, label: str) -> DataFrame:
    """(doc_id, toxic) of every id with a label that may be learned."""
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null")
    if learnable is not None:
        known = known.where(learnable)
    return known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))


def _place() -> Column:
    return F.xxhash64("doc_id")


def _reserved() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(RESERVED)) == 0


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, doc_id="doc_id", text="text",
        label: str = "toxic", per_class: int = PER_CLASS, reserve: bool = False) -> Model | None:
    """Train on labels of rows where ``learnable`` (a condition on ``doc_id``) holds; None without any label.

    With ``reserve`` one label in ``RESERVED`` is kept from the fit.
    """
    spark, kind = docs.sparkSession, "doc_id long, toxic int"
    known = _known(labels, learnable, doc_id, label)
    n, positives = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n:
        return None
    open_to_fit = known.where(~_reserved()) if reserve else known
    drawn = [tuple(r) for value in (0, 1) for r in smallest(open_to_fit.where(F.col("toxic") == value), per_class, _place(), F.col("doc_id"))]
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # the drawn ids are bounded: at most two times per_class rows of two numbers
    sample = named.join(F.broadcast(spark.createDataFrame(drawn, kind)), "doc_id")
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("words")
    lengths = sample.select("doc_id", "toxic", _place().alias("place"), words).groupBy("doc_id", "toxic", "place").agg(F.sum("words").alias("words"))
    taken, last, left = [], {}, {0: WORDS_PER_CLASS, 1: WORDS_PER_CLASS}
    for r in sorted(lengths.collect(), key=lambda r: (r["place"], r["doc_id"])):
        if r["words"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["words"]
            taken.append((r["doc_id"], r["toxic"]))
            last[r["toxic"]] = r["place"]
    if not taken:
        return None
    rows = named.join(F.broadcast(spark.createDataFrame(taken, kind)), "doc_id").select("toxic", "text")
    rows = rows.mapInArrow(_tokens, "toxic int, tokens array<int>").toArrow()
    y = np.array(rows.column("toxic").to_pylist(), dtype=np.float32)
    texts = [np.asarray(t, dtype=np.int32).reshape(-1, 3) for chunk in rows.column("tokens").chunks for t in _unpacked(chunk)]
    # rows come in any order; the model must not depend on it
    order = sorted(range(len(y)), key=lambda i: (len(texts[i]), texts[i].tobytes(), y[i]))
    texts, y = [texts[i] for i in order], y[order]
    one_class = y.min(initial=1) == y.max(initial=0)
    model = train(texts, y, 0 if one_class else STEPS)
    model.drawn = last
    if one_class:
        # nothing tells the classes apart: every text gets their share
        model.out[:], model.learned = 0, False
    # the sample is balanced, the corpus is not
    share, drawn_share = (positives + 1) / (n + 2), (y.sum() + 1) / (len(y) + 2) if model.learned else 0.5
    model.level += float(np.log(share / (1 - share)) - np.log(drawn_share / (1 - drawn_share)))
    return model


def _unpacked(chunk: pa.ListArray) -> list[np.ndarray]:
    flat, ends = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _scorer(model: Model | None):
    """Scores of one array of texts after another."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher(plain=True)
        reach, ids_none = max(WIDTHS) - 1, np.zeros((0, 1 + len(PREFIXES)), dtype=np.int32)
        for column in columns:
            scores = np.zeros(len(column))
            if model is not None:
                pooled = np.full((len(column), FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
                tail, tail_of = ids_none, -1

                def pool(ids: np.ndarray, owner: np.ndarray, first: int, rows: int, windows: int | None = None) -> None:
                    if not len(ids):
                        return
                    best = model.pool(ids, owner, rows, windows)
                    pooled[first : first + rows] = np.maximum(pooled[first : first + rows], best)

                for first, rows, hashes, owner, cut in doc_words(column, hasher, PREFIXES):
                    ids = _ids(hashes, cut)
                    if tail_of != first:
                        # the text before is over: its last places
                        pool(tail, np.zeros(len(tail), dtype=np.int64), tail_of, 1)
                        tail = ids_none
                    if rows > 1:
                        pool(ids, owner, first, rows)
                        continue
                    # one text, which may go on: the last places wait for the words that follow
                    ids = np.concatenate([tail, ids])
                    done = max(0, len(ids) - reach)
                    pool(ids, np.zeros(len(ids), dtype=np.int64), first, 1, done)
                    tail, tail_of = ids[done:], first
                pool(tail, np.zeros(len(tail), dtype=np.int64), tail_of, 1)
                scores = model.score(pooled)
            yield pa.array(scores)
            pa.default_memory_pool().release_unused()

    return run


def score(model: Model | None, text: Column) -> Column:
    """The score of a text column; nothing else goes to the Python workers."""
    run = _scorer(model)

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(columns)

    return scores(F.coalesce(text.cast("string"), F.lit("")))


def scored(docs: DataFrame, model: Model | None, *kept: str, text: str = "text") -> DataFrame:
    """The kept columns and ``score`` of every row."""
    return docs.select(*[F.col(f"`{c}`") for c in kept], score(model, F.col(f"`{text}`")).alias("score"))


def _language(lang: str | None) -> Column:
    return (F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")) if lang else F.lit("")).alias("language")


def calibrate(model: Model, scores: DataFrame, labels: DataFrame, learnable: Column | None = None, doc_id="doc_id", label: str = "toxic") -> None:
    """Set the thresholds from (doc_id, language, score) of all texts and all labels the fit has not seen."""
    known = _known(labels, learnable, doc_id, label)
    unseen = _reserved()
    for value in (0, 1):
        unseen = unseen | ((F.col("toxic") == value) & (_place() > F.lit(model.drawn.get(value, -(1 << 63)))))
    # what the fit drew is missing unevenly: every class counts as its share of all labels
    shares = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(unseen.cast("long")).alias("left")).collect()
    weight = F.lit(0.0)
    for r in shares:
        weight = F.when(F.col("toxic") == r["toxic"], F.lit(r["n"] / max(r["left"], 1))).otherwise(weight)
    odds = F.log(F.greatest("score", F.lit(1e-14))) - F.log(F.greatest(1 - F.col("score"), F.lit(1e-14)))
    bin_of = F.floor(F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0)) * SCORE_BINS)
    rows = scores.where("doc_id is not null").join(known.where(unseen), "doc_id").select("language", "toxic", "score", bin_of.alias("bin"), weight.alias("weight"))
    counts = stored(rows.groupBy("language", "bin").agg(
        F.sum("weight").alias("n"), F.sum(F.col("toxic") * F.col("weight")).alias("toxic"), F.sum("toxic").alias("seen"),
        F.min("score").alias("low"), F.max("score").alias("high")), "score_counts")
    often = counts.groupBy("language").agg(F.sum("seen").alias("all")).where(F.col("all") >= LEAST_POSITIVES).select("language")
    by: dict[str, list] = {}
    for r in sorted(counts.join(often, "language").collect(), key=lambda r: -r["bin"]):
        by.setdefault(r["language"], []).append((r["n"], r["toxic"], r["low"], r["high"]))
    model.thresholds = {name: _best_threshold(c) for name, c in by.items()}
    sums = [F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen"), F.min("low").alias("low"), F.max("high").alias("high")]
    pooled = sorted(counts.groupBy("bin").agg(*sums).collect(), key=lambda r: -r["bin"])
    if sum(r["seen"] for r in pooled) >= LEAST_POSITIVES:
        model.pooled = _best_threshold([(r["n"], r["toxic"], r["low"], r["high"]) for r in pooled])


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", lang: str | None = "lang",
               learnable: Column | None = None, label: str = "toxic", **options) -> DataFrame:
    """The rows whose score stays below the threshold of their language, with all their columns.

    Rows are written once with their scores; thresholds and the result are read from there.
    """
    model = fit(docs, labels, learnable, doc_id=doc_id, text=text, label=label, reserve=True, **options)
    if model is None or not model.learned:
        return docs
    # other names, so that none clashes; a text is in the row once
    kept = [(f"_{i}", c) for i, c in enumerate(docs.columns)]
    rows = docs.select(*[F.col(f"`{c}`").alias(own) for own, c in kept], F.col(f"`{doc_id}`").alias("doc_id"), _language(lang), score(model, F.col(f"`{text}`")).alias("score"))
    rows = stored(rows, "scored")
    calibrate(model, rows.select("doc_id", "language", "score"), labels, learnable, doc_id, label)
    limit = F.lit(model.pooled)
    for name, value in sorted(model.thresholds.items()):
        limit = F.when(F.col("language") == name, F.lit(value)).otherwise(limit)
    return rows.where(F.col("score") < limit).select(*[F.col(own).alias(c) for own, c in kept])
