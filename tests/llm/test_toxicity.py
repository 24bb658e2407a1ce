import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loanmart.llm import toxicity
from loanmart.llm.words import Hasher, doc_words

BAD = ["idiot", "scum", "loser"]


def corpus(n=600):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randint(0, len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark, docs_of):
    rows, labels = corpus()
    frame = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    return toxicity.fit(docs_of(rows), frame, ~toxicity.held_out(F.col("doc_id")))


def test_held_out_rows(spark):
    rows = spark.range(100).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_held_out_accuracy(docs_of, model):
    rows, labels = corpus()
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs_of(rows), model, "doc_id").collect()}
    apart = [(scores[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((s >= 0.3) == bool(y) for s, y in apart)
    assert len(apart) > 100 and right / len(apart) > 0.95


def test_scores_of_odd_texts(docs_of, model):
    long = "word1 " * 500_000 + "idiot scum loser " + "word2 " * 500_000
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n", "s"), (4, long, "s"), (5, "Idiot! SCUM.", "s"), (5, "Idiot! SCUM.", "s"), (None, "word1", None)]
    got = [(r["doc_id"], r["score"]) for r in toxicity.scored(docs_of(rows), model, "doc_id", "size").collect()]
    by = {i: s for i, s in got}
    assert len(got) == 7 and all(0 <= s <= 1 for _, s in got)
    assert by[1] == by[2] == by[3] and by[4] > 0.5 and by[5] > 0.5
    assert toxicity.scored(docs_of([]), model, "doc_id").count() == 0


def test_whole_text_counts_wherever_it_is_cut(model, monkeypatch):
    text = "word1 word2 " * 300 + "idiot scum " + "word3 " * 100
    column = pa.array([text, "word1"])
    whole = next(toxicity._scorer(model)(iter([column]))).to_pylist()
    monkeypatch.setattr("loanmart.llm.words.PIECE_BYTES", 64)
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 7)
    parts = next(toxicity._scorer(model)(iter([column]))).to_pylist()
    assert np.allclose(whole, parts, atol=1e-6)


def test_clean_documents_stay(spark, docs_of):
    rows, labels = corpus()
    docs = docs_of(rows)
    kept = toxicity.keep_clean(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    wrong = sum((i in ids) == bool(y) for i, y in labels)
    assert wrong <= 0.03 * len(labels)


def test_thresholds_come_from_labels_the_fit_has_not_seen(spark, docs_of):
    rows, labels = corpus(1200)
    # some toxic labels are wrong, so that no threshold is perfect; one language is rare, one text is long
    labels = [(i, int(y or (i % 5 == 1 and i < 600))) for i, y in labels]
    rows[0] = (0, rows[0][1] + " word1" * 3000, "s")
    docs = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") % 50 == 0, "rare").otherwise("en"))
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, frame, per_class=60, reserve=True)
    scored = toxicity.scored(docs, model, "doc_id", "lang").withColumnRenamed("lang", "language")
    toxicity.calibrate(model, scored, frame)
    scores = {r["doc_id"]: r["score"] for r in scored.collect()}
    place = {r["doc_id"]: (r["p"], r["r"]) for r in frame.select("doc_id", toxicity._place().alias("p"), toxicity._reserved().alias("r")).collect()}
    truth = dict(labels)
    unseen = {i for i, (p, r) in place.items() if r or p > model.drawn[truth[i]]}
    assert 900 < len(unseen) < 1140 and sum(truth[i] == 1 and i not in unseen for i in truth) == 60
    weight = {y: sum(v == y for v in truth.values()) / sum(truth[i] == y for i in unseen) for y in (0, 1)}

    def f1(limit, of):
        hit = sum(weight[1] for i in of if scores[i] >= limit and truth[i])
        said = hit + sum(weight[0] for i in of if scores[i] >= limit and not truth[i])
        return 2 * hit / (said + sum(weight[1] for i in of if truth[i]))

    some = {i for i in unseen if i % 50}
    assert list(model.thresholds) == ["en"]
    assert f1(model.thresholds["en"], some) >= max(f1(s, some) for s in scores.values()) - 0.01
    assert f1(model.pooled, unseen) >= max(f1(s, unseen) for s in scores.values()) - 0.01
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, frame, per_class=60).collect()}
    assert kept == {i for i, s in scores.items() if s < (model.thresholds["en"] if i % 50 else model.pooled)}


def test_pooling_equals_a_plain_convolution(model):
    rng = np.random.default_rng(2)
    lengths = [1, 2, 5, 17, 0, 3]
    ids = rng.integers(0, toxicity.BUCKETS, (sum(lengths), 3)).astype(np.int32)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    got = model.pool(ids, owner, len(lengths))
    for row in range(len(lengths)):
        emb = model.table[ids[owner == row]].sum(axis=1)
        if not len(emb):
            assert np.isneginf(got[row]).all()
            continue
        at = 0
        for filters in model.filters:
            padded = np.vstack([emb, np.zeros((len(filters) - 1, toxicity.SIZE))])
            each = np.array([[(padded[i : i + len(filters)] * filters[:, :, k]).sum() for k in range(toxicity.FILTERS)] for i in range(len(emb))])
            assert np.allclose(got[row, at : at + toxicity.FILTERS], each.max(axis=0), atol=1e-4)
            at += toxicity.FILTERS


def test_long_texts_are_learned_whole(spark, docs_of):
    rng = random.Random(1)
    # the only toxic texts are long, and what makes them toxic is said once
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") * 4 for _ in range(4000)) + (" idiot" if i % 2 else ""), "s") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(rows), labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs_of(rows), model, "doc_id").collect()}
    assert min(scores[i] for i in range(1, 40, 2)) > max(scores[i] for i in range(0, 40, 2))


def test_without_labels_nothing_is_toxic(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of([(1, "a b", "s")])
    assert toxicity.fit(docs, none) is None
    assert toxicity.keep_clean(docs, none).count() == 1
    assert [r["score"] for r in toxicity.scored(docs, None, "doc_id").collect()] == [0.0]


def test_words_of_pieces_match_plain_words():
    hasher = Hasher(plain=True)
    texts = ["Äé Stupid, stupid! x", "", None, "STUPID\näÉ"]
    found = {}
    for first, rows, hashes, owner, _ in doc_words(pa.array(texts), hasher):
        for h, o in zip(hashes, owner):
            found.setdefault(first + int(o), []).append(int(h))
    a, b = found[0], found[3]
    assert len(a) == 4 and a[1] == a[2] == b[0] and a[0] == b[1] and 1 not in found and 2 not in found
