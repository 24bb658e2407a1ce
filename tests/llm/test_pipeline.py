"""The stages of the corpus pipeline on odd inputs, and the whole of it on a small corpus."""

import random
from collections import Counter

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from loanmart.scratch import stored

KIND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names the stages use themselves
    *[T.StructField(c, T.StringType()) for c in ("score", "doc", "language", "uid", "key", "size", "root", "shingles")],
])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *["x"] * 8) for i, t, lang, s in rows], KIND)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        text = say(rng.randint(20, 60))
        if i % 6 == 0:
            text.insert(rng.randint(0, len(text)), "idiot")
            text.insert(rng.randint(0, len(text)), "scum")
        rows.append((i, " ".join(text), "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 6 == 0)))
    item = " ".join(say(15))
    rows.append((300, f"{' '.join(say(30))} {item} {' '.join(say(30))}", "en", "s1"))
    rows += [(400 + i, rows[1][1], "en", "s0") for i in range(25)]  # a hot group of copies
    rows.append((450, rows[1][1] + " and", "en", "s0"))
    rows += [(500, None, None, None), (501, "", "en", "s2"), (502, " \n", None, "s2"), (None, " ".join(say(40)), "en", "s1"), (7, rows[7][1], "en", "s1")]
    rows.append((503, " ".join(say(30_000)), "en", "s2"))
    folder = str(tmp_path_factory.mktemp("tables"))
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def shingles(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_whole_pipeline(spark, corpus):
    folder, rows = corpus
    out = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    ids = Counter(r["doc_id"] for r in out)
    # what is toxic or holds a benchmark item is gone, clean documents stay
    assert 300 not in ids and not any(i in ids for i in range(0, 240, 6))
    clean = [i for i in range(240) if i % 6 and i != 1]
    assert sum(i in ids for i in clean) >= 0.97 * len(clean)
    # of copies and near copies one stays, by brute force over what is left
    left = {r["doc_id"]: shingles(r["text"]) for r in out if r["text"] and r["text"].split()}
    keys = list(left)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            assert len(left[a] & left[b]) < 0.8 * len(left[a] | left[b])
    assert sum(i in ids for i in (1, *range(400, 425), 450)) == 1
    # shards: 16 of near equal bytes, slots without gaps
    sizes, slots = Counter(), {}
    for r in out:
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) <= set(range(16))
    longest = max(len((r["text"] or "").encode()) + 1 for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * longest
    assert {"score", "doc", "language", "uid", "key", "size", "root", "shingles"} <= set(out[0])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, corpus, name, stage):
    folder, _ = corpus
    columns = [f.name for f in KIND]
    none = stored(stage(spark, frame(spark, []), folder), name)
    assert none.count() == 0 and none.columns[: len(columns)] == columns
    odd = [(None, None, None, None), (1, None, None, None), (1, "", "", ""), (2, " ", "en", None), (2, " ", "en", None), (3, "one two", None, "s")]
    out = stored(stage(spark, frame(spark, odd), folder), name)
    assert out.columns[: len(columns)] == columns
    if name in ("toxicity", "decontamination"):
        assert out.count() == len(odd)
    assert 3 in {r["doc_id"] for r in out.collect()}
