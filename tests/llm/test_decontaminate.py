import random
import re

from pyspark.sql import functions as F

from loanmart.llm import decontaminate


def shingle_set(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus():
    rng = random.Random(4)
    items = [(i, " ".join(f"t{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 60)))) for i in range(30)]
    items += [(30, items[3][1]), (31, None), (32, ""), (33, "Short One"), (None, "an item with no id of its own")]
    docs = []
    for n in range(200):
        words = [f"d{rng.randint(0, 5000)}" for _ in range(rng.randint(0, 300))]
        if n % 4 == 0:
            item = items[n % 30][1].split(" ")
            for _ in range(n % 3):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = item
        docs.append((n, (", " if n % 5 else "\n").join(words), "s"))
    docs += [(300, None, None), (301, "", "s"), (302, "short, one!", "s"), (None, items[2][1].upper(), "s"), (303, items[3][1] + " and more", "s"), (303, "clean", "s")]
    docs += [(304, "filler " * 200000 + items[5][1] + " filler" * 200000, "s")] + [(400 + i, "before " + items[7][1] + " after", "s") for i in range(150)]
    return docs, items


def test_pairs_match_brute_force(spark, docs_of):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = decontaminate.contained_items(docs_of(docs), bench).collect()
    sets = [(i, shingle_set(t)) for i, t in items]
    want = set()
    for d, text, _ in docs:
        held = shingle_set(text)
        for i, s in sets:
            if s and len(held & s) >= -(-8 * len(s) // 10):
                want.add((d, i, len(held & s), len(s)))
    assert {(r["doc_id"], r["item_id"], r["shared"], r["n_shingles"]) for r in got} >= {w for w in want if w[1] is not None}
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert all((r["doc_id"], r["item_id"], r["shared"], r["n_shingles"]) in want for r in got)
    assert any(r["doc_id"] == 304 for r in got) and any(r["doc_id"] is None for r in got) and any(r["doc_id"] == 302 for r in got)


def test_clean_documents_stay(spark, docs_of):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs_of(docs)
    kept = decontaminate.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    sets = [shingle_set(t) for i, t in items if i is not None]
    clean = [d for d, t, _ in docs if not any(s and len(shingle_set(t) & s) >= -(-8 * len(s) // 10) for s in sets)]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(clean)


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(docs_of([]), none).count() == 0
    assert decontaminate.decontaminate(docs_of([(1, "a b c d e f", "s")]), none).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.decontaminate(docs_of([]), some).count() == 0
