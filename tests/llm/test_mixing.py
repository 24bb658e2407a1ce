import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loanmart.llm import mixing
from loanmart.llm.common import word_count


def water(sizes, weights):
    """Targets by the rule, dealt anew until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if w[s] * rest / total > 3 * sizes[s]}
        if not over:
            target.update({s: w[s] * rest / total for s in free})
            break
        target.update({s: 3.0 * sizes[s] for s in over})
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), f"s{i % 5}" if i % 3 else "hot") for i in range(300)]
    rows += [(None, "a b c", None), (7, None, None), (8, "", "s1"), (9, "one word\x0btwo", "ü")]
    return rows + [(500, "x y z", "s2")] * 6


def test_targets_and_taken_words(docs_of):
    rows = corpus()
    got = mixing.mix_report(docs_of(rows), word_count(F.col("text"))).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = water(sizes, (1, 2, 3))
    assert all(abs(want[s] - target[s]) < 1e-6 for s in sizes)
    assert all(abs(taken[s] - target[s]) < 6 for s in sizes)
    assert {r["source_size"] for r in got if r["source"] == "ü"} == {2}


def test_reruns_agree_and_order_of_rows_does_not_matter(docs_of):
    rows = corpus()
    one = sorted(map(str, mixing.mix_report(docs_of(rows), word_count(F.col("text"))).collect()))
    two = sorted(map(str, mixing.mix_report(docs_of(rows[::-1]), word_count(F.col("text"))).collect()))
    assert one == two


def test_many_ranges_give_the_same_cut(docs_of, monkeypatch):
    docs, size = docs_of(corpus()), word_count(F.col("text"))
    one = sorted(map(str, mixing.mix_report(docs, size).collect()))
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 4)
    assert sorted(map(str, mixing.mix_report(docs, size).collect())) == one


def test_mix_keeps_whole_rows(docs_of):
    rows = corpus()
    docs = docs_of(rows)
    report = defaultdict(int)
    mixed = mixing.mix(docs, word_count(F.col("text")))
    assert mixed.columns == docs.columns
    counts = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    assert set(counts) <= {tuple(r) for r in rows} and max(counts.values()) <= 18
    assert counts[(8, "", "s1")] == 1
    for (_, text, source), n in counts.items():
        report[source] += n * len((text or "").split())
    target = {r["source"]: r["target"] for r in mixing.mix_report(docs, word_count(F.col("text"))).collect()}
    assert all(abs(report[s] - target[s]) <= 40 for s in target)


def test_empty(docs_of):
    docs = docs_of([])
    assert mixing.mix_report(docs, word_count(F.col("text"))).count() == 0
    assert mixing.mix(docs, word_count(F.col("text"))).count() == 0
    only = mixing.mix_report(docs_of([(1, None, "a"), (2, "", None)]), word_count(F.col("text"))).collect()
    assert [r["taken"] for r in only] == [0, 0]
