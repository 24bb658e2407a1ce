import numpy as np
import pytest

from loanmart.llm import hnsw

KIND = "vec_id long, embedding array<double>, links string, uid string"


def corpus(seed=0, spread=0.15):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(30, 16))
    rows = []
    for i in range(600):
        c = centers[i % 30] if i % 3 else rng.normal(size=16) * 3
        rows.append((i, [float(x) for x in c + rng.normal(size=16) * spread]))
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # equal vectors
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] + [1.0] * 15)]
    rows += [(2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[7][1]), (2008, [1e-200 * x for x in rows[8][1]]), (5, rows[9][1])]
    return rows


def brute_force(rows):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if g else None for (_, v), g in zip(rows, good)]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    links = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(len(rows))]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            low = min([root[i], *[root[j] for j in near]])
            if low < root[i]:
                root[i], changed = low, True
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
    return [(rows[i][0], len(links[i]), least.get(root[i])) for i in range(len(rows))]


@pytest.mark.parametrize("spread", [0.15, 0.4])
def test_links_and_components_match_brute_force(spark, spread):
    rows = corpus(spread=spread)
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], KIND)
    got = hnsw.near_vectors(frame).collect()
    want = brute_force(rows)
    assert len(got) == len(want)
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2])
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key)
    total = sum(w[1] for w in want)
    assert sum(f[1] for f in found) >= 0.99 * total and sum(f[1] for f in found) <= total
    assert [f[::2] for f in found] == [w[::2] for w in sorted(want, key=key)]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_recall_of_one_graph():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x[:500] = x[0] + rng.normal(size=(500, 24)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.build(x, np.arange(3000), np.ones(3000, dtype=np.int64))
    graph.settle()
    again = hnsw.Graph.load(graph.dump())
    found = sum(len(i) for i, _ in again.hits(x, again.beam))
    want = int((x @ x.T >= hnsw.COSINE).sum())
    assert 0.99 * want <= found <= want
    # connected components of links are those of brute force
    assert len(set(graph.root)) == len(set(_components(x)))


def test_a_hot_group_does_not_hide_missed_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 24))
    x[:400] = x[0] + rng.normal(size=(400, 24)) * 0.05
    x[800:] = x[400:800] + rng.normal(size=(400, 24)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    class Narrow(hnsw.Graph):
        def hits(self, q, beam):
            # narrow beams lose all links of pairs
            for i, j in super().hits(q, beam):
                yield (i, j) if beam >= 100 else (i[self.uid[j] < 400], j[self.uid[j] < 400])

    graph = Narrow.build(x, np.arange(1200), np.ones(1200, dtype=np.int64))
    graph.settle()
    assert graph.beam >= 100
    assert len(set(graph.root)) == len(set(_components(x)))


def test_recall_is_that_of_the_worst_found_stratum():
    want = np.array([10_000] * 85 + [1] * 171 + [0] * 10)
    assert hnsw.lowest_recall(want, np.where(want > 1, want, 0)) == 0.0
    assert hnsw.lowest_recall(want, want) == 1.0
    assert hnsw.lowest_recall(np.zeros(3), np.zeros(3)) == 1.0


def _components(x):
    near = x @ x.T >= hnsw.COSINE
    root = np.arange(len(x))
    while True:
        low = np.where(near, root[None, :], len(x)).min(axis=1)
        if (low == root).all():
            return root
        root = low


def test_empty(spark):
    assert hnsw.near_vectors(spark.createDataFrame([], KIND)).count() == 0
    only = hnsw.near_vectors(spark.createDataFrame([(1, None, None, None)], KIND)).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]


def test_few_vectors_ask_one_shard(spark, monkeypatch):
    asked, ask = [], hnsw._ask

    def counted(vectors, shards, *rest):
        asked.append(shards)
        return ask(vectors, shards, *rest)

    monkeypatch.setattr(hnsw, "_ask", counted)
    rows = corpus()
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], KIND)
    assert hnsw.near_vectors(frame).count() == len(rows)
    assert set(asked) == {1}
