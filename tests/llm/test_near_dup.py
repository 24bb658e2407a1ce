import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loanmart.llm import near_dup


def shingle_set(text, weighted=False):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    turn, out = Counter(), set()
    for s in found:
        out.add((s, turn[s]) if weighted else s)
        turn[s] += 1
    return out


def brute_force(rows, weighted=False):
    """Smallest id of each row's group, by comparing all pairs."""
    sets = [shingle_set(t, weighted) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[(rows[i][0], min(ids) if ids else None)] += 1
    return out, len(groups)


def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{i}é" for i in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words), "s"))
            n += 1
    rows += [(1000 + i, rows[5][1], "s") for i in range(20)]  # exact copies
    rows += [(2000, "few words", "s"), (2001, "few\twords", "s"), (2002, "few words here", "s")]
    rows += [(2003, None, "s"), (2004, "", "s"), (2005, " \n", "s"), (None, "null id with five words or more", "s")]
    rows += [(None, "null id with five words or more", "s"), (2006, "same row twice is here now", "s"), (2006, "same row twice is here now", "s")]
    rows += [(2007, "again and again " * 3, "s"), (2008, "again and again " * 30, "s"), (2009, "long " + " ".join(f"x{i}" for i in range(400_000)), "s")]
    rows.append((2010, rows[-1][1] + " end", "s"))
    return rows


@pytest.mark.parametrize("weighted", [False, True])
def test_groups_match_brute_force(docs_of, weighted):
    rows = corpus()
    docs = docs_of(rows, clash=False)
    found = near_dup.near_duplicates(docs.repartition(3), weighted=weighted).collect()
    want, groups = brute_force(rows, weighted)
    assert Counter((r["doc_id"], r["class_id"]) for r in found) == want
    assert sum(r["kept"] for r in found) == groups


def test_buckets_of_many_components_are_settled(docs_of, monkeypatch):
    # one coordinate per band: everything with anything in common meets
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 2000]
    monkeypatch.setattr(near_dup, "ROUNDS", 1)
    found = near_dup.near_duplicates(docs_of(rows), rows=1, bands=40).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in found) == brute_force(rows)[0]


def test_one_row_of_each_group_stays(docs_of):
    rows = corpus()
    docs = docs_of(rows)
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == brute_force(rows)[1]
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got[2006] == 1 and got[None] == 1 and got[2003] == got[2004] == got[2005] == 1


def test_empty(docs_of):
    assert near_dup.near_duplicates(docs_of([])).count() == 0
    assert near_dup.deduplicate(docs_of([])).count() == 0
    assert near_dup.deduplicate(docs_of([(1, None, None), (2, "", None)])).count() == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n, shared in ((300, 240), (20, 10), (4000, 3600)):
        agree = []
        for _ in range(30):
            e = rng.integers(0, 1 << 62, 2 * n - shared).astype(np.uint64)
            both, owner = np.r_[e[:n], e[n - shared :]], np.repeat([0, 1], n)
            s = near_dup.signatures(both, owner, 2, 110)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - shared / (2 * n - shared)) < 0.04


def test_signatures_follow_real_weights():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(40):
        e = rng.integers(0, 1 << 62, 50).astype(np.uint64)
        a = rng.random(50) * 3 + 0.05
        b = a * rng.choice([0.5, 1.0, 1.5], 50)
        s = near_dup.signatures(np.r_[e, e], np.repeat([0, 1], 50), 2, 110, np.r_[a, b])
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.03
