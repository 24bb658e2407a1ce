import random
import zlib

from loanmart.llm import sharding


def rows_of(n=400):
    rng = random.Random(1)
    rows = [(i, "ä" * rng.randint(0, 300), "s") for i in range(n)]
    rows += [(1000 + i, "hot text " * 20, "s") for i in range(n // 2)]
    return rows + [(5, "same", "s")] * 30 + [(None, None, None), (6, "", "s"), (7, "long " * 20000, "s")]


def test_shards_are_even_and_slots_gapless(docs_of):
    rows = rows_of()
    got = sharding.shard_report(docs_of(rows), shards=4).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    longest = max(r["size"] for r in got)
    sizes = {}
    for s in range(4):
        own = [r for r in got if r["shard"] == s]
        sizes[s] = sum(r["size"] for r in own)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert all(abs(v - total / 4) <= longest for v in sizes.values())
    for r in got:
        if r["doc_id"] is None:
            assert (r["size"], r["text_crc32"]) == (1, 0)
        if r["doc_id"] == 5:
            assert r["text_crc32"] in (zlib.crc32(b"same"), zlib.crc32(("ä" * 0).encode()), *[zlib.crc32(t.encode()) for i, t, _ in rows if i == 5])


def test_even_without_the_long_row(docs_of):
    got = sharding.shard_report(docs_of(rows_of()[:-1]), shards=4).collect()
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)


def test_all_columns_come_along(docs_of):
    rows = rows_of(40)
    docs = docs_of(rows)
    out = sharding.shard(docs, shards=3)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    again = sharding.shard(out, shards=2)
    assert again.columns == out.columns and again.agg({"shard": "max"}).first()[0] == 1


def test_overfull_ranges_are_cut_again(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLE_PER_RANGE", 1)
    keyed = sharding.keyed(docs_of(rows_of()[:-1]), "doc_id", "text")
    found, sums = sharding.splitters(keyed, 32)
    rows = sums.collect()
    total = sum(r["bytes"] for r in rows)
    assert found == sorted(set(found))
    assert all(r["n"] == 1 or r["bytes"] <= 2 * total / 32 + r["longest"] for r in rows)


def test_empty(docs_of):
    assert sharding.shard_report(docs_of([])).count() == 0
    assert sharding.shard(docs_of([])).count() == 0
