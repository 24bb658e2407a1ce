"""Embedding near-dedup by navigable small-world graphs, one per shard.

Equal vectors collapse to one first.  The rest is dealt over shards by hash, no more of them than hold it, as
every vector asks every shard and a beam costs little more in a large one; each shard builds a
hierarchical navigable small-world graph, and every vector queries every shard.  A beam that
comes back full of hits is widened and run again, so a query finds all its links, not the best
few; how wide beams start is settled by audits, which compare sampled queries with all
vectors by brute force, inside each shard and over all of them.  Every sampled vector counts alike,
however many links or copies it has, and vectors of few links must be found as well as those of many.
Cosines are verified in double precision.  A shard tells for a query how many vectors link to it, and one member of each
of its own components they fall in; these edges carry all connectivity, and their components
are found by Spark.  No pair list of a group is ever made.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are their own component; vectors of different length don't link; several rows with one id are
vectors of their own; a null id is larger than all others; an empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import new_path, stored
from .common import open_store, qualified
from .graph import components

COSINE = 0.9
SHARD_ROWS = 50_000
SHARD_BYTES = 128 << 20  # of vectors in double precision
LINKS = 12
BUILD_BEAM = 48
BEAM = 24
AUDITED = 256
RECALL = 0.99
BLOCK = 256
QUERY_ROWS = 16_384
SCAN = 64  # a beam costs at least as much as a product with so many vectors for each place it has
MARGIN = 1e-4  # more than single precision can err: nearer to the limit, cosines are checked in double


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    if sims.shape[1] <= k:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int):
    """Beam search of many queries at a time: (ids, similarities), unordered; ids of unused places are -1.

    Wide beams read more nodes at once, so that rounds don't grow with the beam.
    """
    at_once = max(4, ef // 8)
    b, n = len(q), len(x)
    ids = np.full((b, ef), -1, dtype=np.int32)
    sims = np.full((b, ef), -np.inf, dtype=np.float32)
    unread = np.zeros((b, ef), dtype=bool)
    seen = np.zeros((b, n), dtype=bool)
    new, rows = entry, np.arange(b)
    first = True
    while True:
        if not first:
            waiting = np.where(unread, sims, -np.inf)
            pick = _top(waiting, at_once)
            live = np.take_along_axis(waiting, pick, axis=1) > -np.inf
            rows = np.flatnonzero(live.any(axis=1))
            if not len(rows):
                return ids, sims
            pick, live = pick[rows], live[rows]
            unread[rows[:, None], pick] &= ~live
            new = links[np.where(live, ids[rows[:, None], pick], 0)]
            new = np.where(live[:, :, None], new, -1).reshape(len(rows), -1)
        new = np.sort(new, axis=1)
        bad = new < 0
        bad[:, 1:] |= new[:, 1:] == new[:, :-1]
        bad |= seen[rows[:, None], new]
        i, j = np.nonzero(~bad)
        seen[rows[i], new[i, j]] = True
        found = np.full(new.shape, -np.inf, dtype=np.float32)
        found[i, j] = np.einsum("ij,ij->i", x[new[i, j]], q[rows[i]])
        all_ids = np.concatenate([ids[rows], new], axis=1)
        all_sims = np.concatenate([sims[rows], found], axis=1)
        fresh = np.concatenate([unread[rows], ~bad], axis=1)
        best = _top(all_sims, ef)[:, :ef]
        ids[rows], sims[rows] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
        unread[rows] = np.take_along_axis(fresh, best, 1)
        first = False


def _select(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours of each row: first those nearer to it than to any chosen one, then the nearest of the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    between = np.matmul(x[ids], x[ids].transpose(0, 2, 1))
    usable = sims > -np.inf
    chosen = np.zeros(ids.shape, dtype=bool)
    for j in range(ids.shape[1]):
        near = (np.where(chosen, between[:, j, :], -np.inf) >= sims[:, j : j + 1]).any(axis=1)
        chosen[:, j] = usable[:, j] & ~near & (chosen.sum(axis=1) < m)
    # chosen ones first, the rest by similarity, the unusable last
    rank = np.argsort(np.where(chosen, 0, np.where(usable, 1, 2)), axis=1, kind="stable")[:, :m]
    out = np.where(np.take_along_axis(usable, rank, 1), np.take_along_axis(ids, rank, 1), -1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1).astype(np.int32)


def _links(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each query links to each vector, by brute force; at the very limit by the sum that ``hits`` takes."""
    sims = q @ x.T
    near = sims >= COSINE
    i, j = np.nonzero(np.abs(sims - COSINE) < 1e-9)
    for a in range(0, len(i), 1 << 16):
        qi, nj = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        near[qi, nj] = np.einsum("ij,ij->i", q[qi], x[nj]) >= COSINE
    return near


def lowest_recall(want: np.ndarray, got: np.ndarray) -> float:
    """Vectors are grouped by the power of two of their links; the lowest mean of their recalls."""
    some = want > 0
    share, band = got[some] / want[some], np.floor(np.log2(want[some]))
    return min((float(share[band == b].mean()) for b in np.unique(band)), default=1.0)


@dataclass
class Graph:
    """One shard: normalised vectors, their ids and weights, links per layer (layer 0 first), own components."""

    x: np.ndarray
    uid: np.ndarray
    weight: np.ndarray
    links: list[np.ndarray]
    root: np.ndarray
    beam: int = BEAM

    def __post_init__(self) -> None:
        self.x32 = self.x.astype(np.float32)

    @classmethod
    def build(cls, x: np.ndarray, uid: np.ndarray, weight: np.ndarray) -> Graph:
        n = len(x)
        rng = np.random.default_rng(n)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
        # nodes of upper layers go in first, so node 0 is the entry of all layers
        order = np.lexsort((rng.random(n), -level))
        x, uid, weight, level = x[order], uid[order], weight[order], level[order]
        links = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(int(level[0]) + 1)]
        graph = cls(x, uid, weight, links, uid.copy())
        lo = 1
        while lo < n:
            hi = min(n, lo + min(lo, BLOCK))
            graph._insert(lo, hi, level)
            lo = hi
        return graph

    def _insert(self, lo: int, hi: int, level: np.ndarray) -> None:
        q, entry = self.x32[lo:hi], np.zeros((hi - lo, 1), dtype=np.int32)
        own = np.arange(lo, hi)
        mates = q @ q.T
        np.fill_diagonal(mates, -np.inf)
        for k in range(len(self.links) - 1, -1, -1):
            joins = level[lo:hi] >= k
            ef = BUILD_BEAM if joins.any() else 4
            ids, sims = _beam(self.x32[:lo], self.links[k][:lo], q, entry, ef)
            if joins.any():
                near = np.where(joins[None, :], mates, -np.inf)[joins]
                top = _top(near, 2 * LINKS)
                cand = np.concatenate([ids[joins], lo + top], axis=1)
                cand_sims = np.concatenate([sims[joins], np.take_along_axis(near, top, 1)], axis=1)
                cand, cand_sims = np.where(cand < 0, 0, cand), np.where(cand < 0, -np.inf, cand_sims)
                chosen = _select(self.x32, cand, cand_sims, LINKS)
                self.links[k][own[joins], :LINKS] = chosen
                i, j = np.nonzero(chosen >= 0)
                self._link_back(k, chosen[i, j], own[joins][i])
            best = np.take_along_axis(ids, np.argsort(-sims, axis=1)[:, :4], 1)
            entry = np.where(best < 0, 0, best)

    def _link_back(self, k: int, to: np.ndarray, new: np.ndarray) -> None:
        links = self.links[k]
        order = np.lexsort((-np.einsum("ij,ij->i", self.x32[to], self.x32[new]), to))
        to, new = to[order], new[order]
        target, start, count = np.unique(to, return_index=True, return_counts=True)
        # the nearest of very many new neighbours; the rest have links of their own
        place = np.arange(len(to)) - np.repeat(start, count)
        row = np.repeat(np.arange(len(target)), count)
        use = place < 2 * links.shape[1]
        fresh = np.full((len(target), int(place[use].max()) + 1), -1, dtype=np.int32)
        fresh[row[use], place[use]] = new[use]
        cand = np.sort(np.concatenate([links[target], fresh], axis=1), axis=1)
        bad = cand < 0
        bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
        sims = np.einsum("ijk,ik->ij", self.x32[np.where(bad, 0, cand)], self.x32[target])
        links[target] = _select(self.x32, np.where(bad, 0, cand), np.where(bad, -np.inf, sims), links.shape[1])

    def hits(self, q: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs with at least the cosine.

        A beam that comes back full of hits is widened to the whole shard: shards are bounded, and one matrix product over
        all of it costs less than the next wider beam.  Small shards are looked at whole from the start, for the same reason.
        """
        n = len(self.x)
        for lo in range(0, len(q), BLOCK):
            rows, whole = np.arange(lo, min(lo + BLOCK, len(q))), beam * SCAN >= n
            while len(rows):
                part = q[rows].astype(np.float32)
                if whole:
                    sims = part @ self.x32.T
                    i, j = np.nonzero(sims >= COSINE - MARGIN)
                    near = sims[i, j]
                    full = np.zeros(len(rows), dtype=bool)
                else:
                    entry = np.zeros((len(rows), 1), dtype=np.int32)
                    for links in self.links[:0:-1]:
                        entry, _ = _beam(self.x32, links, part, entry, 4)
                        entry = np.where(entry < 0, 0, entry)
                    ids, sims = _beam(self.x32, self.links[0], part, entry, beam)
                    hit = sims >= COSINE - MARGIN
                    full = hit.sum(axis=1) * 2 >= beam
                    i, at = np.nonzero(hit & ~full[:, None])
                    j, near = ids[i, at], sims[i, at]
                i = rows[i]
                doubtful = near < COSINE + MARGIN
                yield i[~doubtful], j[~doubtful]
                i, j = i[doubtful], j[doubtful]
                for a in range(0, len(i), 1 << 16):
                    qi, nj = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                    good = np.einsum("ij,ij->i", q[qi], self.x[nj]) >= COSINE
                    yield qi[good], nj[good]
                rows, whole = rows[full], True

    def settle(self) -> None:
        """Widen the first beam until sampled members find what brute force finds; join own components."""
        own = np.arange(0, len(self.x), max(1, len(self.x) // 64))[:64]
        sample = self.x[own]
        near = _links(sample, self.x)
        near[np.arange(len(own)), own] = False
        want = near.sum(axis=1)
        while self.beam < len(self.x):
            got = np.zeros(len(own), dtype=np.int64)
            for i, j in self.hits(sample, self.beam):
                got += np.bincount(i[j != own[i]], minlength=len(own))
            if lowest_recall(want, got) >= RECALL:
                break
            self.beam *= 2
        parent = np.arange(len(self.x))
        for i, j in self.hits(self.x, self.beam):
            while len(i):
                a, b = _find(parent, i), _find(parent, j)
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        self.root = self.uid[_find(parent, np.arange(len(self.x)))]

    def dump(self) -> bytes:
        out = io.BytesIO()
        layers = {f"links{k}": v for k, v in enumerate(self.links)}
        np.savez(out, x=self.x, uid=self.uid, weight=self.weight, root=self.root, beam=np.array(self.beam), **layers)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        f = np.load(io.BytesIO(data))
        layers = [f[f"links{k}"] for k in range(sum(name.startswith("links") for name in f.files))]
        return cls(f["x"], f["uid"], f["weight"], layers, f["root"], int(f["beam"]))


def _find(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    while True:
        up = parent[nodes]
        if (up == nodes).all():
            return nodes
        parent[nodes] = parent[up]
        nodes = up


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of tiny components must not vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("uid")
    graph = Graph.build(_unit(group["vector"]), group["uid"].to_numpy(), group["copies"].to_numpy())
    graph.settle()
    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "graph": [graph.dump()]})


def _search(folder: str, factor: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, graph = None, None
        fs, base = open_store(folder)
        for batch in batches:
            for shard, rows in batch.groupby("to"):
                if held != shard:
                    if fs.get_file_info(f"{base}/part={shard}").type == FileType.NotFound:
                        continue  # no vector fell into this shard
                    found = pq.read_table(f"{base}/part={shard}", filesystem=fs, columns=["graph"])
                    held, graph = shard, Graph.load(found.column("graph")[0].as_py())
                q, own = _unit(rows["vector"]), rows["uid"].to_numpy()
                links, near = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
                order = np.argsort(graph.uid)
                at = order[np.minimum(np.searchsorted(graph.uid[order], own), len(order) - 1)]
                here = np.flatnonzero(graph.uid[at] == own)
                names, root_at = np.unique(graph.root, return_inverse=True)
                roots = [here * len(names) + root_at[at[here]]]
                for i, j in graph.hits(q, graph.beam * factor):
                    other = graph.uid[j] != own[i]
                    i, j = i[other], j[other]
                    # weights are whole numbers, their sums exact below 2 ** 53
                    links += np.bincount(i, graph.weight[j], minlength=len(rows)).astype(np.int64)
                    near += np.bincount(i, minlength=len(rows))
                    roots.append(np.unique(i * len(names) + root_at[j]))
                pairs = np.unique(np.concatenate(roots))
                ends = np.searchsorted(pairs, np.arange(len(rows) + 1) * len(names))
                lists = [names[pairs[a:b] % len(names)].tolist() for a, b in zip(ends[:-1], ends[1:])]
                out = pd.DataFrame({"uid": own, "links": links, "near": near, "roots": lists})
                yield out[out["links"] > 0]

    return run


def _ask(vectors: DataFrame, shards: int, folder: str, factor: int, blocks: int) -> DataFrame:
    """Every vector asks every shard of its length: (uid, links, near, roots); ``near`` leaves copies out."""
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = vectors.select("uid", "vector", (F.size("vector") * shards).alias("from"), every.alias("k"))
    asked = asked.select("uid", "vector", (F.col("from") + F.col("k")).alias("to"), F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    asked = asked.repartition(shards * blocks, "to", "block").sortWithinPartitions("to")
    return asked.drop("block").mapInPandas(_search(folder, factor), "uid long, links long, near long, roots array<long>")


def _truth(vectors: DataFrame, audited: DataFrame) -> dict[int, int]:
    """Other vectors each audited one links to, by looking at all of them; the audited ones are few."""
    asked = audited.select("uid", "vector").toPandas()
    by_size = {k: g for k, g in asked.groupby(asked["vector"].map(len))}
    packed = {k: (g["uid"].to_numpy(), _unit(g["vector"])) for k, g in by_size.items()}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, rows in batch.groupby(batch["vector"].map(len)):
                if size in packed:
                    ids, q = packed[size]
                    near = _links(q, _unit(rows["vector"])) & (ids[:, None] != rows["uid"].to_numpy())
                    yield pd.DataFrame({"uid": ids, "n": near.sum(axis=1)})

    found = vectors.select("uid", "vector").mapInPandas(look, "uid long, n long").groupBy("uid").agg(F.sum("n").alias("n"))
    return {r["uid"]: r["n"] for r in found.collect()}


def shard_rows(dimension: int) -> int:
    """Vectors of a shard: bounded in number and in bytes."""
    return max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * max(dimension, 1))))


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    return audited_near_vectors(rows, vec_id, embedding)[0]


def audited_near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, float]:
    """The rows of :func:`near_vectors`, and the recall its audit measured (of the worst stratum of links)."""
    spark = rows.sparkSession
    named = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("vector"))
    good = named.where(usable(F.col("vector")))
    vectors = good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    vectors = stored(vectors.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    held = shard_rows(longest or 1)
    shards = max(1, -(-n // held))
    shard = F.size("vector") * shards + F.pmod(F.xxhash64("uid"), F.lit(shards))
    folder = new_path(spark, "graphs")
    built = vectors.select("uid", "vector", "copies", shard.cast("int").alias("shard")).groupBy("shard")
    built = built.applyInPandas(_build, "shard int, graph binary").withColumn("part", F.col("shard"))
    built.write.partitionBy("part").parquet(folder)
    folder = qualified(spark, folder)
    audited = stored(vectors.orderBy(F.xxhash64("uid", F.lit(1)), "uid").limit(AUDITED), "audited")
    truth, factor, recall = _truth(vectors, audited), 1, 1.0
    want = np.array(list(truth.values()))
    while truth:
        found = _ask(audited, shards, folder, factor, 1).groupBy("uid").agg(F.sum("near").alias("n"))
        got = {r["uid"]: r["n"] for r in found.collect()}
        recall = lowest_recall(want, np.array([got.get(uid, 0) for uid in truth]))
        if recall >= RECALL:
            break
        if factor * BEAM * SCAN >= held:
            raise RuntimeError(f"recall {recall} although every shard was looked at whole")
        factor *= 2
    asked = stored(_ask(vectors, shards, folder, factor, max(1, -(-n // QUERY_ROWS))), "asked")
    links = asked.groupBy("uid").agg(F.sum("links").alias("links"))
    edges = asked.select(F.col("uid").alias("a"), F.explode("roots").alias("b"))
    grouped = components(edges).select(F.col("node").alias("uid"), "root")
    known = vectors.join(grouped, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(ids, "root").join(links, "uid", "left")
    others = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    known = stored(known.select("vector", others.alias("n_links"), "component_id"), "known")
    linked = good.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = named.where(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), recall
