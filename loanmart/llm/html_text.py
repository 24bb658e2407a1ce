"""Main text of pages by a style tree of their site.

The pages of a host are merged into one tree of elements (paths of tags with class, id and role).  An element's importance has two
parts.  Presentation: the entropy of its child sequences over the pages that have it; a template looks the same
everywhere.  Content: one less the mean entropy of the texts below it, where a text on k of m pages has log k / log m;
menus and notices repeat, articles don't.  They are put together as (1 - g ** l) presentation + g ** l content with l child sequences
and g = 0.9, and branches below ``LEAST_IMPORTANCE`` are removed from every page of the host that has them.  Equal pages of a
host count once.  What markup names (nav, aside, forms, scripts, classes like ``sidebar`` or ``comments``) goes in any case,
and where a page marks its article only that is looked at: the tree prunes branches inside it that have a class, an id or a tag of
their own making; its plain paragraphs, lists and tables stay.  A page that pruning would leave without text keeps its text.

The tree is a table of sums by (host, node), never one object: rows of a hot host are added up where they are, and its pages meet the
branches to remove over several salts.  Pages are read twice, so that only hashes are shuffled; the branches to remove are stored, and
Spark broadcasts them if they are small, else it shuffles.

Defined cases: a null or empty page, or one of markup only, has an empty text; a null url, or one without ``://``, has the empty host;
an element on fewer than ``LEAST_PAGES`` different pages of its host isn't judged; no-break and other Unicode blanks are white space;
``br`` and borders of table cells are a space; repeated rows and ids are pages of their own with equal texts; other columns,
whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..scratch import stored
from .page_dom import Page, parse
from .url_filter import parts

LEAST_PAGES = 4
LEAST_IMPORTANCE = 0.4
ATTENUATION = 0.9
SALTS = 16
KNOWN = 200_000  # tags and paths a task remembers
SLICE_BYTES = 4 << 20

_BRANCHES = "host long, page long, node long, open boolean, style long, path array<long>, texts array<long>"


def _signed(data: str) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def branches(page: Page) -> dict[int, tuple[bool, int, list[int], list[int]]]:
    """node -> (may be pruned, hash of its child sequence, path, hashes of its own texts), like siblings in one; noise is left out."""
    children: dict[int, list[int]] = {}
    texts: dict[int, set[int]] = {}
    paths: dict[int, list[int]] = {}
    can: dict[int, bool] = {}
    for i, node in enumerate(page.node):
        if page.noise[i]:
            continue
        p = page.parent[i]
        if p >= 0:
            row = children.setdefault(page.node[p], [])
            if not row or row[-1] != node:
                row.append(node)
        if node not in paths:
            paths[node] = [*paths[page.node[p]], node] if p >= 0 else [node]
        can[node] = can.get(node, False) or (page.inside[i] and not page.exempt[i])
    for i, text in zip(page.block_of, page.texts):
        if not page.noise[i]:
            texts.setdefault(page.node[i], set()).add(_signed(text))
    return {
        node: (can[node], _signed(",".join(map(str, children.get(node, ())))), path, sorted(texts.get(node, ()))) for node, path in paths.items()
    }


def rendered(page: Page, pruned: set[int]) -> str:
    n = len(page.parent)
    gone = [False] * n
    if pruned:
        for i in range(n):
            p = page.parent[i]
            gone[i] = (p >= 0 and gone[p]) or (page.node[i] in pruned and page.inside[i] and not page.exempt[i])
    region = [text for i, text in zip(page.block_of, page.texts) if page.inside[i] and not page.noise[i]]
    kept = [text for i, text in zip(page.block_of, page.texts) if page.inside[i] and not page.noise[i] and not gone[i]]
    return "\n\n".join(kept or region)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    reach = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _lists(rows: list[list[int]]) -> pa.ListArray:
    return pa.array(rows, pa.list_(pa.int64()))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        for part in _slices(batch, "html"):
            if len(known) > KNOWN:
                known.clear()
            rows = []
            for host, page, html in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html"))):
                rows += [(host, page, node, *rest) for node, rest in branches(parse(html, known)).items()]
            host, page, node, can, style, path, texts = zip(*rows) if rows else ((),) * 7
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (host, page, node)), pa.array(can, pa.bool_()), pa.array(style, pa.int64()), _lists(path), _lists(texts)],
                names=["host", "page", "node", "open", "style", "path", "texts"],
            )


def importance(trees: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of every element of the sites' trees."""
    styles = trees.select("host", "node", "style", "page").distinct().groupBy("host", "node", "style").agg(F.count(F.lit(1)).alias("c"))
    shown = styles.groupBy("host", "node").agg(
        F.sum("c").alias("pages"), F.count(F.lit(1)).alias("styles"), F.sum(F.col("c") * F.log("c")).alias("c_log_c")
    )
    said = trees.where(F.size("texts") > 0)
    texts = said.select("host", "node", "page", F.explode("texts").alias("text"))
    often = texts.distinct().groupBy("host", "node", "text").agg(F.count(F.lit(1)).alias("k"))
    leaves = often.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("k")).alias("log_k"))
    # a node is the hash of its path, so any row has it
    paths = said.groupBy("host", "node").agg(F.any_value("path").alias("path"))
    below = leaves.join(paths, ["host", "node"]).select("host", F.explode("path").alias("node"), "n", "log_k")
    below = below.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("log_k").alias("log_k"))
    log_m = F.log("pages")
    presentation = (log_m - F.col("c_log_c") / F.col("pages")) / log_m
    content = 1 - F.col("log_k") / (F.col("n") * log_m)
    share = F.pow(F.lit(ATTENUATION), F.col("styles"))
    whole = F.when(F.col("pages") > 1, (1 - share) * presentation + share * content).otherwise(F.lit(1.0))
    return shown.join(below, ["host", "node"]).select("host", "node", "pages", whole.alias("importance"))


def pruned_branches(trees: DataFrame) -> DataFrame:
    """(host, page, pruned): the branches of little importance each page has."""
    low = importance(trees).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    low = low.select("host", "node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = trees.where("open").select("host", "page", "node", F.pmod("page", F.lit(SALTS)).cast("int").alias("salt"))
    return own.join(low, ["host", "node", "salt"]).groupBy("host", "page").agg(F.collect_set("node").alias("pruned"))


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        for part in _slices(batch, "html"):
            if len(known) > KNOWN:
                known.clear()
            texts = [rendered(parse(html, known), set(pruned or ())) for html, pruned in zip(part.column("html").to_pylist(), part.column("pruned").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _keyed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    named = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), text.alias("html"))
    return named.select("page_id", "url", F.xxhash64(parts(F.col("url"))[0]).alias("host"), F.xxhash64("html").alias("page"), "html")


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    keyed = _keyed(pages, page_id, url, html)
    trees = stored(keyed.select("host", "page", "html").mapInArrow(_trees, _BRANCHES), "trees")
    pruned = stored(pruned_branches(trees), "pruned")
    # the planner knows the stored size: below its limit the pages stay where they are
    known = keyed.join(pruned, ["host", "page"], "left").select("page_id", "url", "html", "pruned")
    texts = known.mapInArrow(_render, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
