"""Alignment of the tokens of two tokenizers, in Arrow tables inside tasks.

Both token lists of a batch are flattened with the row of each token, byte ends are cumulative
sums segmented by text, and a hash join on (text, end) finds the ends both sides share.  They cut a text
into groups.  Linked id pairs are counted by ``Table.group_by`` in each task, Spark merges the partial
counts.  Of two tokens that end together one is a suffix of the other, so there are no more different pairs than
the tokens of both vocabularies have bytes: the merged counts are small however large the corpus, and every
task gets them whole.

Texts are tokenised once; what is stored of a text are its figures and its linked ids.  Tokenizer files are read through Spark and
go to tasks with the function, so workers need no copy.  Neither tokenizer joins a word to a space after it (both vocabularies are
looked at for that), so words are tokenised one by one and those met before are remembered.  The byte-level side runs in ``tiktoken`` where the file's ids are in
the order of its merges, which makes them ranks (its ids are those of ``tokenizers``, several times as fast); else in ``tokenizers``.

Defined cases: a null or empty text, and one whose tokens don't spell a space and the text, has no tokens: zeros, and an
empty ``groups_sha256``; strings of special tokens in a text are plain text; repeated rows and null ids stay rows of
their own, all counted; an empty table gives no rows; other columns, whatever their names, are not looked at.  A text is
tokenised whole: a task holds one text and its tokens at least, other texts in slices of ``SLICE_BYTES``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import stored

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_BYTES = 1 << 20
KNOWN_WORDS = 120_000  # a task remembers the tokens of so many words
SLICE_LINKS = 1 << 18
MERGED_ROWS = 1 << 19  # partial counts of a task are merged when there are so many
# a word with the white space before it, cut where a space follows what is none; white space at the end belongs to the last one
_WORDS = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?|\s+\Z")
# fixed value: how byte-level BPE cuts a text before merging
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """Letter of the byte-level alphabet to its byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class ByteLevel:
    """The byte-level tokenizer of a ``tokenizers`` file."""

    source: str
    tokens: list[bytes] = field(init=False)
    ranked: bool = field(init=False)

    def __post_init__(self) -> None:
        spec, letters = json.loads(self.source), _byte_alphabet()
        vocab = dict(spec["model"]["vocab"])
        size = max([*vocab.values(), *[t["id"] for t in spec.get("added_tokens") or []]]) + 1
        self.tokens = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        for token, i in special.items():
            self.tokens[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        products = [vocab[a + b] for a, b in pairs]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = set(special.values())
        self.ranked = bool(plain) and products == sorted(products) and len(vocab) - len(products) - 256 <= len(self.special)

    def encoder(self):
        if self.ranked:
            import tiktoken

            ranks = {t: i for i, t in enumerate(self.tokens) if i not in self.special and t}
            own = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [_packed(own.encode_ordinary(t)) for t in texts]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        other = Tokenizer.from_str(self.source)
        other.encode_special_tokens = True
        return lambda texts: [_packed(e.ids) for e in other.encode_batch(texts, add_special_tokens=False)]


@dataclass
class Pieces:
    """The tokenizer of a ``sentencepiece`` model; it puts the space before a text itself."""

    source: bytes
    tokens: list[bytes] = field(init=False)
    by_word: bool = field(init=False)  # no piece goes from a word into the next space

    def __post_init__(self) -> None:
        model = self._model()
        self.tokens = [self._bytes(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
        self.by_word = not any(re.search(rb"[^ ] ", t) for t in self.tokens)

    def _model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.source)

    @staticmethod
    def _bytes(piece: str, is_byte: bool) -> bytes:
        if is_byte:
            return bytes([int(re.fullmatch("<0x([0-9A-F]{2})>", piece).group(1), 16)])
        return piece.replace("▁", " ").encode()

    def encoder(self):
        model = self._model()
        # the space that starts every text is the one the model adds
        return lambda texts: [_packed(ids) for ids in model.encode([t[1:] for t in texts], num_threads=1)]


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


def read_file(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def load(spark: SparkSession, folder: str = TOKENIZERS) -> tuple[ByteLevel, Pieces]:
    byte_level = ByteLevel(read_file(spark, f"{folder}/{BYTE_LEVEL}").decode())
    return byte_level, Pieces(read_file(spark, f"{folder}/{PIECES}"))


def _lists(rows: list[bytes]) -> pa.LargeListArray:
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def _only(lists: pa.LargeListArray, good: np.ndarray) -> pa.LargeListArray:
    """Nothing in the rows that aren't good."""
    lengths = np.diff(lists.offsets.to_numpy())
    ends = np.cumsum(np.r_[0, np.where(good, lengths, 0)])
    return pa.LargeListArray.from_arrays(pa.array(ends), lists.flatten().filter(pa.array(np.repeat(good, lengths))))


class _Side:
    """Vocabulary of one side as Arrow arrays, and the tokens of words met."""

    def __init__(self, tokenizer: ByteLevel | Pieces) -> None:
        self.encode = tokenizer.encoder()
        self.tokens = pa.array(tokenizer.tokens, pa.large_binary())
        self.lengths = pc.binary_length(self.tokens)
        self.names = pa.array([str(i) for i in range(len(self.tokens))], pa.large_string())
        self.known: dict[str, bytes] = {}

    def lists(self, words: list[str], at: pa.Array, offsets: np.ndarray) -> pa.LargeListArray:
        """Tokens of texts, which are the words ``at`` of a list, cut at ``offsets``."""
        new = [w for w in words if w not in self.known]
        found = dict(zip(new, self.encode(new)))
        by_word = _lists([found[w] if w in found else self.known[w] for w in words])
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {}
        self.known.update(found)
        taken = by_word.take(at)
        ends = taken.offsets.to_numpy()
        return pa.LargeListArray.from_arrays(pa.array(ends[offsets] - ends[0]), taken.flatten())

    def spells(self, lists: pa.LargeListArray, wanted: pa.Array) -> np.ndarray:
        spelt = pa.LargeListArray.from_arrays(lists.offsets, self.tokens.take(lists.values))
        return pc.equal(pc.binary_join(spelt, pa.scalar(b"", pa.large_binary())), wanted).to_numpy(zero_copy_only=False)

    def ends(self, lists: pa.LargeListArray) -> pa.Table:
        """(doc, end, at) of every token: its text, its end in bytes from the start of the text, its place among all tokens."""
        ids, doc = lists.flatten(), pc.list_parent_indices(lists)
        running = pc.cumulative_sum(self.lengths.take(ids).cast(pa.int64()))
        before = pa.concat_arrays([pa.array([0], pa.int64()), running]).take(lists.offsets)
        end = pc.subtract(running, before.take(doc))
        return pa.table({"doc": doc, "end": end, "at": pa.array(np.arange(len(ids), dtype=np.int32))})


def _cut(names: pa.Array, last: np.ndarray) -> pa.Array:
    """Names joined by commas in runs that end where ``last`` says."""
    offsets = pa.array(np.r_[0, np.flatnonzero(last) + 1], pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, names), pa.scalar(",", pa.large_string()))


def _words(texts: list[str], by_word: bool) -> tuple[list[str], pa.Array, np.ndarray]:
    """(different words, word at every place, offset of every text); a space stands before every text."""
    index: dict[str, int] = {}
    at: list[int] = []
    offsets = [0]
    for text in texts:
        words = _WORDS.findall(" " + text) if by_word else [" " + text]
        at += [index.setdefault(w, len(index)) for w in words]
        offsets.append(len(at))
    return list(index), pa.array(np.array(at, dtype=np.int64)), np.array(offsets)


def _pack(ids: np.ndarray, offsets: np.ndarray, kind: str) -> pa.Array:
    """The ids of each row as bytes, which Spark passes on without looking at single ones."""
    packed = ids.astype(kind)
    ends = pa.py_buffer((offsets * packed.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, pa.py_buffer(packed)])


def _unpack(column: pa.Array, kind: str) -> pa.LargeListArray:
    """Lists of ids over the bytes of a binary column."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    raw = column.buffers()[2]
    data = np.frombuffer(raw if raw is not None else b"", dtype=kind, count=int(ends[-1]) // width)
    return pa.LargeListArray.from_arrays(pa.array(ends // width), pa.array(data).cast(pa.int32()))


def id_kind(byte_level: ByteLevel, pieces: Pieces) -> str:
    """The narrowest type that holds the ids of both."""
    return "<u2" if max(len(byte_level.tokens), len(pieces.tokens)) <= 1 << 16 else "<i4"


def _aligned(texts: list[str], a: _Side, b: _Side, by_word: bool, kind: str) -> dict[str, pa.Array]:
    """Figures and linked ids of some texts; none of them null."""
    n = len(texts)
    wanted = pa.array([b" " + t.encode() for t in texts], pa.large_binary())
    words = _words(texts, by_word)
    lists_a, lists_b = a.lists(*words), b.lists(*words)
    good = a.spells(lists_a, wanted) & b.spells(lists_b, wanted) & np.array([t != "" for t in texts])
    if not good.all():
        lists_a, lists_b = _only(lists_a, good), _only(lists_b, good)
    # no token is empty, so an end is one token's: a link is one row of the join
    ends_a, ends_b = a.ends(lists_a).rename_columns(["doc", "end", "at_a"]), b.ends(lists_b).rename_columns(["doc", "end", "at_b"])
    links = ends_a.join(ends_b, keys=["doc", "end"], join_type="inner", use_threads=False)
    last_a, last_b = np.zeros(len(ends_a), dtype=bool), np.zeros(len(ends_b), dtype=bool)
    last_a[links["at_a"].to_numpy()] = True
    last_b[links["at_b"].to_numpy()] = True
    ids_a, ids_b = lists_a.flatten(), lists_b.flatten()
    # the last tokens of a text end together, so no group reaches over two texts
    groups = pc.binary_join_element_wise(_cut(a.names.take(ids_a), last_a), _cut(b.names.take(ids_b), last_b), pa.scalar("|", pa.large_string()))
    per_doc = np.bincount(ends_a["doc"].to_numpy()[last_a], minlength=n)
    offsets = np.r_[0, np.cumsum(per_doc)]
    spelt = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), groups), pa.scalar(";", pa.large_string()))
    return {
        "n_a": pa.array(np.diff(lists_a.offsets.to_numpy()), pa.int64()),
        "n_b": pa.array(np.diff(lists_b.offsets.to_numpy()), pa.int64()),
        "n_groups": pa.array(per_doc, pa.int64()),
        "groups_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelt.to_pylist()], pa.string()),
        "a": _pack(ids_a.to_numpy()[last_a], offsets, kind),
        "b": _pack(ids_b.to_numpy()[last_b], offsets, kind),
    }


_KIND = "n_a long, n_b long, n_groups long, groups_sha256 string, a binary, b binary"


def _aligner(byte_level: ByteLevel, pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = None
        for batch in batches:
            if a is None:
                a, b = _Side(byte_level), _Side(pieces)
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            reach = np.cumsum(lengths, dtype=np.int64)
            lo = 0
            while lo < len(batch):
                before = reach[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(reach, before + SLICE_BYTES, side="right")))
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column("text").to_pylist()]
                out = {"doc_id": part.column("doc_id"), **_aligned(texts, a, b, byte_level.ranked and pieces.by_word, id_kind(byte_level, pieces))}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
                lo = hi
            pa.default_memory_pool().release_unused()
        a = b = None

    return run


def aligned(docs: DataFrame, tokenizers: tuple[ByteLevel, Pieces], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token and group figures of every text and the ids that are linked in it, written once."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return stored(rows.mapInArrow(_aligner(*tokenizers), f"doc_id long, {_KIND}"), "aligned")


def _link_tables(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.RecordBatch, pa.Table]]:
    """Rows of at most ``SLICE_LINKS`` links together, or one row, and their links as (doc, a, b)."""
    for batch in batches:
        reach = np.cumsum(pc.binary_length(batch.column("a")).to_numpy(zero_copy_only=False), dtype=np.int64) // np.dtype(kind).itemsize
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + SLICE_LINKS, side="right")))
            part = batch.slice(lo, hi - lo)
            a, b = _unpack(part.column("a"), kind), _unpack(part.column("b"), kind)
            yield part, pa.table({"doc": pc.list_parent_indices(a), "a": a.flatten(), "b": b.flatten()})
            lo = hi
        pa.default_memory_pool().release_unused()


def _counter(kind: str):
    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for _, links in _link_tables(batches, kind):
            counts = links.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
            held.append(counts.rename_columns(["a", "b", "n"]))
            if sum(map(len, held)) > MERGED_ROWS:
                held = [merged(held)]
        if held:
            yield from merged(held).to_batches()

    return run


def pair_counts(links: DataFrame, kind: str) -> DataFrame:
    """(a, b, n, best): links of every id pair over all texts, and whether no pair of its b has more."""
    counts = links.select("a", "b").mapInArrow(_counter(kind), "a int, b int, n long")
    counts = stored(counts.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def _scorer(counts: Broadcast, kind: str):
    kept = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value  # a broadcast: once a worker
        for rows, links in _link_tables(batches, kind):
            met = links.join(known, keys=["a", "b"], join_type="inner", use_threads=False)
            sums = met.group_by("doc", use_threads=False).aggregate([([], "count_all"), ("best", "sum"), ("n", "sum")])
            at = sums["doc"].to_numpy()
            found = []
            for name in ("count_all", "best_sum", "n_sum"):
                column = np.zeros(len(rows), dtype=np.int64)
                column[at] = sums[name].to_numpy()
                found.append(pa.array(column))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *found], names=[*kept, "n_links", "n_best", "count_sum"])

    return run


def align_report(docs: DataFrame, folder: str = TOKENIZERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Figures of every document's alignment and how usual its links are in the corpus."""
    spark = docs.sparkSession
    tokenizers = load(spark, folder)
    kind = id_kind(*tokenizers)
    links = aligned(docs, tokenizers, doc_id, text)
    counts = spark.sparkContext.broadcast(pair_counts(links, kind).toArrow().combine_chunks())
    columns = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    return links.mapInArrow(_scorer(counts, kind), columns)
