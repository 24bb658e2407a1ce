"""Hashed words and shingles of whole Arrow batches, in numpy.

Words are runs of anything but the six ASCII blanks.  A word's hash is a polynomial in
its bytes, read off prefix sums, so no Python object is made per word.  Texts are taken in
pieces of half a MB, cut between words, so memory stays bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 512 << 10
_P = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NO_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P ** i and its inverse modulo 2 ** 64 for i < n."""
    up, down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
    inverse = pow(_P, -1, 1 << 64)
    while len(up) < n:
        k = len(up)
        up = np.concatenate([up, up * np.uint64(pow(_P, k, 1 << 64))])
        down = np.concatenate([down, down * np.uint64(pow(inverse, k, 1 << 64))])
    return up, down


class Hasher:
    """Word hashes of a byte array; keeps its tables between calls.

    With ``plain`` words are runs of letters and digits, in lower case (ASCII and Latin-1 letters).
    """

    def __init__(self, plain: bool = False) -> None:
        self.up, self.down = _powers(PIECE_BYTES + 1)
        self.plain = plain

    def words(self, data: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
        """(hash, start) of every word, and hashes of the words cut to so many bytes."""
        if len(data) + 1 > len(self.up):
            self.up, self.down = _powers(len(data) + 1)
        if self.plain:
            upper = np.zeros(len(data), dtype=bool)
            upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            data = np.where(upper, data + np.uint8(0x20), _LOWER[data])
        inner = ~(_NO_WORD if self.plain else _BLANK)[data]
        edge = np.diff(inner.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])

        def cut(stop: np.ndarray) -> np.ndarray:
            length = (stop - start).astype(np.uint64)
            return mix64((sums[stop] - sums[start]) * self.down[start] + length * np.uint64(_P))

        return cut(end), start, [cut(np.minimum(end, start + k)) for k in prefixes]


def _safe_cut(data: np.ndarray, at: int) -> int:
    """The last place at or before ``at`` that follows a blank; else the first after it."""
    lo = max(0, at - (1 << 16))
    blanks = np.flatnonzero(_BLANK[data[lo:at]])
    if len(blanks):
        return lo + int(blanks[-1]) + 1
    step = at
    while step < len(data):
        blanks = np.flatnonzero(_BLANK[data[step : step + PIECE_BYTES]])
        if len(blanks):
            return step + int(blanks[0]) + 1
        step += PIECE_BYTES
    return len(data)


def text_pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets): runs of whole texts, or parts of one long text.

    A null text has no bytes.  All parts of a long text but the last end after a blank.
    """
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1
        stop = max(row + 1, min(stop, len(column)))
        lo, hi = int(offsets[row]), int(offsets[stop])
        if hi - lo <= PIECE_BYTES:
            yield row, stop, data[lo:hi], offsets[row : stop + 1] - lo
        else:
            text, at = data[lo:hi], 0
            while at < len(text):
                end = len(text) if len(text) - at <= PIECE_BYTES else _safe_cut(text, at + PIECE_BYTES)
                yield row, row + 1, text[at:end], np.array([0, end - at])
                at = end
        row = stop


def doc_words(column: pa.Array, hasher: Hasher, prefixes: tuple[int, ...] = ()) -> Iterator[tuple]:
    """(first row, rows, word hashes, row of each word from 0, prefix hashes) of pieces; a long text spans several."""
    for first, stop, data, offsets in text_pieces(column):
        # texts follow one another without a blank: split words at text ends
        hashes, start, cut = _with_borders(hasher, data, offsets, prefixes)
        owner = np.searchsorted(offsets, start, side="right") - 1
        yield first, stop - first, hashes, owner, cut


def _with_borders(hasher: Hasher, data: np.ndarray, offsets: np.ndarray, prefixes) -> tuple:
    """Like ``Hasher.words``, with a blank put between texts; starts refer to ``data``."""
    if len(offsets) == 2:
        return hasher.words(data, prefixes)
    n = len(offsets) - 1
    spaced = np.full(len(data) + n, 0x20, dtype=np.uint8)
    shift = np.repeat(np.arange(n), np.diff(offsets))
    spaced[np.arange(len(data)) + shift] = data
    hashes, start, cut = hasher.words(spaced, prefixes)
    at = np.searchsorted(offsets[1:-1] + np.arange(1, n), start, side="right")
    return hashes, start - at, cut


_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(hashes: np.ndarray, owner: np.ndarray, rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` words of a text; fewer words make one shingle."""
    n = len(hashes)
    if n >= width:
        total = np.zeros(n - width + 1, dtype=np.uint64)
        for k in range(width):
            total += hashes[k : n - width + 1 + k] * _MULTIPLIERS[k]
        whole = owner[: n - width + 1] == owner[width - 1 :]
        out, of = mix64(total[whole]), owner[: n - width + 1][whole]
    else:
        out, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=owner.dtype)
    counts = np.bincount(owner, minlength=rows)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(owner, short)
        more = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            more[has] += hashes[first[has] + k] * _MULTIPLIERS[k]
        out = np.concatenate([out, mix64(more + counts[short].astype(np.uint64))])
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of
