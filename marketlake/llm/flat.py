"""Whole-column text arithmetic on the bytes of an Arrow string column.

A column of texts is one flat byte array with offsets, so words, lines and word windows
of thousands of texts come from a few numpy passes and no loop over words. A NULL text
counts as empty. Hashes are 64-bit polynomial hashes with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time: bounds the memory of a Python worker.
SLICE_BYTES = 2_000_000

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_WINDOW = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                    0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37],
                   dtype=np.uint64)

#: Byte classes. White space is U+0020 and U+0009 to U+000D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
CONTINUATION = np.zeros(256, dtype=bool)
CONTINUATION[0x80:0xC0] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_BYTE_LOWER = _BYTE[LOWER]
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept between calls."""
    if len(_POWERS["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"], _POWERS["down"]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of text; one longer text stays whole."""
    if not batch.num_rows:
        return
    _, at = texts(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each text starts (one more entry than texts)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, at - at[0]


class Segments:
    """Pieces [start, end) of the flat bytes, each within one text."""

    def __init__(self, start: np.ndarray, end: np.ndarray, at: np.ndarray):
        self.start, self.end = start, end
        self.doc = np.searchsorted(at, start, "right") - 1
        self.n_docs = len(at) - 1
        #: For each text the first segment (one more entry than texts).
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(flat: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Segments:
    """Maximal runs of bytes of a class; a run ends with its text."""
    inside = np.zeros(len(flat) + 2, dtype=bool)
    inside[1:-1] = kind[flat]
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[at] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Segments(start, end, at)


def lines(flat: np.ndarray, at: np.ndarray) -> Segments:
    """Lines by \\n; an empty text has one empty line, which is left out."""
    breaks = np.flatnonzero(flat == 0x0A)
    full = np.flatnonzero(np.diff(at) > 0)
    start = np.sort(np.concatenate([at[full], breaks + 1]))
    end = np.sort(np.concatenate([at[full + 1], breaks]))
    keep = start < end
    return Segments(start[keep], end[keep], at)


class Hasher:
    """Hashes of any segments of one flat byte array."""

    def __init__(self, flat: np.ndarray, lower: bool = False):
        up, self.down = _powers(len(flat))
        self.sums = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[flat] * up[: len(flat)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, seg: Segments, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n segments within a text, and the first segment of each."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = len(hashes) - n + 1
    at = np.flatnonzero(seg.doc[:size] == seg.doc[n - 1:])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        total += hashes[at + k] * (_WINDOW[k % len(_WINDOW)] + np.uint64(2 * (k // len(_WINDOW))))
    return mix(total), at


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive positions."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def fold(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash that is equal only within one text."""
    return mix(hashes ^ (doc.astype(np.uint64) * np.uint64(_P)))


def distinct(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, ascending, and where each text starts."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[keep], hashes[keep]
    return hashes, np.searchsorted(doc, np.arange(n_docs + 1))
