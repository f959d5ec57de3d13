"""Words of a column of texts as positions in one byte buffer, for operators that work on Arrow batches.

White space is ASCII, so words can be found in UTF-8 bytes without decoding. Texts are taken in slices of about
SLICE_BYTES; a longer text comes in several that overlap by a given number of words, so that working memory follows the
slice and the longest word, neither the batch nor the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
BLANK = 0x20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


@dataclass
class Words:
    """Words of texts first.. of a batch: text holds them with one blank after each; starts and ends are positions in
    text, doc the number of the text (counted from 0 in this slice) and bounds the number of its first word. A slice of a
    long text holds nothing else: base is the number that its first word has in the text, more whether the text goes on."""

    first: int
    n_docs: int
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    base: int = 0
    more: bool = False


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most SLICE_BYTES together, or of one text."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def pieces(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts take about `size` bytes, or are one text."""
    _, at = buffers(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _words(part: np.ndarray, heads: np.ndarray, lower: bool) -> tuple[np.ndarray, ...]:
    """Of texts that begin at heads (and end at the last of them): the words with one blank after each, where words begin
    there, and where they begin in part."""
    space = _SPACE[part]
    before = np.empty_like(space)
    after = np.empty_like(space)
    if len(part):
        before[0], before[1:] = True, space[:-1]
        after[-1], after[:-1] = True, space[1:]
        inner = heads[heads < len(part)]
        before[inner] = True
        after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    sizes = ends - starts + 1
    out = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    take = np.arange(out[-1]) + np.repeat(starts - out[:-1], sizes)
    np.minimum(take, max(len(part) - 1, 0), out=take)
    text = part[take]
    text[out[1:] - 1] = BLANK
    return _LOWER[text] if lower else text, out, starts


def _blank_from(part: np.ndarray, at: int) -> int:
    """Where the next white space is, or the end."""
    step = 1 << 12
    while at < len(part):
        found = np.flatnonzero(_SPACE[part[at : at + step]])
        if len(found):
            return at + int(found[0])
        at, step = at + step, 2 * step
    return len(part)


def _long(first: int, part: np.ndarray, lower: bool, overlap: int) -> Iterator[Words]:
    """One text in slices of more than `overlap` words (the last may have fewer), each beginning with the last `overlap`
    words of the one before."""
    at, base, step = 0, 0, SLICE_BYTES
    while True:
        end = _blank_from(part, at + step)
        text, out, starts = _words(part[at:end], np.array([0, end - at]), lower)
        n, more = len(starts), end < len(part)
        if more and n <= overlap:
            step *= 2
            continue
        yield Words(first, 1, text, out[:-1], out[1:] - 1, np.zeros(n, dtype=np.int64), np.array([0, n]), base, more)
        if not more:
            return
        at, base, step = int(at + starts[n - overlap]) if overlap else end, base + n - overlap, SLICE_BYTES


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool = False, overlap: int = 0) -> Iterator[Words]:
    data, at = buffers(column)
    for a, b in slices(at):
        part = data[at[a] : at[b]]
        if len(part) > SLICE_BYTES:
            yield from _long(a, part, lower, overlap)
            continue
        heads = at[a : b + 1] - at[a]
        text, out, starts = _words(part, heads, lower)
        bounds = np.searchsorted(starts, heads)
        doc = np.repeat(np.arange(b - a), np.diff(bounds))
        yield Words(a, b - a, text, out[:-1], out[1:] - 1, doc, bounds)


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        factors = np.full(max(n, SLICE_BYTES) + 1, base, dtype=np.uint64)
        factors[0] = 1
        _powers[name] = np.cumprod(factors)
    return _powers[name]


class Hashes:
    """Hashes of any stretches of a buffer: equal stretches hash alike wherever they stand."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        power = _power("up", _BASE, n)[:n]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(power * (text.astype(np.uint64) + np.uint64(1)), out=self.sums[1:])
        self.back = _power("down", pow(_BASE, -1, 1 << 64), n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))
