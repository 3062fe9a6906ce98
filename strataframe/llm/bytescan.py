"""Whole-batch scans of text columns in numpy, for use inside Arrow UDFs.

A batch of texts is cut into blocks of whole texts (about a megabyte each, so that temporary arrays stay small
whatever the batch size; a longer text is a block of its own) and scanned as one byte array with text offsets.
Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


class Block(NamedTuple):
    """Rows [first, last) of a batch; text i of the block is data[offsets[i]:offsets[i + 1]]."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Spans(NamedTuple):
    """Byte spans of words in a block, in order, with the text each belongs to."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, ends, content = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Block(row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> Spans:
    """Maximal runs of marked bytes; none crosses from one text to the next."""
    n = len(inside)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(start, offsets))
    return Spans(start, np.flatnonzero(ends) + 1, np.repeat(np.arange(len(offsets) - 1), counts))


def words(block: Block) -> Spans:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return."""
    return runs(~WHITE[block.data], block.offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit hashes over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, from one running polynomial over the block."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def window_hashes(h: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of so many words that lie in one text, with the index of their first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(text[:n] == text[width - 1 :])
    out = h[whole]
    for k in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[whole + k])
    return out, whole


def chars(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Each character's bytes as one number, and the offsets of the texts counted in characters."""
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    n = len(block.data)
    size = np.diff(np.append(lead, n))
    padded = np.concatenate([LOWER[block.data], np.zeros(3, np.uint8)]).astype(np.uint32)
    code = padded[lead]
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        code[longer] |= padded[lead[longer] + k] << np.uint32(8 * k)
    return code, np.searchsorted(lead, block.offsets)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; 0 where that is empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
