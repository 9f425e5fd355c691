"""Words of a batch of texts as one Arrow array, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SPACE_BYTES, text_buffers

#: Texts handled together hold about so many bytes; a longer one is handled alone.
GROUP_BYTES = 1 << 22


def groups(col: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows ``lo..hi`` of at most ``limit`` bytes of text, one row at least."""
    offsets, _ = text_buffers(col)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi
        lo = hi


def split_words(part: np.ndarray, cuts: np.ndarray, spaces: bytes = SPACE_BYTES
                ) -> tuple[pa.Array, np.ndarray]:
    """(words, first byte of each) of the UTF-8 bytes ``part``: stretches
    without ``spaces`` that no ``cuts`` (where texts begin) lie in."""
    n = len(part)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    white = np.zeros(256, bool)
    white[list(spaces)] = True
    inside = ~white.take(part)
    fresh = np.zeros(n + 1, bool)
    fresh[cuts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:n]
    starts = np.flatnonzero(first)
    taken = np.zeros(n + 1, np.int64)
    np.cumsum(inside, out=taken[1:])
    offsets = np.append(taken[starts], taken[n])
    data = np.ascontiguousarray(part[inside])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), starts


def word_lists(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all rows, bounds: row i has words ``bounds[i]:bounds[i+1]``);
    a null has none."""
    offsets, data = text_buffers(col)
    first, last = int(offsets[0]), int(offsets[-1])
    words, starts = split_words(data[first:last], offsets[:-1] - first)
    return words, np.searchsorted(starts, offsets - first)
