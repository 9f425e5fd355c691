"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words of a text with smallest period q and
length >= max(``min_length``, ``min_exponent`` * q) that no neighbouring word
extends keeping that period.

The dictionary names, for each power of two b, the factors (stretches of b
words) of a text: equal names, equal words. Names of length 2b are pairs of
names of length b. A factor that occurs once has no longer repetition, so only
the repeated ones go on to the next level; in plain prose few do.

Two occurrences of a factor inside twice its length start d <= b words apart,
and such successors form arithmetic progressions of one difference, the
smallest period of the stretch they cover. A run with period q holds, for the
power of two b with q <= b < 2q, at each of its words up to the last b + q a
factor whose successor lies exactly q further (a nearer one would give the run
a smaller period), and the factor at the word before the run has none there.
So progressions of one difference that begin at neighbouring words are
the same run: the first and the last of them give its maximal extent, which
extends and deduplicates the proposals at once. For runs of short period, b is
held at the largest power of two of which two fit into ``min_length``.

A text is worked on in one task, texts in groups of bounded size; there is no
shuffle, and names are exact (no hashes of words).

Defined results: a null, empty or blank text has no words and no runs;
repeated rows are judged one by one; a text is never cut, so the memory of a
task grows with its longest text; columns of the input that are named like the
new ones are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordlists import groups, word_lists

MIN_LENGTH, MIN_EXPONENT = 24, 3
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
MADE = {"n_words": T.LongType(), "runs": T.ArrayType(RUN, False), "collapsed": T.StringType()}


def _repeated(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key occurs more than once, and names of the keys."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    kept = counts[names] > 1
    return places[kept], names[kept]


def _doubled(places: np.ndarray, names: np.ndarray, size: int, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeated factors of twice ``size``; ``stop``: end of each place's text."""
    fits = places + 2 * size <= stop[places]
    left, own = places[fits], names[fits]
    at = np.searchsorted(places, left + size)
    at[at == len(places)] = 0
    whole = places[at] == left + size if len(places) else np.zeros(0, bool)
    left, own, other = left[whole], own[whole], names[at[whole]]
    return _repeated(left, own * (int(names.max()) + 1 if len(names) else 1) + other)


def _progressions(places: np.ndarray, names: np.ndarray, size: int, least: int) -> tuple[np.ndarray, ...]:
    """(start, length, period) of the stretches that neighbouring progressions
    of successors ``least`` .. ``size`` words apart cover."""
    order = np.argsort(names, kind="stable")
    at, name = places[order], names[order]
    gap = np.diff(at)
    near = (name[1:] == name[:-1]) & (gap >= least) & (gap <= size)
    start, gap = at[:-1][near], gap[near]
    order = np.lexsort((start, gap))
    start, gap = start[order], gap[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (gap[1:] != gap[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last] - start[first] + size + gap[first] if len(first) else gap[first], gap[first]


def find_runs(codes: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; the words of
    text i are ``codes[bounds[i]:bounds[i+1]]`` and starts count from ``codes[0]``."""
    if min_exponent < 3 or min_length < 2:
        raise ValueError("runs need an exponent of 3 and a length of 2 at least")
    sizes = np.diff(bounds)
    text, stop = np.repeat(np.arange(len(sizes)), sizes), np.repeat(bounds[1:], sizes)
    base = 1 << ((min_length // 2).bit_length() - 1)
    found = []
    size = 1
    places, names = _repeated(np.arange(len(codes)), text * (int(codes.max()) + 1 if len(codes) else 1) + codes)
    while len(places):
        if size >= base:
            found.append(_progressions(places, names, size, 1 if size == base else size // 2 + 1))
        places, names = _doubled(places, names, size, stop)
        size *= 2
    start, length, period = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3))
    kept = length >= np.maximum(min_length, min_exponent * period)
    start, length, period = start[kept], length[kept], period[kept]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _judged(col: pa.Array, min_length: int, min_exponent: int) -> list[pa.Array]:
    words, bounds = word_lists(col)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, length, period = find_runs(codes, bounds, min_length, min_exponent)
    owner = np.searchsorted(bounds, start, "right") - 1
    # words after the first period of a run that holds them are dropped
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    left = np.concatenate([[0], np.cumsum(kept)])[bounds]
    lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept)))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
    ends = np.searchsorted(owner, np.arange(len(bounds)))
    each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - bounds[owner], length, period)],
                                      fields=[pa.field(c, pa.int64(), False) for c in RUN.names])
    runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
    return [pa.array(np.diff(bounds), pa.int64()), runs, collapsed]


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start,
    then period) and ``collapsed``: the words that no run holds after its first
    period, joined by one space."""
    kept = [c for c in docs.columns if c not in MADE]
    schema = T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(c, t) for c, t in MADE.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.num_columns - 1)
            for lo, hi in groups(col):
                s = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*s.columns[:-1], *_judged(s.column(s.num_columns - 1), min_length, min_exponent)], schema.names)

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)
