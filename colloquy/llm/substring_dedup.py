"""Removal of long passages that an earlier document holds.

A window is ``WINDOW`` consecutive words. Each word that a window covers goes
if the same window starts in a document with a smaller id. Windows are judged
on the input, so what is removed from one document doesn't save another.

The method is matching statistics against suffix automata of reference text:
the text is streamed word by word through the automaton, which gives the
length of the longest match that ends at each word; a length of a window or
more marks the window. The reference here is the corpus itself, which no
broadcast can hold, so it is cut in shards that meet the text they can match:

1. The anchor of a window is its least 16-word hash. Windows that follow each
   other share anchors, and a maximal run of them is a stretch of up to 84
   words. Equal windows have equal anchors.
2. Anchors that occur in one document only are dropped by an aggregate of
   narrow rows; from then on only stretches of repeated anchors are handled.
3. Equal stretches are one, with the least id that holds it: all windows of it
   go in every other document. Copies end here, at the cost of one row each.
4. The different stretches of an anchor are a reference shard. In the order of
   their least ids each is streamed through the automaton of those before it
   and then joins the automaton.
5. An anchor with more than ``SHARD`` different stretches (the edge of a
   passage that thousands of documents share) isn't one shard: its windows are
   compared by their hashes, in an aggregate over all tasks. Exact as well.

Defined results: a null or empty text has no words; fewer words than a window
are kept; rows without an id are kept whole and are no reference; rows that
repeat an id don't remove each other's words. Stretches are named by two 64-bit
hashes (of their anchor and of their words).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, run_hashes, saved, signed, word_hashes

WINDOW = 50
ANCHOR = 16
SHARD = 2000
BUNDLE = 2_000


class Automaton:
    """Suffix automaton of many sequences."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, c, q: int) -> int:  # noqa: ANN001
        """The state for the longest way to ``q`` through ``p``."""
        step, link, length = self.step, self.link, self.length
        if length[q] == length[p] + 1:
            return q
        twin = self._state(length[p] + 1, dict(step[q]), link[q])
        link[q] = twin
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = twin
            p = link[p]
        return twin

    def add(self, sequence: list) -> None:
        step, link, length, last = self.step, self.link, self.length, 0
        for c in sequence:
            q = step[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                continue
            cur, p = self._state(length[last] + 1, {}, 0), last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                link[cur] = self._split(p, c, step[p][c])
            last = cur

    def matches(self, sequence: list) -> Iterator[int]:
        """Matching statistics: the longest match that ends at each place."""
        step, link, length, state, n = self.step, self.link, self.length, 0, 0
        for c in sequence:
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            to = step[state].get(c)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            yield n


def stretches(words: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, end window, hash of the words) of each
    maximal run of windows with one anchor."""
    n = len(words) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty.astype(np.uint64)
    size = min(ANCHOR, window)
    grams = gram_hashes(words, size)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - size + 1).argmin(axis=1) + np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    end = np.append(first[1:], n)
    return grams[at[first]], first, end, run_hashes(words, first, end + window - 1)


def _rows(col: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each row."""
    for lo, hi, words, bounds in word_hashes(col):
        for i in range(hi - lo):
            yield words[bounds[i]:bounds[i + 1]]


def _kept(words: list[bytes], gone: np.ndarray) -> str:
    return hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest()


def _spans(gone: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2).tolist()


def remove_repeats(docs: DataFrame, by: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans) of every row: the number
    of words, of removed words, the digest of the kept words joined by one
    space, and the removed spans as [first word, end) pairs."""
    raw = docs.select(F.col(by).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))

    # anchors that more than one document holds
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signed(np.unique(stretches(w, window)[0])) for w in _rows(b.column(1))]
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(ids, pa.int64())], ["h", "id"])

    posted = raw.where("id is not null").mapInArrow(anchors, "h long, id long")
    repeated = posted.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    marked = posted.join(repeated, "h").groupBy("id").agg(F.collect_set("h").alias("hs"))

    # rows without such anchors are done; the others keep their text
    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest = [], []
            texts = b.column(1).to_pylist()
            open_ = b.column(2).is_valid().to_pylist()
            for t, o in zip(texts, open_):
                words = (t or b"").split()
                n.append(len(words))
                digest.append(None if o else hashlib.sha256(b" ".join(words)).hexdigest())
            kept = pa.array([t if o else None for t, o in zip(texts, open_)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), kept, b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.string())],
                                             ["id", "text", "hs", "n_words", "kept_sha256"])

    base = saved(raw.join(marked, "id", "left").select("id", "text", "hs").mapInArrow(
        first_pass, "id long, text binary, hs array<long>, n_words long, kept_sha256 string"), "rows")

    # the stretches of repeated anchors
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists, texts = b.column(0).to_pylist(), b.column(2), b.column(1).to_pylist()
            for i, w in enumerate(_rows(b.column(1))):
                h, first, end, own = stretches(w, window)
                take = np.flatnonzero(np.isin(signed(h), lists[i].values.to_numpy()))
                words = texts[i].split()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(take), ids[i], np.int64)), pa.array(signed(h[take])), pa.array(signed(own[take])),
                     pa.array([b" ".join(words[first[t]:end[t] + window - 1]) for t in take.tolist()], pa.binary())],
                    ["id", "h", "own", "words"])

    held = base.where("hs is not null").select("id", "text", "hs").mapInArrow(cut, "id long, h long, own long, words binary")
    # equal stretches are one; from the last join on, a stretch is named by its two 64-bit hashes alone
    distinct = saved(held.groupBy("h", "own", "words").agg(F.min("id").alias("first")), "stretches")
    sizes = distinct.groupBy("h").count().where("count > 1")
    shared = distinct.join(sizes, "h")

    def shard(t: pa.Table) -> pa.Table:
        """Flags of the windows of each stretch that an earlier one holds."""
        h, first, own = (t.column(c).to_numpy() for c in ("h", "first", "own"))
        texts, order = t.column("words").to_pylist(), np.lexsort((first, h))
        out: tuple[list, list, list, list] = ([], [], [], [])
        anchor, automaton, waiting = None, Automaton(), []
        for r in order.tolist():
            if h[r] != anchor:
                anchor, automaton, waiting = h[r], Automaton(), []
            if waiting and first[r] != waiting[0][0]:  # stretches of one document are no reference for each other
                for _, words in waiting:
                    automaton.add(words)
                waiting = []
            words = texts[r].split(b" ")
            ends = [e for e, n in enumerate(automaton.matches(words)) if n >= window]
            if ends:
                for to, x in zip(out, (h[r], own[r], first[r], [e - window + 1 for e in ends])):
                    to.append(x)
            if len(ends) <= len(words) - window:  # else all of it is known
                waiting.append((first[r], words))
        return pa.table({"h": pa.array(out[0], pa.int64()), "own": pa.array(out[1], pa.int64()), "id": pa.array(out[2], pa.int64()),
                         "windows": pa.array(out[3], pa.list_(pa.int32()))})

    small = shared.where(F.col("count") <= SHARD)
    bundles = max(1, -(-small.select("h").count() // BUNDLE))
    flagged = small.withColumn("bundle", F.pmod(F.xxhash64("h"), F.lit(bundles))).groupBy("bundle").applyInArrow(
        shard, "h long, own long, id long, windows array<int>")

    # anchors with too many stretches for one shard: by the hashes of the windows
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w in enumerate(_rows(b.column(2))):
                n = len(w) - window + 1
                each = [pa.array(np.full(n, b.column(c)[i].as_py(), np.int64)) for c in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*each, pa.array(signed(gram_hashes(w, window))), pa.array(np.arange(n, dtype=np.int32))],
                                                 ["h", "own", "id", "w", "at"])

    large = shared.where(F.col("count") > SHARD).select("h", "own", "words", F.col("first").alias("id"))
    each = large.mapInArrow(windows, "h long, own long, id long, w long, at int")
    earliest = each.groupBy("w").agg(F.min("id").alias("lo"))
    hot = (each.join(earliest, "w").where("lo < id").groupBy("h", "own", "id").agg(F.collect_list("at").alias("windows")))

    # what goes from each document: all of a stretch held before, or single windows of its own first ones
    partly = flagged.union(hot.select("h", "own", "id", "windows"))
    seen = held.select("id", "h", "own").distinct().join(distinct.groupBy("h", "own").agg(F.min("first").alias("first")), ["h", "own"])
    wholly = seen.where("id > first").select("h", "own", "id", F.lit(None).cast("array<int>").alias("windows"))
    gone = wholly.union(partly).groupBy("id").agg(F.collect_list(F.struct("own", "windows")).alias("gone"))

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, digest, spans = [], [], []
            texts, lists = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, w in enumerate(_rows(b.column(1))):
                words = texts[i].split()
                cover = np.zeros(len(words) + 1, np.int64)
                known: dict[int, set[int] | None] = {}
                for x in lists[i]:  # a whole stretch prevails
                    if x["windows"] is None or known.get(x["own"], ()) is None:
                        known[x["own"]] = None
                    else:
                        known.setdefault(x["own"], set()).update(x["windows"])
                _, first, end, own = stretches(w, window)
                for f, e, o in zip(first.tolist(), end.tolist(), signed(own).tolist()):
                    if o in known:
                        for at in range(f, e) if known[o] is None else [f + x for x in known[o]]:
                            cover[at] += 1
                            cover[at + window] -= 1
                gone_ = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone_.sum()))
                digest.append(_kept(words, gone_))
                spans.append(_spans(gone_))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["id", "n_words", "n_removed", "kept_sha256", "spans"])

    out = "id long, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>"
    open_ = base.where("hs is not null").join(gone, "id", "left").select(
        "id", "text", F.coalesce("gone", F.array().cast("array<struct<own:long,windows:array<int>>>")).alias("gone"), "n_words")
    done = base.where("hs is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
                                           F.array().cast("array<array<int>>").alias("spans"))
    return done.union(open_.mapInArrow(last_pass, out))
