"""Benchmark decontamination by edit distance.

Finds every document that holds a benchmark item up to ``RATE`` word edits.
Words are runs of letters and digits, A-Z folded; in scripts that are written
without spaces (Chinese, Japanese, Thai and others) every character is a word.
The CGK embedding walks over
a word sequence: at step j it emits the current word and moves on if a random
bit of (j, word) says so. Two sequences within a small edit distance fall into
step again after an edit, so their embeddings are close in Hamming distance.
Bit sampling keeps a few random coordinates of the embedding as a hash: a
window of a document and an item that agree on all of them are a candidate.
Walks and coordinates are drawn again and again until, on simulated edits of
the items at the full rate, the share of items that are met reaches
``TARGET``. Items of similar length share their walks. Where ``MOST_REPEATS``
walks do not reach it (items of about 1,000 words and more), and below
``LEAST_WORDS`` words, the items are looked for exactly: of k + 1 parts of an item, k edits leave one as it was, so
each part is looked up by its hash at every word.

A walk starts at every word of every document at which an item of that length
could start at all: of its first n - k words at most k may be foreign to the
items. Each candidate is verified exactly (Myers' bit-parallel edit distance
of the item against the document's words around the window).

Documents are mapped where they are: no shuffle. The items are broadcast;
their size is checked against ``MAX_ITEM_BYTES``.

Defined results: null and empty texts hold nothing; items without a word
(null, empty, punctuation alone) are not looked for; all others are, so an item
of one word is held by each document with that word; of several
places the one with the least distance, then the first, is reported; repeated
rows are reported each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gram_hashes, held, run_hashes, text_buffers, tidied, word_hashes
from .wordlists import groups as groups_of

RATE = 0.2
TARGET = 0.95
SAMPLED = 3
LEAST_WORDS = 8
#: Text that is searched at once, unless a single text is longer.
GROUP_BYTES = 1 << 22
MAX_ITEM_BYTES = 64 << 20
MOST_REPEATS = 300
TRIALS = 400
BREAKS = bytes(c for c in range(128) if not chr(c).isalnum())
# Scripts without spaces, as ranges of RE2, and the punctuation of their texts.
SPACELESS = (r"\x{E01}-\x{EFF}\x{F00}-\x{FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{1950}-\x{19FF}\x{1A20}-\x{1AAF}\x{1B00}-\x{1B7F}"
             r"\x{2E80}-\x{2FDF}\x{3005}-\x{3007}\x{3021}-\x{3029}\x{3031}-\x{3035}\x{3038}-\x{303C}\x{3041}-\x{30FA}\x{30FC}-\x{312F}"
             r"\x{31A0}-\x{31BF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{A4CF}\x{A980}-\x{A9FF}\x{AA60}-\x{AADF}\x{F900}-\x{FAFF}"
             r"\x{FF66}-\x{FF9F}\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFF}")
WIDE_BREAKS = r"\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{303D}-\x{303F}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}"


def edits_allowed(n: int, rate: float = RATE) -> int:
    return int(n * rate + 1e-9)


def parted(col: pa.Array) -> pa.Array:
    """``col`` with blanks around each character that is a word of its own."""
    _, data = text_buffers(col)
    if not len(data) or data.max() < 0xE0:  # none of them has fewer than three bytes
        return col
    col = col.cast(pa.large_string())
    some = pc.match_substring_regex(col, f"[{SPACELESS}{WIDE_BREAKS}]")
    if not pc.any(some).as_py():
        return col
    spaced = pc.replace_substring_regex(pc.replace_substring_regex(col.filter(some), f"[{WIDE_BREAKS}]", " "), f"([{SPACELESS}])", r" \1 ")
    return pc.replace_with_mask(col, some.fill_null(False), spaced)


def least_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to any run of the text, end of the
    first such run), bit-parallel over the item."""
    n = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = (n, 0)
    for j, w in enumerate(text.tolist()):
        eq = places.get(w, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        plus = down | (full & ~(d0 | up))
        minus = up & d0
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(d0 | plus))
        down = plus & d0
        if score < best[0]:
            best = (score, j + 1)
            if not score:
                break
    return best


@dataclass
class SizeClass:
    """Items of similar length and the walks that look for them; without
    ``repeats`` their parts are looked up."""

    items: list[int]  # positions in the list of items
    low: int
    high: int
    words: np.ndarray  # sorted word hashes of these items
    sequences: list[np.ndarray]  # items as places in ``words``
    seed: int
    repeats: int = 0

    def walk(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(bits by step and word, sampled steps) of repeat ``r``; the last
        word stands for all foreign ones."""
        rng = np.random.default_rng((self.seed, r))
        steps = np.sort(rng.choice(int(1.6 * self.low), SAMPLED, replace=False))
        return rng.integers(0, 2, (int(steps[-1]) + 1, len(self.words) + 1), np.uint8), steps


def embed(words: np.ndarray, start: np.ndarray, end: np.ndarray, bits: np.ndarray, steps: np.ndarray,
          wanted: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``start`` that are left, their sampled words as one number).
    A window that meets a foreign word at a sampled step drops out, and one
    whose word is not ``wanted`` there."""
    foreign = bits.shape[1] - 1
    left, at, stop = np.arange(len(start)), start.copy(), end
    key = np.zeros(len(start), np.int64)
    sampled = {int(s): i for i, s in enumerate(steps)}
    for j in range(len(bits)):
        w = words[at]
        if j in sampled:
            ok = wanted[sampled[j]][w] if wanted is not None else w != foreign
            left, at, stop, key, w = left[ok], at[ok], stop[ok], key[ok], w[ok]
            key = key * foreign + w
            if not len(left):
                break
        at = np.minimum(at + bits[j][w], stop)
    return left, key


def classes(items: list[np.ndarray], rate: float) -> list[SizeClass]:
    """Items dealt into classes of similar length, all of the short ones into
    one without walks."""
    order = sorted((len(x), i) for i, x in enumerate(items) if len(x))
    out: list[SizeClass] = []
    while order:
        low = order[0][0]
        high = LEAST_WORDS - 1 if low < LEAST_WORDS else low * 1.25
        own = [i for n, i in order if n <= high]
        order = [(n, i) for n, i in order if n > high]
        words = np.unique(np.concatenate([items[i] for i in own]))
        c = SizeClass(own, low, max(len(items[i]) for i in own), words,
                      [np.searchsorted(words, items[i]) for i in own], 1000 + low)
        c.repeats = repeats_needed(c, rate) if low >= LEAST_WORDS else 0
        out.append(c)
    return out


def repeats_needed(c: SizeClass, rate: float) -> int:
    """Repeats after which the target share of simulated edits of the items,
    at the full rate, has met its item; 0 if ``MOST_REPEATS`` are too few."""
    rng = np.random.default_rng(c.seed)
    foreign = len(c.words)
    parts, originals = [], []
    for _ in range(TRIALS):
        x = c.sequences[int(rng.integers(len(c.sequences)))]
        y = x.tolist()
        for _ in range(edits_allowed(len(x), rate)):
            kind, i = int(rng.integers(3)), int(rng.integers(len(y)))
            y[i:i + (kind != 0)] = [foreign] * (kind != 2)  # insert, replace or delete
        parts.append(np.array(y + [foreign] * (c.high * 2)))
        originals.append(np.concatenate([x, np.full(c.high * 2, foreign)]))
    met = np.zeros(TRIALS, bool)

    def keys(seqs: list[np.ndarray], bits: np.ndarray, steps: np.ndarray) -> np.ndarray:
        first = np.cumsum([0, *(len(s) for s in seqs)])
        left, key = embed(np.concatenate(seqs), first[:-1], first[1:] - 1, bits, steps)
        out = np.full(len(seqs), -1)
        out[left] = key
        return out

    for r in range(MOST_REPEATS):
        bits, steps = c.walk(r)
        a, b = keys(parts, bits, steps), keys(originals, bits, steps)
        met |= (a == b) & (a >= 0)
        if met.mean() >= TARGET:
            return r + 1
    return 0


class PartIndex:
    """Items cut into one part more than the edits that are allowed."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float) -> None:
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for i, x in items:
            cuts = np.linspace(0, len(x), edits_allowed(len(x), rate) + 2).astype(np.int64)
            for h, a, b in zip(run_hashes(x, cuts[:-1], cuts[1:]).tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                parts.setdefault(b - a, []).append((h, i, a))
        self.by_size = []
        for size, found in sorted(parts.items()):
            h, item, first = (np.array(x, t) for x, t in zip(zip(*sorted(found)), (np.uint64, np.int64, np.int64)))
            self.by_size.append((size, h, item, first))

    def find(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, word of ``words`` at which the item would start if it
        had no edit) of each part that a row holds, sorted."""
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        out = []
        for size, hashes, item, first in self.by_size:
            h = gram_hashes(words, size)
            place = np.searchsorted(hashes, h)
            at = np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == h)
            at = at[at + size <= bounds[row_of[at] + 1]]
            a, b = place[at], np.searchsorted(hashes, h[at], "right")
            some = np.repeat(np.arange(len(at)), b - a)
            nth = a[some] + np.arange(len(some)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            out.append(np.stack([row_of[at[some]], item[nth], at[some] - first[nth]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return list(map(tuple, np.unique(found, axis=1).T.tolist()))


class Finder:
    def __init__(self, items: list[tuple[int, np.ndarray]], groups: list[SizeClass], rate: float) -> None:
        self.ids, self.items, self.rate = [i for i, _ in items], [x for _, x in items], rate
        self.parts = PartIndex([(i, self.items[i]) for g in groups if not g.repeats for i in g.items], rate)
        self.groups = groups = [g for g in groups if g.repeats]
        self.words = np.unique(np.concatenate([g.words for g in groups])) if groups else np.zeros(0, np.uint64)
        self.own, self.walks = [], []
        for g in groups:
            place = np.full(len(self.words) + 1, len(g.words), np.int32)
            place[np.searchsorted(self.words, g.words)] = np.arange(len(g.words))
            self.own.append(place)
            self.walks.append([self._prepared(g, r) for r in range(g.repeats)])

    @staticmethod
    def _prepared(g: SizeClass, r: int) -> tuple:
        """Walk, the words wanted at each sampled step, and the items by key."""
        bits, steps = g.walk(r)
        pad = np.full(2 * g.high, len(g.words))
        seqs = [np.concatenate([s, pad]) for s in g.sequences]
        first = np.cumsum([0, *(len(s) for s in seqs)])
        left, key = embed(np.concatenate(seqs), first[:-1], first[1:] - 1, bits, steps)
        order = np.argsort(key, kind="stable")
        wanted, rest = [], key
        for _ in steps:
            ok = np.zeros(len(g.words) + 1, bool)
            ok[rest % max(len(g.words), 1)] = True
            wanted.insert(0, ok)
            rest = rest // max(len(g.words), 1)
        return bits, steps, wanted, key[order], left[order]

    def find(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, end, distance) of the best place of each
        item that a row holds. ``words`` are hashes; rows are ``bounds``."""
        rows = len(bounds) - 1
        place = np.searchsorted(self.words, words)
        place[place == len(self.words)] = 0
        if len(self.words):
            place[self.words[place] != words] = len(self.words)
        # one foreign word after each row stops every walk
        place = np.insert(place, bounds[1:], len(self.words)).astype(np.int32)
        shifted = bounds + np.arange(rows + 1)
        row_of = np.repeat(np.arange(rows), np.diff(shifted))
        stop = shifted[1:] - 1
        regions: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def look_at(row: int, item: int, at: int) -> None:
            reach = regions.setdefault((row, item), [])
            k, size = edits_allowed(len(self.items[item]), self.rate), len(self.items[item])
            a, b = at - 2 * k, at + size + 2 * k
            if reach and a <= reach[-1][1]:
                reach[-1] = (reach[-1][0], max(b, reach[-1][1]))
            else:
                reach.append((a, b))

        for row, item, at in self.parts.find(words, bounds):
            look_at(row, item, at + row)
        for g, own, walks in zip(self.groups, self.own, self.walks):
            mine = own[place]
            foreign = np.concatenate([[0], np.cumsum(mine == len(g.words))])
            k_low, k_high = edits_allowed(g.low, self.rate), edits_allowed(g.high, self.rate)
            least = g.low - k_low
            n = len(mine) - least
            if n <= 0:
                continue
            start = np.flatnonzero((foreign[least:least + n] - foreign[:n] <= k_high) & (mine[:n] != len(g.words)))
            start = start[start + least <= stop[row_of[start]]]
            end = stop[row_of[start]]
            found = []
            for bits, steps, wanted, keys, owners in walks:
                left, key = embed(mine, start, end, bits, steps, wanted)
                a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                some = np.repeat(np.arange(len(left)), b - a)
                nth = np.arange(len(some)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
                found.append(start[left[some]] * len(g.items) + owners[a[some] + nth])
            for code in np.unique(np.concatenate(found)).tolist() if found else []:
                at, own_item = divmod(code, len(g.items))
                look_at(int(row_of[at]), g.items[own_item], at)
        out = []
        for (row, item), reach in regions.items():
            text = words[bounds[row]:bounds[row + 1]]
            x = self.items[item]
            best = None
            for a, b in reach:
                a, b = max(0, a - int(shifted[row])), min(len(text), b - int(shifted[row]))
                d, end = least_distance(x, text[a:b])
                if d <= edits_allowed(len(x), self.rate) and (best is None or d < best[0]):
                    back = least_distance(x[::-1], text[a:a + end][::-1][:len(x) + d])
                    best = (d, a + end - back[1], a + end)
                    if not d:
                        break
            if best is not None:
                out.append((row, self.ids[item], best[1], best[2], best[0]))
        return out


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[tuple[int, np.ndarray]]:
    """(id, word hashes) of the items, after a check of their size."""
    rows = benchmark.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"benchmark of {size} bytes: more than {MAX_ITEM_BYTES}; split it")
    got = rows.orderBy("i", "t").collect()
    out = []
    for lo, hi, h, bounds in word_hashes(parted(pa.array([r["t"] for r in got], pa.string())), True, BREAKS):
        out += [(got[lo + n]["i"], h[bounds[n]:bounds[n + 1]]) for n in range(hi - lo)]
    return out


def _finding(docs: DataFrame, benchmark: DataFrame, text: str, rate: float,
             report: Callable[[pa.RecordBatch, list[tuple]], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``docs`` through the finder; ``report`` makes rows of a batch and its hits."""
    items = benchmark_items(benchmark)
    sized = classes([x for _, x in items], rate)
    shared = docs.sparkSession.sparkContext.broadcast((items, sized))
    name = f"{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = held(name, lambda: Finder(*shared.value, rate))
        for batch in batches:
            # the search holds some hundred bytes a word, so a batch is searched in groups of bounded size
            for lo, hi in groups_of(batch.column(batch.num_columns - 1), GROUP_BYTES):
                b = batch.slice(lo, hi - lo)
                parts, bounds = [], [np.zeros(1, np.int64)]
                for _, _, h, own in word_hashes(parted(b.column(b.num_columns - 1)), True, BREAKS):
                    parts.append(h)
                    bounds.append(own[1:] + bounds[-1][-1])
                yield report(b, finder.find(np.concatenate(parts), np.concatenate(bounds)))

    kept = [f.name for f in schema.fields if f.name in docs.columns]
    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(tidied(run), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", rate: float = RATE) -> DataFrame:
    """``keys`` of ``docs`` with (item_id, start_word, end_word, distance):
    one row for each item that a document holds, none for a clean one."""
    made = [T.StructField("item_id", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("start_word", "end_word", "distance"))]
    schema = T.StructType([*docs.select(*keys).schema.fields, *made])

    def report(b: pa.RecordBatch, hits: list[tuple]) -> pa.RecordBatch:
        rows = pa.array([h[0] for h in hits], pa.int64())
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns[:-1]),
                                           *(pa.array([h[i + 1] for h in hits], t) for i, t in enumerate(kinds))], schema.names)

    return _finding(docs, benchmark, text, rate, report, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    schema = docs.schema

    def report(b: pa.RecordBatch, hits: list[tuple]) -> pa.RecordBatch:
        keep = np.ones(b.num_rows, bool)
        keep[[h[0] for h in hits]] = False
        return b.select(schema.names).filter(pa.array(keep))

    return _finding(docs, benchmark, text, rate, report, schema)
