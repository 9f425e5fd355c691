"""Token counts under a unigram vocabulary, without encoding the texts.

The distinct pre-tokens of a batch are inserted in a trie and walked depth
first (in sorted order, with the path from the root on a stack): the forward
score of a node, that is the best score of any segmentation of its prefix, is
computed once and shared by all pre-tokens below it; a node that ends a
pre-token stores the number of pieces of its best segmentation. A document's
count is the sum over its pre-tokens, so nothing is shuffled and a task's
memory is bounded by one group of texts and the cache of terminal counts.

Scores: those of a unigram model as they are; a BPE model holds ranks, which
Zipf's law turns into log probabilities, ``-log(1 + rank)``. A character
without a piece scores ten below the worst piece and counts as its UTF-8 bytes
(byte fallback) or as one token. Of equal scores the fewer pieces win.

Defined results: null and empty texts have no tokens. Columns of the input
that clash with a result column are replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held
from .sentencepiece_codec import CACHE_ENTRIES, GROUP_CHARS, NORMAL, UNIGRAM, USER, Codec, Model


def unigram_scores(model: Model) -> dict[str, float]:
    normal = {p: s for p, s, k in model.pieces if k in (NORMAL, USER)}
    if model.kind == UNIGRAM:
        return normal
    order = sorted(normal, key=lambda p: (-normal[p], model.ids[p]))
    return {p: -math.log(2 + i) for i, p in enumerate(order)}


class TrieCounter:
    """Terminal counts of pre-tokens by a walk of their trie."""

    def __init__(self, model: Model) -> None:
        self.scores = unigram_scores(model)
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.bytes = model.byte_fallback
        self.reach: dict[str, int] = {}  # longest piece by its last character
        for p in self.scores:
            self.reach[p[-1]] = max(self.reach.get(p[-1], 0), len(p))

    def counts(self, units: Iterable[str]) -> dict[str, int]:
        scores, reach, unknown, as_bytes = self.scores.get, self.reach.get, self.unknown, self.bytes
        best, made = [0.0], [0]  # by depth: forward score and pieces of the path's prefixes
        before, out = "", {}
        for unit in sorted(units):
            shared = 0
            for a, b in zip(unit, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], made[shared + 1:]
            for d in range(shared + 1, len(unit) + 1):
                c = unit[d - 1]
                top, fewest = -math.inf, 0
                for start in range(max(0, d - reach(c, 0)), d):
                    s = scores(unit[start:d])
                    if s is not None:
                        s += best[start]
                        if s > top or (s == top and made[start] + 1 < fewest):
                            top, fewest = s, made[start] + 1
                if scores(c) is None and best[d - 1] + unknown > top:
                    top = best[d - 1] + unknown
                    fewest = made[d - 1] + (len(c.encode("utf-8", "replace")) if as_bytes else 1)
                best.append(top)
                made.append(fewest)
            out[unit] = made[-1]
            before = unit
        return out


class Counter:
    def __init__(self, data: bytes) -> None:
        self.codec = Codec(data, verify=False)
        self.trie, self.known = TrieCounter(self.codec.model), {}

    def batch(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """(pre-tokens, tokens) of each text."""
        find, normalise = self.codec.model.unit.findall, self.codec.normalise
        units = [find(normalise(x)) if x else [] for x in texts]
        distinct = set(itertools.chain.from_iterable(units))
        if len(self.known) + len(distinct) > CACHE_ENTRIES:
            self.known = {u: self.known[u] for u in distinct if u in self.known}
        self.known.update(self.trie.counts(u for u in distinct if u not in self.known))
        get = self.known.__getitem__
        return [len(u) for u in units], [sum(map(get, u)) for u in units]


def _counter(data: bytes) -> Counter:
    key = ("counter", len(data), hash(data))
    return held(key, lambda: Counter(data))


def count_tokens(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_units and n_tokens added."""
    made = ["n_units", "n_tokens"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (*made, text)]
    schema = docs.select(*kept, *(F.lit(None).cast("long").alias(c) for c in made)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for b in batches:
            found, texts, held = [[], []], [], 0
            col = b.column(b.num_columns - 1)
            for i, x in enumerate(col):
                texts.append(x.as_py())
                held += len(texts[-1] or "")
                if held >= GROUP_CHARS or i + 1 == len(col):
                    for all_, some in zip(found, counter.batch(texts)):
                        all_ += some
                    texts, held = [], 0
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, pa.int64()) for x in found)], [*kept, *made])

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)
