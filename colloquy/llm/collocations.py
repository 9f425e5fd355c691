"""Phrase collocations by vertically partitioned, depth-truncated suffix trees.

Texts are split into pieces and pieces into words; every word starts a suffix,
which ends with its piece or after ``max_words`` words. All counts are kept for
each language on its own.

* Vertical partitioning: the words are counted first. A word (prefix) that
  occurs no more often than the memory budget of a task, in suffixes, roots a
  subtree of its own; one that occurs more often is extended by the next word,
  counted again over all texts, and so on, until every prefix fits or is a whole
  phrase, whose count is then known. Prefixes are hashed to slots, and slots
  with their measured totals packed into groups of the budget's size, so that
  the routing table has a fixed size whatever the vocabulary.
* Independent subtrees: each task cuts its suffixes at the first word that is
  too rare for any phrase (a bit table of fixed size), adds up equal ones, and
  sends them to the group of their prefix, one row for each chunk and group. A
  group builds the truncated subtrees of its prefixes level by level, a node
  being named by its parent and its word, and reads the count of each node from
  the totals of the leaves below.
* Scores: a phrase with its parts' counts is an equi-join by phrase; numbers are
  exact decimals. A phrase inside a longer one of enough occurrences shows
  already in the longer phrases of one word more, since counts only fall.

Hot words never gather in one task (they are extended or counted), nor do hot
languages (subtrees are routed by language and prefix; the ranking keeps the
best rows of each partition before it shuffles).

Defined results: a null text is empty, a null language ``und``; empty tables
and texts without words give no rows; repeated rows count as often as they
come; a text is cut into chunks between pieces only, so the memory of a task
grows with the longest piece; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, saved
from .wordlists import split_words

#: Suffixes of a group, and so the memory of a task, where the corpus is not so
#: large that more than MOST_HEAVY prefixes could pass it.
BUDGET = 1 << 18
MOST_HEAVY = 1 << 22
#: Bytes of text that a task looks at together.
CHUNK = 1 << 23
RARE_BITS = 24
END_OF_PIECE = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _c in END_OF_PIECE:
    _TABLE[_c] = 0x0A
_TABLE[0x09] = 0x20

COUNTS = "lang string, phrase string, h long, f long"
SUFFIXES = "group int, lang string, depth int, suffixes string, counts array<long>"
NODES = "lang string, phrase string, k int, f long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, pieces) with a line feed after each piece."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            text = text.translate(_TABLE)
            while len(text) > CHUNK:
                cut = text.find(b"\n", CHUNK - 1) + 1
                if not cut:
                    break
                yield lang, text[:cut]
                text = text[cut:]
            held.setdefault(lang, []).append(text)
            size += len(text) + 1
            if size >= CHUNK:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


class _Chunk:
    """The words of a chunk as codes of its dictionary, and where pieces end."""

    def __init__(self, lang: str, data: bytes) -> None:
        part = np.frombuffer(data, np.uint8)
        words, starts = split_words(part, np.zeros(0, np.int64), b" \n")
        coded = words.dictionary_encode()
        self.lang, self.dictionary = lang, coded.dictionary.cast(pa.string())
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(part == 0x0A)[starts]
        # number of words from each one to the end of its piece
        last = np.append(np.flatnonzero(np.diff(piece)), len(piece) - 1)
        self.left = last[np.searchsorted(last, np.arange(len(piece)))] - np.arange(len(piece)) + 1

    def phrases(self, at: np.ndarray, depth: np.ndarray | int) -> pa.Array:
        """The first ``depth`` words from each place, joined."""
        depth = np.broadcast_to(depth, at.shape)
        parts = []
        for j in range(int(depth.max()) if len(at) else 1):
            has = depth > j
            codes = self.codes[np.where(has, at + j, 0)] if len(at) else np.zeros(0, np.int64)
            parts.append(self.dictionary.take(pa.array(codes, mask=~has)))
        return pc.binary_join_element_wise(*parts, " ", null_handling="skip")

    def hashes(self, phrases: pa.Array) -> np.ndarray:
        keys = np.array([f"{self.lang}\t{p}" for p in phrases.to_pylist()], dtype=object)
        return pd.util.hash_array(keys, categorize=False).view(np.int64) if len(keys) else np.zeros(0, np.int64)

    def heavy(self, known: dict, depth: int, at: np.ndarray) -> np.ndarray:
        """Is the prefix of ``depth`` words at each place one of the heavy ones?"""
        wanted = known.get((self.lang, depth))
        if wanted is None or not len(at):
            return np.zeros(len(at), bool)
        if depth == 1:
            return pc.is_in(self.dictionary, value_set=wanted).to_numpy(zero_copy_only=False)[self.codes[at]]
        return pc.is_in(self.phrases(at, depth), value_set=wanted).to_numpy(zero_copy_only=False)


def _merged(chunk: _Chunk, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place, depth, number) of each distinct phrase of ``depth`` words."""
    size = len(chunk.dictionary) + 1
    names = np.zeros(len(at), np.int64)
    first, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for j in range(int(depth.max()) if len(at) else 0):
        has = depth > j
        word = np.where(has, chunk.codes[np.where(has, at + j, 0)] + 1, 0)
        _, first, names, counts = np.unique(names * size + word, return_index=True, return_inverse=True, return_counts=True)
    return at[first], depth[first], counts


def _prefix_counts(docs: DataFrame, depth: int, heavy: dict) -> DataFrame:
    """(lang, phrase, h, f) of all prefixes of ``depth`` words that extend a
    heavy one; of all words, if ``depth`` is 1."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _chunks(batches):
            c = _Chunk(lang, data)
            at = np.flatnonzero(c.left >= depth)
            for d in range(1, depth):
                at = at[c.heavy(shared.value, d, at)]
            at, _, counts = _merged(c, at, np.full(len(at), depth))
            phrases = c.phrases(at, depth)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), phrases, pa.array(c.hashes(phrases)), pa.array(counts)],
                                             ["lang", "phrase", "h", "f"])

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "phrase", "h").agg(F.sum("f").alias("f"))


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.int64(20)) & np.int64((1 << RARE_BITS) - 1)


def _frequent_bits(words: DataFrame, min_count: int) -> np.ndarray:
    """A bit for each hash of a word that occurs ``min_count`` times."""
    place = F.shiftright("h", 20).bitwiseAND(F.lit((1 << RARE_BITS) - 1))
    got = (words.where(F.col("f") >= min_count).groupBy(F.shiftright(place, 6).cast("int").alias("w"))
           .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(h, 20) & {63} as int))")).alias("bits"))).toPandas()
    table = np.zeros(1 << (RARE_BITS - 6), np.int64)
    table[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return table


def _routes(docs: DataFrame, max_words: int, table: tuple, min_depth: int = 2) -> DataFrame:
    """Suffixes for the groups of their prefixes. ``table``: (heavy prefixes,
    bits of frequent words, group of each slot)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, bits, group_of = shared.value
        for lang, data in _chunks(batches):
            c = _Chunk(lang, data)
            if not len(c.codes):
                continue
            h = c.hashes(c.dictionary)
            b = _bit(h)
            rare = ((bits[b >> 6] >> (b & 63)) & 1 == 0)[c.codes]
            # words up to the first rare one, the end of the piece or the depth
            far = np.append(np.flatnonzero(rare), len(rare))
            places = np.arange(len(rare))
            depth = np.minimum(np.minimum(far[np.searchsorted(far, places)] - places, c.left), max_words)
            at = np.flatnonzero(depth >= min_depth)
            at, depth, counts = _merged(c, at, depth[at])
            route = np.ones(len(at), np.int64)
            on = np.arange(len(at))
            for d in range(1, max_words + 1):
                on = on[depth[on] >= d]
                on = on[c.heavy(heavy, d, at[on])]
                route[on] = d + 1
            sent = route <= depth  # the others are heavy prefixes, counted already
            at, depth, counts, route = at[sent], depth[sent], counts[sent], route[sent]
            own = h[c.codes[at]]
            deep = route > 1
            if deep.any():
                own[deep] = c.hashes(c.phrases(at[deep], route[deep]))
            group = group_of[own & (len(group_of) - 1)].astype(np.int64)
            order = np.argsort(group * (max_words + 1) + route, kind="stable")
            group, route = group[order], route[order]
            ends = np.flatnonzero(np.append((np.diff(group) != 0) | (np.diff(route) != 0), True)) + 1 if len(group) else np.zeros(0, np.int64)
            bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
            head = ends - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(group[head], pa.int32()), pa.array([lang] * len(head), pa.string()), pa.array(route[head], pa.int32()),
                pc.binary_join(pa.ListArray.from_arrays(bounds, c.phrases(at[order], depth[order])), "\n"),
                pa.ListArray.from_arrays(bounds, pa.array(counts[order]))], ["group", "lang", "depth", "suffixes", "counts"])

    return docs.mapInArrow(run, SUFFIXES)


def _subtree(suffixes: pa.Array, counts: np.ndarray, depth: int, max_words: int, min_count: int) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """(phrases, words, counts) of the nodes of the suffixes' tree, from
    ``depth`` words on, that occur ``min_count`` times."""
    lists = pc.split_pattern(suffixes, " ")
    coded = lists.values.dictionary_encode()
    dictionary, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = lists.offsets.to_numpy()[:-1].astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    on, parent = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
    for k in range(1, max_words + 1):
        alive = sizes[on] >= k
        on, parent = on[alive], parent[alive]
        _, head, parent = np.unique(parent * len(dictionary) + codes[first[on] + k - 1], return_index=True, return_inverse=True)
        totals = np.bincount(parent, counts[on], len(head)).astype(np.int64)
        if k >= max(depth, 2):
            kept = totals >= min_count
            at = first[on[head[kept]]]
            parts = [dictionary.take(pa.array(codes[at + j])) for j in range(k)]
            yield pc.binary_join_element_wise(*parts, " "), k, totals[kept]


def _nodes(suffixes: DataFrame, max_words: int, min_count: int) -> DataFrame:
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        kinds = sorted(set(zip(rows["lang"].to_pylist(), rows["depth"].to_pylist())))
        out = []
        for lang, depth in kinds:
            own = rows.filter(pc.and_(pc.equal(rows["lang"], lang), pc.equal(rows["depth"], depth)))
            texts = pa.concat_arrays(pc.list_flatten(pc.split_pattern(own["suffixes"], "\n")).chunks)
            counts = pc.list_flatten(own["counts"]).to_numpy().astype(np.float64)
            for phrases, k, totals in _subtree(texts, counts, depth, max_words, min_count):
                n = len(totals)
                out.append(pa.table([pa.array([lang] * n, pa.string()), phrases.cast(pa.string()), pa.array(np.full(n, k), pa.int32()), pa.array(totals)],
                                    names=["lang", "phrase", "k", "f"]))
        return pa.concat_tables(out)

    return suffixes.groupBy("group").applyInArrow(build, NODES)


def count_phrases(ws: Workspace, docs: DataFrame, max_words: int, min_count: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """(words (lang, phrase, h, f), phrases (lang, phrase, k, f) of 2 ..
    ``max_words`` words that occur ``min_count`` times) of ``docs(lang, text)``."""
    words = ws.saved(_prefix_counts(docs, 1, {}), "words")
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    budget = max(budget, -(-total // MOST_HEAVY))
    slots = 1 << max(10, min(22, (16 * total // budget).bit_length()))
    load = np.zeros(slots, np.int64)
    heavy: dict[tuple[str, int], pa.Array] = {}
    known = []
    prefixes = words.where(F.col("f") >= min_count)
    for depth in range(1, max_words + 1):
        light = (prefixes.where(F.col("f") <= budget).groupBy(F.col("h").bitwiseAND(F.lit(slots - 1)).alias("s")).agg(F.sum("f").alias("f"))).toPandas()
        np.add.at(load, light["s"].to_numpy(np.int64), light["f"].to_numpy(np.int64))
        # no more than total / budget, and so MOST_HEAVY, rows
        over = prefixes.where(F.col("f") > budget).select("lang", "phrase", F.lit(depth).alias("k"), "f")
        rows = over.select("lang", "phrase").collect()
        if not rows:
            break
        known.append(over)
        for lang in {r.lang for r in rows}:
            heavy[lang, depth] = pa.array([r.phrase for r in rows if r.lang == lang], pa.string())
        if depth < max_words:
            prefixes = ws.saved(_prefix_counts(docs, depth + 1, heavy), "prefixes")
    group_of = ((np.cumsum(load) - load) // budget).astype(np.int32)
    nodes = _nodes(_routes(docs, max_words, (heavy, _frequent_bits(words, min_count), group_of)), max_words, min_count)
    for over in known[1:]:
        nodes = nodes.union(over)
    return words, ws.saved(nodes, "nodes")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, min_count: int = 10,
                 contained: tuple[int, int] = (50, 100), top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """Each language's ``top`` phrases by score: (lang, rank, phrase, a, l, r,
    n, score). ``contained``: a phrase is dropped if a longer one that holds it
    has this share of its occurrences."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with Workspace(docs.sparkSession, "collocations") as ws:
        words, found = count_phrases(ws, docs, max_words, min_count, budget)
        sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
        known = words.where(F.col("f") >= min_count).select("lang", "phrase", "f").union(found.select("lang", "phrase", "f"))
        # the longest phrase around each phrase, one word longer
        inner = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
        around = (found.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("around"))
                  .groupBy("lang", "phrase").agg(F.max("around").alias("around")))
        part, whole = contained
        free = found.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (whole * F.col("around") < part * F.col("f")))
        cuts = free.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).selectExpr(
            "lang", "phrase", "a", "cut", "substring_index(phrase, ' ', cut) as first", "substring_index(phrase, ' ', cut - k) as rest")
        cuts = (cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
                .join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
        exact = "cast({} as decimal(15,0))".format
        score = F.expr(f"1000000 * {exact('a')} * {exact('a')} div ({exact('l')} * {exact('r')})")
        best = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
                .select("lang", "phrase", "a", "b.l", "b.r", "b.score"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return saved(ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
