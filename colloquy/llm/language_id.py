"""Language identification by cross-parsing entropy.

Learning: a bounded sample of labelled text per language becomes one suffix
automaton per language (letters only, any run of other characters is one
blank, and none before the first letter). Prediction: every text is parsed, from its first to its last
character, into the longest matches that the automaton offers, greedily; the
language with the least cross entropy explains the text best: its number of
phrases times the log of its sample's length, by the length of the text (the
estimate of Ziv and Merhav; the text's length is the same for all).

Every letter of a sample keeps its identity, whatever the script; letters that
no sample holds are one class, which no automaton knows.

The parse runs for thousands of text chunks at a time. The transitions of an
automaton lie in one sparse table: a state is the place where its row begins,
rows overlap, and each entry names the state that owns it. An entry of another
state is a missing transition, which restarts from the root; so a step is a few
table lookups for all chunks. A text longer than a chunk is parsed as if it were
whole: each chunk is parsed from its own start first, then again from where its
predecessor ended, up to the place where both parses agree, which is soon; a
text in which they do not within a chunk is parsed once more from end to end.

Only the sample is held in memory: at most ``SAMPLE_DOCS`` documents and
``SAMPLE_CHARS`` characters for each of at most ``MAX_LANGS`` languages; more
languages are an error.

Defined results: a null text or one without letters is ``und`` with score 0; a
tie goes to the alphabetically first language, so a text in a script of no
sample gets that language with score 0; without any labelled text all is ``und``; a null doc_id counts as the empty string; a null lang teaches
nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, tidied

SAMPLE_DOCS = 100
SAMPLE_CHARS = 30_000
MAX_LANGS = 200
CHUNK = 512
GROUP_CHARS = 2_000_000
UNKNOWN = "und"
TRAIL = 2  # places behind the last row laid that the next one tries first


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Forward transitions of the suffix automaton; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


def sparse_table(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, target, root): ``target[state + code]`` is the next state if
    ``owner`` of that place is the state, else a phrase starts and
    ``root[code]`` is next. State 0 owns nothing: there a phrase always starts."""
    row, begins, owner = [0] * len(step), {0}, {}
    low, entries = 1, -1
    for s in sorted(range(1, len(step)), key=lambda s: -len(step[s])):
        if len(step[s]) != entries:
            low, entries = 1, len(step[s])  # shorter rows fit between the others
        at = low
        while at in begins or not owner.keys().isdisjoint([at + c for c in step[s]]):
            at += 1
        low, row[s] = max(low, at - TRAIL), at
        begins.add(at)
        owner.update(dict.fromkeys([at + c for c in step[s]], at))
    root = np.zeros(width, np.int32)
    for c, t in step[0].items():
        root[c] = row[t]
    owners, target = np.full(max(begins) + width, -1, np.int32), np.zeros(max(begins) + width, np.int32)
    owners[list(owner)] = list(owner.values())
    for s in range(1, len(step)):
        for c, t in step[s].items():
            target[row[s] + c] = row[t]
    return owners, target, root


class Parser:
    """The automata of all languages and the common alphabet."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        seen = Counter("".join(samples.values()).lower())
        letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c.isalpha()]
        self.width = len(letters) + 2
        place = {c: n + 2 for n, c in enumerate(letters)}
        self.classes = np.zeros(0x110000, np.min_scalar_type(self.width))  # 0 blank, 1 a letter of no sample
        for i in range(0x110000):
            if chr(i).isalpha():
                self.classes[i] = place.get(chr(i).lower()[0], 1)
        learned = [self.codes(samples[x])[0].tolist() for x in self.langs]
        self.sizes = [len(x) for x in learned]
        self.tables = [sparse_table(suffix_automaton(x), self.width) for x in learned]

    def codes(self, text: str, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the characters with runs of blanks made one, and the
        place of each of ``starts`` in them."""
        raw = self.classes.take(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))
        keep = raw != 0
        keep[1:] |= raw[:-1] != 0
        return raw[keep], np.concatenate([[0], np.cumsum(keep)])[starts if starts is not None else [0]]

    @staticmethod
    def _step(table: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, does a phrase start) of one character for each state."""
        owners, targets, root = table
        at = state + codes
        known = owners.take(at) == state
        return np.where(known, targets.take(at), root.take(codes)), ~known

    @staticmethod
    def _whole(table: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray) -> int:
        """Phrases of one text from end to end."""
        owners, targets, root = (x.tolist() for x in table)
        state = made = 0
        for c in codes.tolist():
            if owners[state + c] == state:
                state = targets[state + c]
            else:
                state, made = root[c], made + 1
        return made

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(has letters, phrases by language) of each text."""
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        codes, at = self.codes("".join(x + " " for x in texts), at)
        has = np.add.reduceat(np.append(codes != 0, False), np.minimum(at[:-1], len(codes))) > 0
        has &= np.diff(at) > 0
        n, begins = np.diff(at), at
        count = -(-n // CHUNK)
        owner = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        first, size = at[owner] + nth * CHUNK, np.minimum(CHUNK, n[owner] - nth * CHUNK)
        order = np.argsort(-size, kind="stable")
        owner, first, size = owner[order], first[order], size[order]
        codes = np.append(codes, np.zeros(CHUNK, codes.dtype))
        grid = codes[first[None, :] + np.arange(CHUNK)[:, None]] if len(first) else np.zeros((CHUNK, 0), codes.dtype)
        active = np.searchsorted(-size, -np.arange(CHUNK), "left")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        later = np.flatnonzero(nth[order] > 0)  # chunks with one before them, which lies in place ``before``
        before = rank[order[later] - 1]
        last = (nth == count[np.repeat(np.arange(len(texts)), count)] - 1)[order]
        for lang, table in enumerate(self.tables):
            state, made = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
            states, begun = np.zeros((CHUNK, len(first)), np.int32), np.zeros((CHUNK, len(first)), bool)
            for t in range(CHUNK):
                a = active[t]
                if a == 0:
                    break
                state[:a], begun[t, :a] = self._step(table, state[:a], grid[t, :a])
                states[t, :a] = state[:a]
                made[:a] += begun[t, :a]
            lost = np.zeros(len(texts), bool)
            on, now, more, t = later, state[before], np.zeros(len(later), np.int32), 0
            while len(on):
                ended = size[on] <= t
                if ended.any():  # the two parses did not meet
                    lost[owner[on[ended & ~last[on]]]] = True
                    made[on[ended]] += more[ended]
                    on, now, more = on[~ended], now[~ended], more[~ended]
                    continue
                now, starts = self._step(table, now, grid[t, on])
                more += starts.astype(np.int32) - begun[t, on]
                met = now == states[t, on]
                made[on[met]] += more[met]
                on, now, more, t = on[~met], now[~met], more[~met], t + 1
            out[lang] = np.bincount(owner, made, len(texts))
            for i in np.flatnonzero(lost).tolist():
                out[lang, i] = self._whole(table, codes[begins[i]:begins[i + 1]])
        return has, out.T

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        has, n = self.phrases(texts)
        cost = n * np.log(np.maximum(self.sizes, 2))
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(n)), best]
        if len(self.langs) > 1:
            second = np.partition(cost, 1, axis=1)[:, 1]
            score = 1 - least / np.maximum(second, 1)
        else:
            score = np.ones(len(n))
        return ([self.langs[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())],
                np.where(has, score, 0.0).tolist())


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", by: str = "doc_id") -> dict[str, str]:
    """The bounded sample: {language: text}. Documents are drawn by the hash
    of their id, a few for each language and task before any shuffle."""
    pick = Window.partitionBy("lang").orderBy("_h", "_id")
    drawn = (labelled.where(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0))
             .select(F.col(lang).alias("lang"), F.col(by).alias("_id"), F.xxhash64(by).alias("_h"),
                     F.substring(text, 1, SAMPLE_CHARS // 4).alias("text"))
             .withColumn("_n", F.row_number().over(pick)).where(F.col("_n") <= SAMPLE_DOCS)
             # only what the character bound can take leaves the executors
             .withColumn("_past", F.coalesce(F.sum(F.length("text") + 1).over(
                 pick.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .where(F.col("_past") < SAMPLE_CHARS).orderBy("lang", "_n").limit((MAX_LANGS + 1) * SAMPLE_DOCS))
    found: dict[str, str] = {}
    for r in drawn.select("lang", "text").toLocalIterator():
        found[r["lang"]] = (found.get(r["lang"], "") + r["text"] + " ")[:SAMPLE_CHARS]
        if len(found) > MAX_LANGS:
            raise ValueError(f"more than {MAX_LANGS} languages: label fewer, or split the documents")
    return found


def _parser(samples: dict[str, str]) -> Parser:
    """One parser for each worker process and model."""
    key = ("parser", repr(sorted(samples.items())))
    return held(key, lambda: Parser(samples))


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text", keep: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score added, without its text unless told
    to ``keep`` it."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep or c != text)]
    source = docs.select(*kept, F.col(text).alias("_text"))
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for b in batches:
            lang, score, group, held = [], [], [], 0
            col = b.column(b.num_columns - 1)
            for i, x in enumerate(col):
                group.append(x.as_py() or "")
                held += len(group[-1])
                if held >= GROUP_CHARS or i + 1 == len(col):
                    p, s = parser.predict(group)
                    lang += p
                    score += s
                    group, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                [*kept, "lang_pred", "score"])

    return source.mapInArrow(tidied(run), schema)


def rejected(pred: str = "lang_pred") -> Column:
    """No language at all. A low score is no reason: languages that are close,
    or two labels of one, explain a clean text alike."""
    return F.col(pred) == UNKNOWN


def is_held_out(by: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(by).cast("string"), F.lit("")).cast("binary")) % 3 == 1
