"""Periodic runs against a plain definition, and their query against Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from colloquy.llm import queries
from colloquy.llm.periodic_runs import find_runs, periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(ws, min_length=24, exponent=3):
    """Every maximal repetition, from the definition: for each period the
    maximal stretches that keep it, less those with a smaller period."""
    n, found = len(ws), []
    seen = set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, exponent * q) and (i, length) not in seen:
                seen.add((i, length))  # the first q to come is the smallest
                found.append((i, length, q))
            i = j
    return sorted(found)


def collapse(ws, runs):
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


@pytest.mark.parametrize("least,exponent", [(24, 3), (2, 3), (7, 3), (30, 5)])
def test_runs_of_small_alphabets_against_the_definition(least, exponent):
    rng = random.Random(least)
    texts = [[rng.randrange(2) for _ in range(rng.randrange(90))] for _ in range(150)]
    for _ in range(150):  # texts made of repeated blocks, nested and overlapping
        t = []
        while len(t) < 150:
            block = [rng.randrange(3) for _ in range(rng.randrange(1, 17))]
            t += block * rng.randrange(1, 12) + block[:rng.randrange(len(block))]
        texts.append(t)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = find_runs(np.array([c for t in texts for c in t], np.int64), bounds, least, exponent)
    owner = np.searchsorted(bounds, got[0], "right") - 1
    for i, t in enumerate(texts):
        mine = owner == i
        assert [(int(s - bounds[i]), int(n), int(q)) for s, n, q in zip(*(g[mine] for g in got))] == plain_runs(t, least, exponent)


def test_edges(spark):
    same, line = "ha " * 5000, "one two three four five six seven eight\n"
    texts = [None, "", " \n\x0b", "ha " * 23, "ha " * 24, same, line * 3, line * 2, "é x " * 30, line * 3, "y" * 100_000]
    table = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, runs string, period string")
    rows = periodic_runs(table).orderBy("doc_id").collect()
    assert [r.n_words for r in rows] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert [[tuple(x) for x in r.runs] for r in rows] == [
        [], [], [], [], [(0, 24, 1)], [(0, 5000, 1)], [(0, 24, 8)], [], [(0, 30, 1)], [(0, 24, 8)], []]
    assert rows[4].collapsed == "ha" and rows[6].collapsed == line.strip() and rows[0].collapsed == ""
    assert {r.period for r in rows} == {"b"}
    assert periodic_runs(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_runs(np.zeros(3, np.int64), np.array([0, 3]), 24, 2)


def test_query_against_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(docs)
    some = 0
    for r in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        n, h = len(ws), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(ws) if n < 1500 or h % 10 == 0 else [tuple(map(int, x)) for x in zip(*find_runs(
            np.unique(ws, return_inverse=True)[1].astype(np.int64), np.array([0, n])))]
        some += len(runs)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3) and r.n_runs == len(runs)
        assert r.exponent_milli == (None if best is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(ws, runs).encode()).hexdigest()
    assert some > 5
