"""Mixing by entropy balancing against a plain solution in Python."""

import math
import random
import re
from collections import defaultdict

import pytest

from colloquy.llm import queries
from colloquy.llm.entropy_mix import cyclic_weights, entropy_mix

SF = "/root/testdata/sf0.001"


def plain_targets(total, weight, most=3):
    """Water filling over {source: tokens}."""
    full, words = set(), sum(total.values())
    while True:
        left = words - sum(most * total[s] for s in full)
        free = sum(weight[s] for s in total if s not in full)
        new = {s for s in total if s not in full and weight[s] * left > most * total[s] * free}
        if not new:
            return {s: most * total[s] if s in full else (weight[s] * left / free if free else 0) for s in total}
        full |= new


def plain_rates(sizes, target, most=3):
    """The tilt by bisection."""
    words = sum(sizes)
    if target >= most * words:
        return [most] * len(sizes)
    low, high = -1e6, 1e6
    at = [s * len(sizes) / words for s in sizes]
    rate = lambda m, z: min(most, math.exp(min(50, m * z)))
    for _ in range(200):
        mid = (low + high) / 2
        if sum(s * rate(mid, z) for s, z in zip(sizes, at)) < target:
            low = mid
        else:
            high = mid
    return [rate(low, z) for z in at]


def check(rows, most=3):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    total = {s: sum(r.size or 0 for r in by[s]) for s in by}
    targets = plain_targets(total, {s: 1 + i % 3 for i, s in enumerate(order)}, most)
    for s, mine in by.items():
        assert all(r.source_size == total[s] and r.target == pytest.approx(targets[s]) for r in mine)
        assert all(0 <= r.copies <= most and r.taken == r.copies * (r.size or 0) for r in mine)
        longest, taken = max(r.size or 0 for r in mine), sum(r.taken for r in mine)
        assert abs(taken - targets[s]) <= longest
        if total[s]:
            for r, want in zip(mine, plain_rates([r.size or 0 for r in mine], targets[s], most)):
                assert r.rate == pytest.approx(want, rel=1e-5, abs=1e-6)
                assert not r.size or abs(r.copies - r.rate) < 2
    return targets


def test_query_against_plain_python(spark):
    rows = queries.QUERIES["op13_mix"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) for r in rows)
    check(rows)


def test_hot_sources_ties_repeats_and_nulls(spark):
    rng = random.Random(3)
    data = [(i, "hot", rng.randrange(1, 60)) for i in range(3000)]
    data += [(i, "same", 7) for i in range(3000, 4000)] + [(4000, "alike", 11)] * 900
    data += [(i, "zé", int(rng.lognormvariate(5, 1.5))) for i in range(5000, 5400)]
    data += [(6000, None, 5), (None, None, 9), (6001, None, None), (6002, "tiny", 2), (6003, "none", 0), (6004, "none", None)]
    table = spark.createDataFrame([(*d, "x", "y") for d in data], "doc_id long, source string, size long, taken string, rate string")
    first = entropy_mix(table, cyclic_weights(table))
    rows = first.collect()
    assert sorted((r.doc_id or 0, r.source or "", r.size or 0) for r in rows) == sorted((a or 0, b or "", c or 0) for a, b, c in data)
    targets = check(rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
    # whole copies come within a thousandth where copies can be changed
    assert all(abs(taken[s] - targets[s]) <= max(12, 0.001 * targets[s]) for s in ("hot", "same", "alike", "zé"))
    again = entropy_mix(table.repartition(13), cyclic_weights(table.repartition(3)))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_weights_follow_code_points(spark):
    table = spark.createDataFrame([(s,) for s in ("b", "a", None, "B", "ä", "b", "\U0001f600", "￮", "")], "source string")
    got = {r.source: r.weight for r in cyclic_weights(table).collect()}
    assert got == {"": 1, "B": 2, "a": 3, "b": 1, "ä": 2, "￮": 3, "\U0001f600": 1, None: 2}


@pytest.mark.parametrize("data", [[], [(1, "a", 0), (2, None, 0)], [(1, "a", 5)]])
def test_small_tables(spark, data):
    table = spark.createDataFrame(data, "doc_id long, source string, size long")
    rows = entropy_mix(table, cyclic_weights(table)).collect()
    assert [(r.doc_id, r.taken) for r in sorted(rows)] == [(d[0], d[2]) for d in data]


def test_a_source_without_weight_is_left_out(spark):
    table = spark.createDataFrame([(1, "a", 4), (2, "b", 4), (3, "b", 4)], "doc_id long, source string, size long")
    weights = spark.createDataFrame([("b", 2)], "source string, weight long")
    rows = entropy_mix(table, weights).collect()
    assert {r.doc_id: r.taken for r in rows} == {1: 0, 2: 4, 3: 8} or {r.doc_id: r.taken for r in rows} == {1: 0, 2: 8, 3: 4}
