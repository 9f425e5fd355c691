"""Collocations against counts in plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from colloquy.llm import collocations as co
from colloquy.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, phrase string, rank int"


def plain(rows, max_words=3, min_count=10, contained=(50, 100), top=2000):
    count, size = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(ws)
            for k in range(1, max_words + 1):
                count[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inner = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i:i + k]] = max(inner[p[i:i + k]], a)
        ranked = []
        for p, a in found.items():
            if contained[1] * inner[p] >= contained[0] * a:
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, size[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")


@pytest.mark.parametrize("budget,chunk,settings", [
    (1 << 18, 1 << 23, {}), (300, 4096, {}), (40, 20_000, {}), (25, 3000, {"max_words": 5, "min_count": 3, "contained": (80, 100), "top": 50})])
def test_against_plain_counts(spark, table, monkeypatch, budget, chunk, settings):
    """Whole; with words, then pairs and phrases beyond the budget; deeper."""
    monkeypatch.setattr(co, "CHUNK", chunk)
    got = co.collocations(table, budget=budget, **settings)
    assert sorted(tuple(r) for r in got.collect()) == plain(table.collect(), **settings)


def test_edges(spark):
    texts = [(None, "en"), ("", "en"), (" \t\n.", None), ("A b" + "\tc" * 3, None), ("é漢 x,é漢 x! é漢  X\n" * 5, "fr"),
             ("hot word " * 3000, "en"), ("one two three four. " * 12, "en")] + [("same line here now\r\x0bsame line", "xx\ty")] * 20
    rows = [(i, t, g, "x", 1) for i, (t, g) in enumerate(texts)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in co.collocations(table, budget=100).collect())
    assert got == plain(texts) and {r[0] for r in got} == {"en", "fr", "xx\ty"}
    assert co.collocations(table.limit(0)).count() == 0


def test_counts_beyond_64_bits(spark):
    row = spark.sql("select 1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as s "
                    "from values (99999999999999L, 99999999999999L, 100000000000001L) as t(a, l, r)").first()
    assert row.s == 1000000 * 99999999999999**2 // (99999999999999 * 100000000000001)


def test_query_is_the_operator_on_the_whole_table(spark, table):
    got = queries.QUERIES["op12_collocations"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == plain(table.collect())
