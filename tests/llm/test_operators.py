"""Small brute-force and edge-case tests of the operators."""

import contextlib
import hashlib
import io
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import (chat_tools, common, decontaminate, jaccard_join, language_id, permutation_index, queries, secret_scan,
                          sentencepiece_codec, substring_dedup, token_counts, url_filter)
from colloquy.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, ids string, rule string, base string"


def docs(spark, texts):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.read_model(queries.MODEL)


# ---- 1: SentencePiece ------------------------------------------------------

EDGES = [None, "", " ", "a  b", "é\n漢字\u0000", "▁▁a b", "\n\n", "x" * 70_000, "the cat " * 9000, "a", "a"]


def test_codec_agrees_with_the_library(spark, model):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = sentencepiece_codec.encode(docs(spark, EDGES), model).orderBy("doc_id").collect()
    for text, row in zip(EDGES, rows):
        if text is None:
            assert row.ids is None and row.n_tokens == 0 and row.parity and row.lossless
        else:
            assert row.ids == judge.encode(text) and row.n_tokens == len(row.ids) and row.parity
            assert row.lossless == (judge.decode(row.ids) == text)
    assert not rows[5].lossless  # the marks of the text come back as blanks


def test_codec_on_the_whole_table_and_back(spark, model):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_proto=model)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(table, model), model).collect()
    assert len(rows) == 200
    assert all(r.ids == judge.encode(r.text) and r.decoded == r.text for r in rows)


def unigram_proto(pieces):
    """A tiny unigram model, field by field."""
    import struct

    def message(field, data):
        return bytes([field << 3 | 2, len(data)]) + data

    out = b""
    for piece, score, kind in pieces:
        p = piece.encode()
        out += message(1, message(1, p) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))
    return out + message(2, b"\x18\x01") + message(3, message(1, b"identity") + b"\x18\x01\x20\x01")


PIECES = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.6, 1), ("▁a", -2.0, 1),
          ("ab", -2.2, 1), ("▁ab", -4.0, 1), ("ba", -2.9, 1), ("aba", -3.7, 1)]


def test_unigram_model_agrees_with_the_library():
    import sentencepiece

    data = unigram_proto(PIECES)
    judge, codec = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_codec.Codec(data)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(30))) for _ in range(300)]
    for text, (ids, parity, lossless) in zip(texts, codec.encode_batch(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == judge.encode(text) and parity
        assert lossless == (judge.decode(judge.encode(text)) == text)


# ---- 5: token counts -------------------------------------------------------

def test_trie_counts_match_a_plain_viterbi(model):
    for data in (unigram_proto(PIECES), model):
        m = sentencepiece_codec.Model(data)
        counter = token_counts.TrieCounter(m)
        rng = random.Random(5)
        letters = "ab▁" if len(m.pieces) < 50 else "abcdeth▁éж"
        units = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(400)}
        got = counter.counts(units)
        for u in units:
            best = [(0.0, 0)] + [(-1e18, 0)] * len(u)
            for end in range(1, len(u) + 1):
                for start in range(end):
                    s = counter.scores.get(u[start:end])
                    n = 1
                    if s is None and end - start == 1:
                        s, n = counter.unknown, len(u[start:end].encode()) if m.byte_fallback else 1
                    if s is not None:
                        a, b = best[start][0] + s, best[start][1] + n
                        if a > best[end][0] or (a == best[end][0] and b < best[end][1]):
                            best[end] = (a, b)
            assert got[u] == best[-1][1]


def test_unigram_counts_match_the_library():
    import sentencepiece

    data = unigram_proto(PIECES)
    judge, counter = sentencepiece.SentencePieceProcessor(model_proto=data), token_counts.Counter(data)
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(30))) for _ in range(300)]
    assert counter.batch(texts)[1] == [len(judge.encode(t)) for t in texts]


def test_token_counts_edges(spark, model):
    rows = token_counts.count_tokens(docs(spark, EDGES), model).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows][:2] == [0, 0] and rows[-1].n_tokens == rows[-2].n_tokens == 1
    assert token_counts.count_tokens(docs(spark, EDGES).limit(0), model).count() == 0


# ---- 2: chat tools ---------------------------------------------------------

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"


def linked(spark, calls, results):
    out = chat_tools.link_calls(spark.createDataFrame(calls, CALLS),
                                spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"),
                                spark.createDataFrame(queries.SCHEMAS, queries.TOOLS))
    return {(r.conv_id, r.call_id): r for r in out.collect() if r.status not in ("no_id", "duplicate_id", "extra_result")}


def test_calls_are_linked_validated_and_ordered(spark):
    ok = '{"query": "q", "limit": 3}'
    got = linked(spark, [
        (1, 1, "a", "lookup", ok, ["c"]), (1, 3, "b", "lookup", '{"limit":"x","z":1}', ["a"]), (1, 5, "c", "lookup", ok, None),
        (1, 7, "d", "lookup", ok + " junk", ["nowhere"]), (1, 9, "b", "lookup", ok, None),
        (2, 1, "x", "none", ok, ["y"]), (2, 2, "y", None, None, ["x"]), (None, 1, "q", "lookup", ok, None),
    ], [(1, 2, "a", "one"), (1, 6, "a", "two"), (1, 1, "c", "early"), (3, 1, "o", "alone"), (None, 1, "a", "x")])
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "x"), (2, "y"), (3, "o")}
    assert got[1, "a"].status == "linked" and (got[1, "a"].result_turn, got[1, "a"].n_results) == (2, 2)
    assert json.loads(got[1, "a"].message) == {"arguments": {"limit": 3, "query": "q"}, "id": "a", "name": "lookup", "result": "one"}
    assert got[1, "a"].message == json.dumps(json.loads(got[1, "a"].message), sort_keys=True, separators=(",", ":"))
    assert got[1, "b"].status == "no_result" and got[1, "b"].n_calls == 2 and got[1, "b"].errors == "missing:query,type:limit,unknown:z"
    assert got[1, "c"].status == "result_before_call"
    assert got[1, "d"].status == "unknown_dependency" and got[1, "d"].errors == "not_json_object"
    assert got[3, "o"].status == "orphan_result"
    assert "cycle" in (got[2, "x"].status, got[2, "y"].status)
    order = sorted((r for k, r in got.items() if k[0] == 1), key=lambda r: (r.order_key, r.order_hop, r.turn))
    names = [r.call_id for r in order]
    assert names.index("c") < names.index("a") < names.index("b")


def test_order_is_topological_on_random_graphs(spark):
    rng = random.Random(8)
    calls, edges = [], {}
    for conv in range(12):
        n = rng.randrange(1, 14)
        rank = rng.sample(range(n), n)  # acyclic: depends on lower ranks only
        for t in range(n):
            on = [u for u in range(n) if rank[u] < rank[t] and rng.random() < 0.25]
            edges[conv, t] = on
            calls.append((conv, t, str(t), "lookup", "{}", [str(u) for u in on]))
    got = linked(spark, calls, [(99, 1, "z", "z")])
    key = {(c, int(i)): (r.order_key, r.order_hop, r.turn) for (c, i), r in got.items() if c != 99}
    assert all(key[c, u] < key[c, t] for (c, t), on in edges.items() for u in on)
    assert not any(r.status == "cycle" for r in got.values())


def test_no_call_and_no_result_is_lost(spark):
    """Every input row is an output row, or the linked partner of one."""
    ok = '{"query": "q", "limit": 1.0}'
    calls = [(1, 1, "a", "lookup", ok, None), (1, 4, "a", "search", '{"query": 5}', ["x"]), (1, 1, "a", "lookup", ok, None),
             (None, 1, "a", "lookup", ok, None), (1, None, "a", "lookup", "junk", None), (1, 2, None, None, None, None), (2, 1, "h", "lookup", ok, None)]
    calls += [(7, 1, "hot", "lookup", ok, None)] * 60
    results = [(1, 9, "a", "late"), (1, 2, "a", "first"), (1, 2, "a", "first"), (1, 3, None, "lost"), (None, None, None, None), (3, 1, "o", "x"), (3, 2, "o", "y")]
    tables = (spark.createDataFrame([(*c, "x", "y") for c in calls], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, status string, message string"),
              spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), spark.createDataFrame(queries.SCHEMAS, queries.TOOLS))
    got = chat_tools.link_calls(*tables).collect()
    by = lambda s: sorted(((r.conv_id, r.call_id, r.turn, r.result_turn, json.loads(r.message).get("result")) for r in got if r.status == s), key=str)
    assert by("linked") == [(1, "a", 1, 2, "first")]  # 1.0 is an integer
    assert by("duplicate_id") == sorted([(1, "a", 1, None, None), (1, "a", 4, None, None)] + [(7, "hot", 1, None, None)] * 59, key=str)
    assert by("extra_result") == sorted([(1, "a", None, 2, "first"), (1, "a", None, 9, "late"), (3, "o", None, 2, "y")], key=str)
    assert by("orphan_result") == [(3, "o", None, 1, "x")]
    assert by("no_id") == sorted([(None, "a", 1, None, None), (1, "a", None, None, None), (1, None, 2, None, None), (1, None, None, 3, "lost"),
                                  (None, None, None, None, None)], key=str)
    assert by("no_result") == sorted([(2, "h", 1, None, None), (7, "hot", 1, None, None)], key=str)
    assert len(got) == len(calls) + len(results) - 1  # one pair is linked
    assert [r.errors for r in got if r.status == "duplicate_id" and r.turn == 4] == ["type:query"]
    empty = [t.limit(0) for t in tables[:2]]
    assert chat_tools.link_calls(*empty, tables[2]).count() == 0


@pytest.mark.parametrize("value,good", [("1", True), ("1.0", True), ("1e2", True), ("-0.0", True), ("1.5", False), ("1e-3", False), ('"1"', False), ("true", False),
                                        ("9007199254740993.5", False), ("123456789012345678901234567890", True)])
def test_integers_are_judged_by_value(spark, value, good):
    row = linked(spark, [(1, 1, "a", "search", f'{{"query":"q","limit":{value}}}', None)], [(1, 2, "a", "r")])[1, "a"]
    assert row.errors == ("" if good else "type:limit")


def plain_errors(name, arguments):
    try:
        value = json.loads(arguments)
    except ValueError:
        return "not_json_object"
    out = []
    for tool, field, kind, required in queries.SCHEMAS:
        if tool != name:
            continue
        if field not in value:
            out += [f"missing:{field}"] if required else []
            continue
        v = value[field]
        fits = {"string": isinstance(v, str), "boolean": isinstance(v, bool), "integer": isinstance(v, int) and not isinstance(v, bool),
                "number": isinstance(v, int | float) and not isinstance(v, bool)}[kind]
        out += [] if fits else [f"type:{field}"]
    known = {f for t, f, _, _ in queries.SCHEMAS if t == name}
    return ",".join(sorted(out + [f"unknown:{k}" for k in value if k not in known]))


def test_tool_query_against_python(spark):
    """Status, order and errors of every row, recomputed."""
    calls, results = (t.collect() for t in queries.tool_rows(spark.read.parquet(f"{SF}/conversations.parquet")))
    asked = {(r.conv_id, r.call_id): r for r in calls}
    given = {(r.conv_id, r.call_id): r for r in results}
    assert len(asked) == len(calls) and len(given) == len(results)
    rows = queries.QUERIES["op2_chat_tools"](spark, SF).collect()
    got = {(r.conv_id, r.call_id): r for r in rows}
    assert len(rows) == len(got) and set(got) == set(asked) | set(given)

    def on(k):
        return [(k[0], d) for d in asked[k].depends_on if (k[0], d) in asked]

    # each call depends on one other, so a cycle is two calls that name each other; the later one is cut
    cut = {k for k in asked for d in on(k) if k in on(d) and asked[d].turn < asked[k].turn}

    def order(k):
        best = (asked[k].turn, 0)
        for d in (on(k) if k not in cut else []):
            turn, hop = order(d)
            if turn >= asked[k].turn:
                best = max(best, (turn, hop + 1))
        return best

    for k, r in got.items():
        if k not in asked:
            assert r.status == "orphan_result" and r.order_key == given[k].turn
            continue
        c = asked[k]
        errors = plain_errors(c.name, c.arguments)
        assert r.errors == errors and (r.order_key, r.order_hop) == order(k), k
        missing = any((k[0], d) not in asked for d in c.depends_on)
        result = given[k].turn if k in given else None
        assert r.status == ("cycle" if k in cut else "unknown_dependency" if missing else "no_result" if result is None
                            else "result_before_call" if result <= c.turn else "invalid" if errors else "linked"), k
        if errors != "not_json_object":
            assert r.message == json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


# ---- 3: decontamination ----------------------------------------------------

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def test_least_distance_against_all_runs():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 12))
        d, end = decontaminate.least_distance(a, b)
        runs = [(edit_distance(a, b[i:j]), j) for i in range(len(b) + 1) for j in range(i, len(b) + 1)]
        assert d == min(runs)[0] and (d == len(a) or (d, end) in runs)


def test_decontamination_finds_edited_items_and_nothing_else(spark):
    rng = random.Random(11)
    bench = [(i, " ".join(words(rng, rng.randrange(12, 60), 3000))) for i in range(40)] + [(90, None), (91, ""), (92, "too short")]
    texts, truth = [None, ""], {}
    for n in range(300):
        body = words(rng, rng.randrange(0, 200), 3000)
        if n % 2:
            i, item = bench[rng.randrange(40)]
            x = item.split()
            for _ in range(int(len(x) * 0.2) if n % 4 == 1 else 1):
                kind, at = rng.randrange(3), rng.randrange(len(x))
                x[at:at + (kind != 0)] = ["New"] * (kind != 2)
            truth[len(texts)] = i
            body[len(body) // 2:0] = [w.upper() + "," for w in x]
        texts.append(" ".join(body))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, texts), b, ["doc_id"]).collect()}
    found = sum((d, i) in got for d, i in truth.items())
    assert found >= 0.95 * len(truth)
    assert all(truth.get(d) == i for d, i in got)  # clean documents are left alone
    kept = {r.doc_id for r in decontaminate.clean(docs(spark, texts), b).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.contaminated(docs(spark, texts), b.limit(0), ["doc_id"]).count() == 0


def test_items_that_walks_do_not_reach_are_found_exactly(spark, monkeypatch):
    """One walk is too few for any class, as 300 are for items of 1,000 words."""
    monkeypatch.setattr(decontaminate, "MOST_REPEATS", 1)
    rng = random.Random(12)
    bench = [(i, " ".join(words(rng, n, 3000))) for i, n in enumerate([15, 16, 59, 60, 200, 1500])]
    texts, truth = [], {}
    for n in range(90):
        i, item = bench[n % len(bench)]
        x = item.split()
        most = len(x) // 5
        for _ in range(most + n // 60):  # the last third has one edit too many
            x[rng.randrange(len(x))] = f"new{rng.randrange(10**9)}"
        body = words(rng, 40, 3000)
        body[20 * (n % 3):0] = x
        d, _ = decontaminate.least_distance(np.array([hash(w) for w in item.split()]), np.array([hash(w) for w in body]))
        if d <= most:
            truth[n, i] = d
        texts.append(" ".join(body))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, texts), b, ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == truth and len(truth) >= 60
    for r in got:
        run = texts[r.doc_id].split()[r.start_word:r.end_word]
        assert edit_distance(bench[r.item_id][1].split(), run) == r.distance


def test_short_items_and_scripts_without_spaces_are_found(spark):
    bench = [(0, "Zebra!"), (1, "is it so?"), (2, "who wrote this old book"), (3, "one two three four five six seven"), (4, "中国的首都是哪里？"),
             (5, "什么"), (6, "กรุงเทพอยู่ที่ไหน"), (7, "?!"), (8, "東京タワーの高さは何メートルですか、教えてください。"), (9, " ")]
    texts = {"a zebra, here": {(0, 0)}, "zebras": set(), "Is it -- so": {(1, 0)}, "is it not so": set(), "ab who wrote that old book cd": {(2, 1)},
             "who wrote that new book": set(), "one two 3 four five six seven": {(3, 1)}, "one two four five six": set(),
             "问：中国的首都是哪里呢": {(4, 0)}, "中国的首都在哪里": {(4, 1)}, "他国底首部是哪里": set(), "他说什么": {(5, 0)}, "什 么": {(5, 0)}, "么什": set(),
             "ถามว่ากรุงเทพอยู่ที่ไหนครับ": {(6, 0)}, "?! ！": set(), "では東京タワーの高さは何メートルでしょうか 教えてください": {(8, 3)}, "only words": set()}
    b = spark.createDataFrame(bench, "item_id long, text string")
    table = docs(spark, [None, *texts])
    got = decontaminate.contaminated(table, b, ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == {(n + 1, i, d) for n, held in enumerate(texts.values()) for i, d in held}
    kept = {r.doc_id for r in decontaminate.clean(table, b).collect()}
    assert kept == {0} | {n + 1 for n, held in enumerate(texts.values()) if not held}


# ---- 4: secrets ------------------------------------------------------------

def test_base_spans_against_python(spark):
    pool = ["password=", "Token: '", "api_key=", "apikey :", "secret\"= ", "AKIA", "ABCDEFGH12345678", "deadbeef01", "0123456789abcdef", " ",
            "é", "😀", "x", "hunter2hunter2", "\n", "passwd:", "token=api_key: ", "zzzzzzzzzzzz"]
    rng = random.Random(2)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, ""]
    kinds = (("assign", r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
              lambda m: len(m[2]) >= 12), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16))
    got = secret_scan.scan(docs(spark, texts)).select("doc_id", secret_scan.listed(F.col("base")).alias("l"), "spans", "base").collect()
    assert len(got) == len(texts)
    for r in got:
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, texts[r.doc_id] or "") if ok(m))
        assert r.l == ",".join(f"{n}:{s}:{e}" for s, _, n, e in spans)
        assert all(b in r.spans for b in r.base)


def test_candidates_are_the_runs_that_no_base_span_touches(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "STEP", 3)
    pool = ["password=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", " ", "é", "-", "/", "QWERTYUIOPASDFGHJKLZ", "zxcvbnmasdfghjklqwer", "token=", "x"]
    rng = random.Random(9)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(300)]
    table = docs(spark, texts).withColumn("base", secret_scan.base_spans(F.col("text")))
    some = 0
    for r in table.withColumn("c", secret_scan.candidates(F.col("text"), F.col("base"))).collect():
        runs = [(m.start(), m.end()) for m in re.finditer(secret_scan.CANDIDATE, r.text)]
        free = [(a, b) for a, b in runs if not any(x.start < b and a < x.end for x in r.base)]
        assert [(x.start, x.end) for x in r.c] == free
        some += len(runs) > len(free) > 0
    assert some > 20


def test_a_long_list_of_hashes(spark):
    """A megabyte of lines; the time grows in proportion, so this ends."""
    line = "".join(random.Random(1).choice("0123456789abcdef") for _ in range(32))
    r = secret_scan.scan(docs(spark, [(line + "\n") * 30_000])).select(F.size("spans").alias("n"), F.col("spans")[29_999]["start"].alias("s")).first()
    assert (r.n, r.s) == (30_000, 33 * 29_999)


def test_random_strings_are_found_and_words_are_not(spark):
    import base64

    rng = random.Random(4)
    texts = [f"see {base64.b64encode(rng.randbytes(33)).decode()} here" for _ in range(60)]
    texts += [f"the antidisestablishmentarianism/{w}/internationalization path" for w in ("one", "two", "three")] * 20
    got = secret_scan.scan(docs(spark, texts)).orderBy("doc_id").select("spans", secret_scan.masked(F.col("text"), F.col("spans")).alias("m")).collect()
    assert sum(len(r.spans) == 1 for r in got[:60]) >= 50
    assert all(r.m == "see [SECRET] here" for r in got[:60] if r.spans and r.spans[0].start == 4 and len(r.spans[0].value) == 44)
    assert not any(r.spans for r in got[60:])
    assert secret_scan.scan(docs(spark, texts).limit(0)).count() == 0


#: Least share found of random strings of 20, 32, 40 and 64 symbols. Digits are
#: base spans; 20 symbols of the three middle alphabets are too few for the test.
RECALL = {"digits": (1, 1, 1, 1), "hex": (0.95, 0.95, 0.95, 0.95), "base32": (0, 0.4, 0.7, 0.95), "lower": (0, 0.6, 0.85, 0.95),
          "upper": (0, 0.6, 0.85, 0.95), "alnum": (0.8, 0.95, 0.95, 0.95), "base64": (0.8, 0.95, 0.95, 0.95)}


def test_recall_of_each_encoding_and_length(spark):
    rng = random.Random(15)
    asked, texts = [], []
    for name, _, alphabet, *_ in secret_scan.ENCODINGS[:-1]:
        for n in (20, 32, 40, 64):
            for _ in range(100):
                asked.append((name, n))
                texts.append("see " + "".join(rng.choice(alphabet.upper() if name == "hex" else alphabet) for _ in range(n)) + " here")
    plain = ["DEADBEEFCAFEFACEDECADE", "FACADEDEADBEEFDECADEBEADEDFADEDACCEDED", "00000000000A00000000000B00000000000C", "ABABABABABABABABABABAB",
             "F" * 64]
    got = secret_scan.scan(docs(spark, texts + plain)).orderBy("doc_id").select(F.size("spans").alias("n")).collect()
    found = {}
    for key, r in zip(asked, got):
        found.setdefault(key, []).append(r.n == 1)
    share = {key: sum(x) / len(x) for key, x in found.items()}
    assert {(name, n): share[name, n] for name, leasts in RECALL.items() for n, least in zip((20, 32, 40, 64), leasts) if share[name, n] < least} == {}
    assert not any(r.n for r in got[len(asked):])


# ---- 6: passages -----------------------------------------------------------

@pytest.mark.parametrize("shard", [2000, 1])
def test_passages_against_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    rng = random.Random(9)
    common = [words(rng, n, 5000) for n in (49, 50, 51, 120, 200)]
    texts = [None, "", "one\x0btwo", "é \u00a0 x"]
    for _ in range(60):
        body = words(rng, rng.randrange(0, 80), 5000)
        for _ in range(rng.randrange(3)):
            c = rng.choice(common)
            a = rng.randrange(0, 20)
            body += c[a:] + words(rng, rng.randrange(0, 9), 5000)
        texts.append(rng.choice([" ", "\n", "\t "]).join(body))
    texts += [texts[10], texts[10], "of " * 3000, "of " * 400]
    first, expected = {}, {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s:s + 50]), i) < i:
                gone[s:s + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        expected[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    table = docs(spark, texts).union(spark.createDataFrame([(None, texts[10], "en", "", "", "")], DOCS))
    got = substring_dedup.remove_repeats(table).collect()
    assert len(got) == len(texts) + 1
    assert {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in got if r.id is not None} == expected
    assert next(r.n_removed for r in got if r.id is None) == 0
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


# ---- 7: Jaccard join -------------------------------------------------------

def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        w = [bytes(x).lower() for x in w]
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "num", "slices"), [(3, 90, 1000), (5, 80, 1000), (3, 90, 3)])
def test_join_against_all_pairs(spark, n, num, slices, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE", slices)
    rng = random.Random(n * num)
    texts = [None, "", " ", "a", "A", "a b", "x y z", "X y  z", "x y z x y z"]
    passage = words(rng, 60, 5000)
    for _ in range(10):
        base = words(rng, rng.choice([8, 12, 30, 60, 120]), 5000)
        for _ in range(rng.choice([1, 3, 9])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = f"w{rng.randrange(9999)}"
            texts.append(" ".join(t))
        texts.append(" ".join(words(rng, 30, 5000) + passage))
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.similar(docs(spark, texts), n, num, 100).collect()}
    assert got == brute_components(texts, n, num, 100)


def test_join_on_an_empty_table(spark):
    assert jaccard_join.similar(docs(spark, ["a"]).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for e in links for x in e if e[0] != e[1]}


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def keeping(made):
    """``saved`` that notes what it was given."""
    def run(df, tag):
        made.append((tag, plan_of(df)))
        return common.saved(df, tag)
    return run


def test_components_broadcast_nothing(spark):
    """Each broadcast of a round is a hash table in the driver."""
    made, links = [], [(i, i + 1) for i in range(20)] + [(30, 40), (30, 41)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), keeping(made)).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 40: 30, 41: 30}
    assert len(made) > 2 and not [p for _, p in made if "Broadcast" in p] and all("SortMergeJoin" in p for _, p in made[1:])


def test_components_stop_at_stars(spark):
    """Links that are stars already take no round, others none to confirm the last."""
    for links, rounds in (([(5, 1), (1, 6), (9, 8), (6, 1), (2, 2)], 0), ([(2, 1), (3, 2)], 1), ([(2, 2)], 0), ([], 0)):
        made = []
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), keeping(made)).collect()}
        assert got == ({5: 1, 1: 1, 6: 1, 9: 8, 8: 8} if len(links) > 2 else {1: 1, 2: 1, 3: 1} if len(links) > 1 else {})
        assert [t for t, _ in made] == ["links"] + ["stars"] * rounds


def test_group_steps_broadcast_nothing(spark):
    rows = [(g, i, i % 3 if g else 0, 5) for g in range(4) for i in range(g, g + 5)]
    told = common.saved(spark.createDataFrame(rows, "gram long, id long, component long, size long"), "told")
    for step in (jaccard_join._distinct, jaccard_join._merged, jaccard_join._dealt):
        assert "Broadcast" not in plan_of(step(told))
    assert {r.gram for r in jaccard_join._distinct(told).collect()} == {1, 2, 3}


# ---- 8: urls ---------------------------------------------------------------

def test_urls_edges(spark):
    urls = [None, "", "nope", "http://A.example.ORG/en/12?x", "http://example.org/es", "https://notexample.org/es/", "x://com/de/",
            "http://a.com/fr/#t", "http://org", "http://a.b.org/", "s://é.com/de/x/y"]
    table = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(table, queries.RULES).orderBy("page_id").collect()]
    assert got[:3] == [("", "", None, "allow")] * 3
    assert got[3] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[4] == ("example.org", "/es", "org/", "allow") and got[5] == ("notexample.org", "/es/", "org/", "allow")
    assert got[6] == ("com", "/de/", "com/de/", "block") and got[7][2:] == ("com/fr/", "allow")
    assert got[8] == ("org", "", None, "allow") and got[9][2] == "org/" and got[10][3] == "block"
    with pytest.raises(ValueError):
        url_filter.RuleTrie([("allow", "a", "/"), ("block", "a", "/")])


def test_trie_against_all_rules():
    rng = random.Random(7)
    hosts = ["a", "b.a", "c.b.a", "x"]
    rules, seen = [], set()
    for _ in range(30):
        h, p = rng.choice(hosts), rng.choice(["", "/"]) + "/".join(rng.choice(["p", "pq", ""]) for _ in range(rng.randrange(3)))
        if (h, p) not in seen:
            seen.add((h, p))
            rules.append((rng.choice(["allow", "block"]), h, p))
    trie = url_filter.RuleTrie(rules)
    for _ in range(500):
        host = ".".join(rng.choice("abcx") for _ in range(rng.randrange(1, 4)))
        path = "/" + "/".join(rng.choice(["p", "pq", "", "pqr"]) for _ in range(rng.randrange(4)))
        fits = [(h.count("."), len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert trie.match(host, path) == (best and (best[2], best[3]))


# ---- 9: nearest neighbours -------------------------------------------------

def test_nearest_recall_scores_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:1100] = x[100]  # a third of the rows is one vector
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0, None] + [0.0] * 14), (3004, [1.0]), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = permutation_index.search(table, table.where("vec_id % 100 = 0"), 20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 100))
    x, hits = x.astype(float), 0
    for q, found in by.items():
        found.sort()
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in found)
        assert [(-c, v) for _, v, c in found] == sorted((-c, v) for _, v, c in found)
    assert hits >= 0.9 * 20 * len(by)
    assert [v for _, v, _ in by[100]] == list(range(101, 121))


def test_repeated_queries_ask_once(spark):
    rng = np.random.default_rng(4)
    x = {i: rng.normal(size=8).tolist() for i in range(60)}
    rows = [(i, v) for i, v in x.items()] + [(20, x[20])] * 2 + [(40, x[7]), (13, x[13])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation_index.search(table, table.where("vec_id % 20 = 0"), 5).collect()
    for q in (0, 20, 40):
        asks = min([x[q]] + ([x[7]] if q == 40 else []))
        best = sorted(((-float(np.dot(v, asks)), i) for i, v in rows if i != q))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(r, i) for r, i, _ in mine] == [(n + 1, i) for n, (_, i) in enumerate(best)]
    assert len(got) == 15


def test_recall_on_the_given_embeddings(spark):
    """Against all pairs, at least 0.9 (README: about 0.95 and more)."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.QUERIES["op9_nearest"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hit += len(got[q] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(got)


def test_nearest_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = permutation_index.search(few, few.where("vec_id % 20 = 0"), 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 21), (0, 2, 20), (20, 1, 21), (20, 2, 0)]
    assert permutation_index.search(few.limit(0), few.limit(0), 20).count() == 0


# ---- 10: language ----------------------------------------------------------

def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    table = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op10_language_id"](spark, sf).collect()
    assert len(got) == len(table)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == table[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_language_edges_and_exact_phrases(spark, monkeypatch):
    samples = {"aa": "abab abba", "bb": "cdcd dccd"}
    got = language_id.identify(docs(spark, [None, "", "12 -", "abab", "cd" * 4000, "ABBA"]), samples).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "aa", "bb", "aa"] and got[0].score == 0
    assert language_id.learn(docs(spark, ["x"]).withColumn("lang", F.lit(None).cast("string"))) == {}
    assert [r.lang_pred for r in language_id.identify(docs(spark, ["hello"]), {}).collect()] == ["und"]
    # the greedy parse against a search for substrings
    rng = random.Random(2)
    sample = "".join(rng.choice("abc ") for _ in range(300))
    parser = language_id.Parser({"x": sample})
    clean = lambda t: re.sub(" +", " ", t).lstrip(" ")
    assert parser.sizes == [len(clean(sample + " "))] or parser.sizes == [len(clean(sample))]
    reference = clean(sample)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 400))) for _ in range(80)]
    texts += [sample * 9, sample[7:250] * 5, "ab" * 3000, sample + "d" + sample]
    _, n = parser.phrases(texts)
    for chunk in (2, 3, 7, 64):  # chunks that are shorter than phrases, too
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        assert (parser.phrases(texts)[1] == n).all()
    for text, phrases in zip(texts, n[:, 0].tolist()):
        whole, made, at = clean(text + " "), 0, 0
        while at < len(whole):
            size = 1
            while at + size < len(whole) and whole[at:at + size + 1] in reference:
                size += 1
            made, at = made + 1, at + (size if whole[at] in reference else 1)
        assert phrases == made


SCRIPTS = {"a": "абвгдежзийклмн", "b": "опрстуфхцчшщыэ", "c": "αβγδεζηθικλμνξοπρστυφχψω", "d": "אבגדהוזחטיכלמנ", "e": "ابتثجحخدذرزسشص",
           "f": "abcdefghijklmnopqrstuvwxyz", "g": "".join(map(chr, range(0x4E00, 0x5600))), "h": "".join(map(chr, range(0x6000, 0x6800))),
           "i": "".join(map(chr, range(0x3041, 0x3090))), "j": "".join(map(chr, range(0xAC00, 0xB400)))}


def test_languages_of_many_scripts_are_told_apart(spark):
    rng = random.Random(14)

    def text(lang):
        return " ".join("".join(rng.choice(SCRIPTS[lang]) for _ in range(rng.randrange(1, 9))) for _ in range(200))

    samples = {x: " ".join(text(x) for _ in range(9))[:9000] for x in SCRIPTS}
    asked = [x for x in SCRIPTS for _ in range(4)]
    texts = [t.upper() if n % 2 else t for n, t in enumerate(map(text, asked))]
    got = language_id.identify(docs(spark, texts), samples, keep=True).withColumn("gone", language_id.rejected()).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == asked and not any(r.gone for r in got)


def test_long_texts_of_a_language_with_two_labels_are_kept(spark):
    import corpus_pipeline

    rng = random.Random(16)
    text = " ".join(words(rng, 300)).translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, text, "xx" if i % 2 else "yy", "x", "y", "z") for i in range(24)]
    table = spark.createDataFrame([*rows, (90, None, "xx", "", "", ""), (91, "12 -", "xx", "", "", "")], DOCS)
    kept = corpus_pipeline.identify_language(spark, table, SF)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == list(range(24))


def test_more_languages_than_the_bound_are_an_error(spark, monkeypatch):
    table = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    assert len(language_id.learn(table)) == 4
    monkeypatch.setattr(language_id, "MAX_LANGS", 3)
    with pytest.raises(ValueError):
        language_id.learn(table)


@pytest.mark.parametrize("buckets", [1 << 14, 1 << 20])
def test_frequency_levels_count_all_documents(spark, monkeypatch, buckets):
    """Few buckets send all of their counts, many only those that are not zero."""
    monkeypatch.setattr(jaccard_join, "BUCKETS", buckets)
    monkeypatch.setattr(jaccard_join, "HELD", 1000)
    texts = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "text").repartition(3)
    want = np.zeros(buckets, np.int64)
    for g in jaccard_join.gram_sets(texts.toArrow().column("text").combine_chunks(), 3):
        np.add.at(want, (g % np.uint64(buckets)).astype(np.int64), 1)
    got = jaccard_join.frequency_levels(texts, 3)
    assert (got == np.minimum(8 * np.log2(want + 1), 255).astype(np.uint8)).all() and got.any()
