"""Numbered lines, raw model output, arriving files and session files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from colloquy.functions.jsondoc import single_json
from colloquy.operators.settings import json_kind
from colloquy.sources import asr
from colloquy.sources.jsonl import parse_lines, read_jsonl, split_lines
from colloquy.sources.lines import numbered_lines, read_lines
from tests.conftest import rows


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "700")
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_lines_of_split_files_are_numbered_as_in_the_whole(spark, small_splits, tmp_path):
    texts = {"long": "".join(f"line {i} é\r of {'x' * (i * 37 % 90)}\n" for i in range(400)), "one": "a", "blank": "\n\n a\n\n\n",
             "wide": "y" * 5000 + "\nz", "crlf": "a\r\nb\r\n"}
    for name, t in texts.items():
        put(tmp_path, f"{name}.txt", t)
    raw = read_lines(spark, str(tmp_path))
    assert raw.select("file", "block").distinct().count() > 30
    got = {(r.file.rsplit("/", 1)[1][:-4], r.line_no): r.line for r in numbered_lines(raw).collect()}
    want = {}
    for name, t in texts.items():
        lines = t.split("\n")
        want.update({(name, i): x for i, x in enumerate(lines[:-1] if lines[-1] == "" else lines)})
    assert got == want


def test_jsonl_files_equal_the_whole_text_reading(spark, small_splits, tmp_path):
    good = '{"speaker":"A","text":"t %d","start":%d,"end":%d.5}'
    lines = [good % (i, i, i) if i % 7 else ["", "  ", "{", good % (i, i, i) + " junk"][i % 4] for i in range(300)]
    put(tmp_path, "s1.jsonl", "\n".join(lines) + "\n")
    put(tmp_path, "s2.jsonl", "\n".join(lines[::-1]))
    put(tmp_path, "note.txt", "no session")
    files = parse_lines(read_jsonl(spark, str(tmp_path), glob="*.jsonl"))
    docs = spark.createDataFrame([("s1", "\n".join(lines) + "\n"), ("s2", "\n".join(lines[::-1]))], "session_id string, jsonl string")
    assert sorted(map(str, rows(files))) == sorted(map(str, rows(parse_lines(split_lines(docs))))) and files.count() > 500


DOCS = {
    '{"session_id":1,"part":0,"segments":[{"words":[{"word":" a","start":0,"end":1.5,"p":0.9},{"word":" b","start":2,"end":3}]},{"words":null},{"text":"x"},{"words":[]}]}': None,
    '{"session_id":1,"part":2,"segments":[{"words":[{"word":" c","start":4,"end":5}]}]}': None,
    '{"part":1,"session_id":1,"tracks":[{"speaker":"S1","start":2,"end":3,"score":{"b":1,"a":[2]}},{"speaker":"S0","start":0,"end":1}],"model":"m"}': None,
    '{"session_id":1,"part":0,"tracks":[{"speaker":"S9","start":9,"end":9.5,"note":"n"}]}': None,
    '{"session_id":2,"part":0,"tracks":[]}': None,
    '{"session_id":2,"part":0,"segments":[{"words":[{"word":" a","start":"0","end":1}]}]}': "bad_segments",
    '{"session_id":2,"part":0,"segments":[{"words":{"word":" a"}}]}': "bad_segments",
    '{"session_id":2,"part":0,"segments":{"words":[]}}': "bad_segments",
    '{"session_id":2,"part":0,"tracks":[{"speaker":null,"start":0,"end":1}]}': "bad_tracks",
    '{"session_id":2,"part":0,"tracks":[{"speaker":"A","start":0}]}': "bad_tracks",
    '{"session_id":"2","part":0,"tracks":[]}': "bad_session",
    '{"part":0,"tracks":[]}': "bad_session",
    '{"session_id":2,"part":0}': "unknown_kind",
    '[1]': "bad_json", '{"session_id":2': "bad_json", '{"session_id":2,"part":0,"tracks":[]} x': "bad_json",
}


def test_raw_model_output(spark):
    docs = spark.createDataFrame([(i, d) for i, d in enumerate([*DOCS, None])], "line_no long, doc string")
    parsed = asr.parse_documents(docs)
    assert rows(parsed.orderBy("line_no"), "reason") == [(r,) for r in [*DOCS.values(), "bad_json"]]
    assert rows(asr.words_from_documents(parsed).orderBy("word_idx")) == [(1, 0, " a", 0.0, 1.5), (1, 1, " b", 2.0, 3.0), (1, 2, " c", 4.0, 5.0)]
    turns = rows(asr.turns_from_documents(parsed).orderBy("turn_idx"))
    assert [t[:5] for t in turns] == [(1, 0, "S9", 9.0, 9.5), (1, 1, "S1", 2.0, 3.0), (1, 2, "S0", 0.0, 1.0)]
    assert [None if t[5] is None else json.loads(t[5]) for t in turns] == [{"note": "n"}, {"score": {"a": [2], "b": 1}}, None]
    bad = asr.rejected_documents(parsed)
    assert bad.columns == ["line_no", "doc", "reason"] and bad.count() == 12


def arriving(folder, name, sessions, bad=()):
    lines = []
    for s in sessions:
        lines.append(json.dumps({"session_id": s, "part": 0, "tracks": [{"speaker": "S1", "start": 0, "end": 2}, {"speaker": "S2", "start": 2, "end": 4}]}))
        lines.append(json.dumps({"session_id": s, "part": 0, "segments": [{"words": [{"word": " hi", "start": 0, "end": 1}, {"word": " call", "start": 2, "end": 3},
                                                                                    {"word": " 555-123-4567", "start": 3, "end": 4}]}]}))
    put(folder, name, "\n".join([*lines, *bad]) + "\n")


SAID = "[00:00 → 00:01] Ann: hi\n\n[00:02 → 00:04] Ben: call [PHONE]"


def test_a_batch_that_failed_between_its_tables_is_written_once(spark, tmp_path, monkeypatch):
    from colloquy.streaming import arrivals

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    arriving(src, "a.txt", [1, 2], bad=["", "{", "mail me@x.org"])
    arriving(src, "b.txt", [3], bad=['{"session_id":1,"part":2}'])
    write, calls = arrivals.write_batch, []

    def failing(rows, path, batch_id):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("the second table's store is away")
        write(rows, path, batch_id)

    monkeypatch.setattr(arrivals, "write_batch", failing)
    args = (spark, src, out, ck, "Ann,Ben")
    with pytest.raises(Exception, match="store is away"):
        arrivals.transcripts_of_files(*args)
    good, bad = arrivals.transcripts_of_files(*args)
    arriving(src, "c.txt", [4])
    good, bad = arrivals.transcripts_of_files(*args)  # the new file alone
    assert sorted(rows(good)) == [(1, SAID, 0), (2, SAID, 0), (3, SAID, 0), (4, SAID, 1)]
    got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.reason, r.line) for r in bad.collect())
    assert got == [("a.txt", 5, "bad_json", "{"), ("a.txt", 6, "bad_json", "mail [EMAIL]"),
                   ("b.txt", 2, "unknown_kind", '{"session_id":1,"part":2}')]
    assert spark._jsc.sc().getPersistentRDDs().isEmpty()


def test_arriving_segments_keep_their_order_and_say_what_is_wrong(spark, tmp_path):
    from colloquy.streaming import arrivals as ar

    line = '{"speaker":"A","text":"%s","start":0,"end":1}'
    put(tmp_path / "in", "x.txt", "\n".join([f"7\t{line % 'one'}", "no id", f"x\t{line % 'two'}", f"7\t{line % 'John'} junk", f"8\t{line % 'b'}", f"7\t{line % 'John'}"]))
    ar.process_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), ar.redact_batch(["John"]))
    good = ar.read_sink(spark, str(tmp_path / "out"), ar.ACCEPTED, ar.SEGMENTS)
    assert sorted(rows(good, "session_id", "seg_idx", "text")) == [(7, 0, "one"), (7, 1, "[NAME]"), (8, 0, "b")]
    bad = ar.read_sink(spark, str(tmp_path / "out"), ar.REJECTED, ar.REJECTS)
    assert sorted(rows(bad, "line_no", "reason")) == [(1, "no session id"), (2, "no session id"), (3, "bad_json")]


def files_under(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))


def test_session_files_and_their_manifest(spark, tmp_path):
    from colloquy.sources.files import manifest, read_session_files, write_session_files

    out = str(tmp_path / "out")
    data = [(i, f"s{i}.txt", "" if i == 3 else f"text é {i}\n\n" * i) for i in range(40)]
    write_session_files(spark.createDataFrame(data, "session_id long, file_name string, content string"), out)
    assert sorted(rows(read_session_files(spark, out), "session_id", "file_name", "content")) == data
    listed = manifest(spark, out).collect()
    assert sorted(r.path for r in listed) == [f for f in files_under(out) if not f.startswith("_")]
    assert all(os.path.getsize(os.path.join(out, r.path)) == r.n_bytes for r in listed)
    # more files beside these, then others in their place
    more = spark.createDataFrame([(90, "s90.txt", "x")], "session_id long, file_name string, content string")
    write_session_files(more, out)
    assert read_session_files(spark, out).count() == 41
    write_session_files(more, out, "overwrite")
    assert rows(read_session_files(spark, out), "session_id", "content") == [(90, "x")]
    assert len(files_under(out)) == 2


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    from colloquy.sources.files import write_session_files

    out = str(tmp_path / "out")
    data = [(i, "bad/name" if i == 17 else f"s{i}.txt", "x") for i in range(40)]
    with pytest.raises(Exception, match="not a file name of its own"):
        write_session_files(spark.createDataFrame(data, "session_id long, file_name string, content string"), out)
    assert files_under(out) == []
    twice = spark.createDataFrame([(1, "a.txt", "x"), (1, "a.txt", "y")], "session_id long, file_name string, content string")
    with pytest.raises(Exception, match="not a file name of its own"):
        write_session_files(twice, out)
    assert files_under(out) == []


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_parsed_once_for_a_table(spark):
    parsed = asr.parse_documents(spark.createDataFrame([(d,) for d in DOCS], "doc string"))
    for table in (asr.words_from_documents(parsed), asr.turns_from_documents(parsed)):
        assert table.count() == 3 and "parseJson" not in plan(table) and "parseJson" in plan(parsed)


def test_a_value_is_looked_at_once_for_its_kind(spark):
    docs = ['{"a":"x"}', '{"a":1}', '{"a":true}', '{"a":1.5}', '{"a":1e300}', '{"a":[1,"x"]}', '{"a":{"b":[]}}', '{"a":null}', '{"b":1}', "[1]", "{", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i long, doc string").select("i", F.try_parse_json("doc").alias("v"))
    kinds = df.select("i", json_kind(F.col("v"), "a").alias("kind"))
    assert plan(kinds).count("variant_get") == 1
    assert [r.kind for r in kinds.orderBy("i").collect()] == ["str", "int", "bool", "float", "float", "list", "dict", "null", None, None, None, None]


def test_a_text_that_is_one_json_value(spark):
    texts = {'{"a":1}': True, "[1,2]": True, "1": True, "null": True, '"x"': True, " 1 ": True, "1,2": False, "1],[2": False, "1]": False, "": False,
             '{"a":1} x': False, "{": False, "1,": False, None: False}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", single_json("t").isNotNull().alias("one"))
    assert dict(rows(df)) == texts and plan(df).count("parseJson") == 1


def test_a_batch_is_parsed_once_and_leaves_no_working_table(spark, tmp_path):
    from colloquy.session import ensure_checkpoint_dir
    from colloquy.streaming import arrivals

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    arriving(src, "a.txt", [1, 2], bad=["{"])
    arriving(src, "b.txt", [3])
    plans, batch = [], arrivals.transcribe_batch("Ann, Ben", ["John"])

    def told(lines):
        assert "parseJson" in plan(asr.parse_documents(lines, "line"))
        tables = batch(lines)
        plans.extend(plan(t) for t in tables)
        return tables

    def working():
        return {x for x in os.listdir(ensure_checkpoint_dir(spark)) if x.split("-")[0] in ("parsed", "tracks", "turns", "words", "pieces")}

    before = working()
    arrivals.process_files(spark, src, out, ck, told)
    assert len(plans) == 2 and not any("parseJson" in p for p in plans)
    assert working() == before
    assert [r.transcript for r in arrivals.read_sink(spark, out, arrivals.ACCEPTED, arrivals.TRANSCRIPTS).collect()] == [SAID] * 3
    assert [r.line for r in arrivals.read_sink(spark, out, arrivals.REJECTED, arrivals.REJECTS).collect()] == ["{"]
