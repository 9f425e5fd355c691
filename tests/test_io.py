from pyspark.sql import functions as F

from colloquy.operators.settings import resolve_settings
from colloquy.sources.asr import flatten_words
from colloquy.sources.jsonl import from_jsonl, to_jsonl
from tests.conftest import rows

SSCHEMA = "session_id long, seg_idx long, speaker string, text string, start_s double, end_s double"


def test_jsonl_roundtrip_identity(spark):
    data = [(1, 0, "A", 'quote " and \\ and\nnewline é', 0.1, 1.5), (1, 1, "B", "", 2.0, 2.0)]
    segs = spark.createDataFrame(data, SSCHEMA)
    good, bad = from_jsonl(to_jsonl(segs))
    assert sorted(rows(good)) == sorted(data) and bad.count() == 0


def test_jsonl_quarantine(spark):
    text = ('\n{"speaker":"A","text":"x","start":0,"end":1}\n   \n{"speaker":"A","text":"x","start":0}\n'
            '{"speaker":"A","text":"x","start":0,"end":1,"extra":2}\n{"speaker":\n'
            '{"speaker":"B","text":"y","start":1.5,"end":2}\n')
    docs = spark.createDataFrame([(1, text)], "session_id long, jsonl string")
    good, bad = from_jsonl(docs)
    assert rows(good.orderBy("seg_idx"), "seg_idx", "speaker", "start_s") == [(0, "A", 0.0), (1, "B", 1.5)]
    assert sorted(r[0] for r in rows(bad, "reason")) == ["bad_json", "wrong_keys", "wrong_keys"]


def test_only_whole_objects_of_the_right_kinds(spark):
    good = '{"speaker":"A","text":"x","start":0,"end":1.5}'
    bad = {good + " junk": "bad_json", good + good: "bad_json", good + "," + good: "bad_json", good + "] junk": "bad_json",
           "[" + good + "]": "bad_json", '{"speaker":"A","text":{"a":1},"start":0,"end":1}': "bad_value",
           '{"speaker":5,"text":"x","start":0,"end":1}': "bad_value",
           '{"speaker":"A","text":"x","start":"0","end":1}': "bad_value",
           '{"speaker":"A","text":null,"start":0,"end":1}': "bad_value"}
    docs = spark.createDataFrame([(1, "\n".join([good, *bad, "  " + good + " "]))], "session_id long, jsonl string")
    ok, rejected = from_jsonl(docs)
    assert ok.count() == 2 and ok.count() + rejected.count() == len(bad) + 2
    assert [r for r in rows(rejected.orderBy("line_no"), "line", "reason")] == list(bad.items())


def test_flatten_asr_skips_null_word_lists(spark):
    asr = spark.createDataFrame(
        [(1, 0, [(" a", 0.0, 1.0), (" b", 1.0, 2.0)]), (1, 1, None), (1, 2, [(" c", 3.0, 4.0)]), (1, 3, [])],
        "session_id long, seg_pos long, words array<struct<word:string,start:double,end:double>>")
    got = rows(flatten_words(asr).orderBy("word_idx"), "word_idx", "text")
    assert got == [(0, " a"), (1, " b"), (2, " c")]


def test_settings_precedence(spark):
    explicit = spark.createDataFrame([(1, None, None), (2, "Ann", True), (3, "", None)],
                                     "session_id long, client_name string, allow_remote boolean")
    cfg = spark.createDataFrame([
        (1, '{"summarize": {"client_name": "Cfg", "allow_remote": "yes"}, "transcribe": {"num_speakers": 2}}'),
        (2, '{"summarize": {"client_name": "Cfg"}}'),
        (3, '{"summarize": {"client_name": 5, "allow_remote": 0}, "transcribe": {"num_speakers": true}}')],
        "session_id long, config string")
    got = {r["session_id"]: r for r in resolve_settings(explicit, cfg).collect()}
    assert (got[1]["client_name"], got[1]["allow_remote"], got[1]["num_speakers"]) == ("Cfg", True, 2)
    assert (got[2]["client_name"], got[2]["allow_remote"]) == ("Ann", True)
    assert (got[3]["client_name"], got[3]["allow_remote"], got[3]["num_speakers"]) == ("", False, None)
    assert got[3]["ignored"] == "transcribe.num_speakers"  # client_name given explicitly
