from pyspark.sql import functions as F

from colloquy.operators.speakers import label_speakers
from colloquy.operators.transcript import (format_transcript, from_editable,
                                           session_summary, to_editable)
from colloquy.functions.text import parse_clock
from tests.conftest import rows

SSCHEMA = "session_id long, seg_idx long, speaker string, text string, start_s double, end_s double"
SEGS = [(1, 0, "SPEAKER_00", "I've been anxious.", 0.0, 1.2),
        (1, 1, "SPEAKER_01", "Tell me more.", 1.5, 2.6)]


def segs(spark, data=SEGS):
    return spark.createDataFrame(data, SSCHEMA).repartition(3)


def test_format_plain_and_timed(spark):
    assert rows(format_transcript(segs(spark)), "transcript") == [
        ("SPEAKER_00: I've been anxious.\n\nSPEAKER_01: Tell me more.",)]
    assert rows(format_transcript(segs(spark), timestamps=True), "transcript") == [
        ("[00:00 → 00:01] SPEAKER_00: I've been anxious.\n\n[00:01 → 00:02] SPEAKER_01: Tell me more.",)]


def test_format_empty_session(spark):
    sessions = spark.createDataFrame([(1,), (2,)], "session_id long")
    got = dict(rows(format_transcript(segs(spark), sessions=sessions)))
    assert got[2] == ""


def test_labels_first_appearance(spark):
    data = [(1, 0, "B", "x", 0.0, 1.0), (1, 1, "A", "y", 1.0, 2.0), (1, 2, "B", "z", 2.0, 3.0),
            (1, 3, "C", "w", 3.0, 4.0)]
    got = rows(label_speakers(segs(spark, data), "First, Second").orderBy("seg_idx"), "speaker")
    assert [g[0] for g in got] == ["First", "Second", "First", "C"]


def test_labels_per_session_names(spark):
    data = [(1, 0, "B", "x", 0.0, 1.0), (2, 0, "B", "y", 0.0, 1.0)]
    st = spark.createDataFrame([(1, "Ann,"), (2, None)], "session_id long, speaker_names string")
    got = sorted(rows(label_speakers(segs(spark, data), settings=st), "session_id", "speaker"))
    assert got == [(1, "Ann"), (2, "B")]


def test_editable_roundtrip(spark):
    ed = to_editable(segs(spark))
    assert rows(ed, "editable") == [(
        "[00:00 → 00:01] SPEAKER_00:\nI've been anxious.\n\n[00:01 → 00:02] SPEAKER_01:\nTell me more.\n",)]
    back = rows(from_editable(ed).orderBy("seg_idx"), "speaker", "text", "start_s", "end_s")
    assert back == [("SPEAKER_00", "I've been anxious.", 0.0, 1.0), ("SPEAKER_01", "Tell me more.", 1.0, 2.0)]


def test_editable_import_edge_cases(spark):
    texts = {
        7: ("junk before\n[00:00 → 00:05] Therapist :\nline one\n\n\nline two\n"
            "[bad → header] x:\n[01:00→01:30]Client:\n[02:00 → 02:10] Client:\r\nbody\r\n"),
        8: "",
        9: "[100:00 → 100:59]  :\n\n[1:2 → 3:4] A:",
    }
    docs = spark.createDataFrame(list(texts.items()), "session_id long, editable string")
    got = rows(from_editable(docs).orderBy("session_id", "seg_idx"),
               "session_id", "seg_idx", "speaker", "text", "start_s", "end_s")
    assert got == [
        (7, 0, "Therapist", "line one\n\n\nline two\n[bad → header] x:", 0.0, 5.0),
        # a header may have no blanks around its arrow, but nothing after its colon
        (7, 1, "Client", "[02:00 → 02:10] Client:\r\nbody", 60.0, 90.0),
        (9, 0, "", "", 6000.0, 6059.0), (9, 1, "A", "", 62.0, 184.0)]


def test_clocks_of_other_scripts_and_sizes(spark):
    df = spark.createDataFrame([("٣:٠٠",), ("2:05",), ("1:2:3",), ("a:b",), ("123",), ("",), ("9" * 25 + ":00",)], "t string")
    got = [r[0] for r in df.select(parse_clock("t")).collect()]
    assert got[:6] == [180.0, 125.0, None, None, None, None] and abs(got[6] / 6e26 - 1) < 1e-12


def test_null_text_keeps_its_line(spark):
    data = [(1, 0, "A", "x", 0.0, 1.0), (1, 1, "B", None, 1.0, 2.0), (1, 2, "A", "z", 2.0, 3.0)]
    got = rows(format_transcript(segs(spark, data)), "transcript")[0][0]
    assert len(got.split("\n\n")) == 3


def test_session_summary(spark):
    data = [(1, 0, "Zara", "a", 10.0, 20.0), (1, 1, "Alice", "b", 100.0, 135.9), (1, 2, "Zara", "c", 5.0, 6.0)]
    sessions = spark.createDataFrame([(1,), (2,)], "session_id long")
    got = sorted(rows(session_summary(segs(spark, data), sessions)))
    assert got == [(1, "2:10", "Alice, Zara", 3, 2), (2, "0:00", "", 0, 0)]
