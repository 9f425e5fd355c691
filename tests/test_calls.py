"""Calls that are resumed, paced and tried again; settings that reach the notes."""

import os
import uuid

import pandas as pd
import pytest

from colloquy.operators.calls import answer_requests, patient
from colloquy.operators.notes import call_endpoint, gate_requests
from colloquy.operators.settings import resolve_settings
from colloquy.plans import calls
from tests.conftest import rows

SCHEMA = "session_id string, template_id string, gate string, url string, request string"


def requests(spark, n, **other):
    data = [(f"s{i}", "soap", "ok", "u", f'{{"n":{i}}}') for i in range(n)]
    data += [("refused", "soap", "refused", "u", "{}"), ("none", "soap", "ok", "u", None), data[0]]
    return spark.createDataFrame(data, SCHEMA)


def logging_client(folder, fail=()):
    """A client that leaves a file for every request it sees."""

    def make():
        def client(pdf):
            for s in pdf["session_id"]:
                with open(os.path.join(folder, f"{s}-{uuid.uuid4().hex}"), "w"):
                    pass
            bad = pdf["session_id"].isin(list(fail)) & ~pdf["session_id"].map(lambda s: os.path.exists(os.path.join(folder, "mended")))
            return pd.DataFrame({"status": [503 if b else 200 for b in bad], "body": ("answer to " + pdf["session_id"]).tolist()})

        return client

    return make


def sent(folder):
    return sorted(f.split("-")[0] for f in os.listdir(folder) if "-" in f)


def test_a_run_stopped_halfway_sends_no_request_twice(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "answers")
    log.mkdir()
    asked = requests(spark, 40)

    class Stop(Exception):
        pass

    def stop(i):
        if i == 1:
            raise Stop

    with pytest.raises(Stop):
        answer_requests(asked, logging_client(log), out, per_batch=10, tasks=2, after_batch=stop)
    half = len(sent(log))
    assert 0 < half < 40
    got = answer_requests(asked, logging_client(log), out, per_batch=10, tasks=2)
    want = sorted(f"s{i}" for i in range(40))
    assert sorted(rows(got)) == [(s, "soap", 200, f"answer to {s}") for s in want]
    assert sent(log) == want  # each once, the repeated row too
    answer_requests(asked, logging_client(log), out, per_batch=10).count()
    assert len(sent(log)) == 40
    # a changed request is a new one
    changed = spark.createDataFrame([("s1", "soap", "ok", "u", '{"n":"new"}')], SCHEMA)
    assert answer_requests(changed, logging_client(log), out).count() == 1 and len(sent(log)) == 41


def test_failed_requests_are_sent_again_when_told(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "answers")
    log.mkdir()
    asked = requests(spark, 6)
    first = answer_requests(asked, logging_client(log, fail=["s2", "s4"]), out)
    assert sorted(r.session_id for r in first.collect() if r.status == 503) == ["s2", "s4"]
    (log / "mended").touch()
    again = answer_requests(asked, logging_client(log, fail=["s2", "s4"]), out, again=True)
    assert {r.status for r in again.collect()} == {200} and again.count() == 6
    assert len(sent(log)) == 8


def test_tries_and_waits(spark):
    slept, now, seen = [], [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    def make():
        def client(pdf):
            seen.append(pdf["url"].iloc[0])
            if pdf["url"].iloc[0] == "down":
                raise OSError("away")
            return pd.DataFrame({"status": [429 if seen.count("busy") < 3 and pdf["url"].iloc[0] == "busy" else 200 if pdf["url"].iloc[0] != "odd" else 404],
                                 "body": ["b"]})
        return client

    send = patient(make, tries=3, first_wait=1.0, sleep=sleep, clock=lambda: now[0])()
    out = send(pd.DataFrame({"url": ["fine", "busy", "odd", "down"]}))
    assert out["status"].tolist() == [200, 200, 404, 599] and "away" in out["body"].iloc[3]
    assert slept == [1, 2, 1, 2] and seen.count("odd") == 1
    slept.clear()
    paced = patient(make, per_second=4, sleep=sleep, clock=lambda: now[0])()
    paced(pd.DataFrame({"url": ["fine"] * 5}))
    assert slept == [0.25] * 4


def test_keys_of_any_type(spark, tmp_path):
    assert call_endpoint(requests(spark, 2), logging_client(str(tmp_path))).columns == ["session_id", "template_id", "status", "body"]


def test_a_configured_allow_remote_changes_the_gate(spark):
    explicit = spark.createDataFrame([(1, "https://far.example.com/v1"), (2, "https://far.example.com/v1"), (3, None)], "session_id long, base_url string")
    config = spark.createDataFrame([
        (1, '{"summarize": {"allow_remote": true, "model": "m1"}, "transcribe": {"min_speakers": 2, "max_speakers": 5}}'),
        (2, '{"transcribe": {"min_speakers": "two", "max_speakers": 5.5}}'),
        (3, '{"summarize": {"base_url": "https://far.example.com/v1"}}')], "session_id long, config string")
    st = resolve_settings(explicit, config)
    prompts = spark.createDataFrame([(i, "soap", "text") for i in (1, 2, 3)], "session_id long, template_id string, prompt string")
    got = {r.session_id: r for r in gate_requests(prompts, st).collect()}
    assert [got[i].gate for i in (1, 2, 3)] == ["remote_allowed", "refused", "refused"] and '"m1"' in got[1].request
    r = {x.session_id: x for x in st.collect()}
    assert (r[1].min_speakers, r[1].max_speakers, r[2].min_speakers, r[2].max_speakers) == (2, 5, None, None)
    assert r[2].ignored == "transcribe.max_speakers,transcribe.min_speakers"


def test_requests_are_computed_once_whatever_the_number_of_batches(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "answers")
    log.mkdir()
    built = spark.sparkContext.accumulator(0)

    def build(batches):
        for pdf in batches:
            built.add(len(pdf))
            yield pdf

    asked = requests(spark, 40)
    got = answer_requests(asked.mapInPandas(build, SCHEMA), logging_client(log), out, per_batch=4, tasks=2)
    assert got.count() == 40 and len(sent(log)) == 40
    assert built.value == asked.count()


def test_recorded_answers_lie_in_small_buckets(spark, tmp_path):
    path = str(tmp_path / "recorded")
    data = [(i * 1024, 200, f"body {i}") for i in range(9000)]
    buckets = calls.record(spark.createDataFrame(data, "session_id long, status int, body string"), path)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("bucket").count().collect()]
    assert len(sizes) == buckets == 18 and max(sizes) < 2 * calls.PER_BUCKET
    client = calls.replay(path, buckets)()
    out = client(pd.DataFrame({"session_id": [0, 1024, 8999 * 1024, 5]}))
    assert out["body"].tolist() == ["body 0", "body 1", "body 8999"] and out["status"].tolist() == [200] * 3
