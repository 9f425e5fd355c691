import pandas as pd
from pyspark.sql import functions as F

from colloquy.functions import endpoint as ep
from colloquy.functions.template import substitute
from colloquy.operators.notes import call_endpoint, gate_requests, parse_responses, render_prompts, session_values
from colloquy.sources.templates import load_templates
from tests.conftest import rows


def sub(spark, body, **vals):
    df = spark.createDataFrame([(body,)], "b string")
    return df.select(substitute("b", {k: F.lit(v) for k, v in vals.items()})).first()[0]


def test_substitution_rules(spark):
    assert sub(spark, "Hi $name and ${name}!", name="Ann") == "Hi Ann and Ann!"
    assert sub(spark, "cost $$5, $unknown, ${bad", name="x") == "cost $5, $unknown, ${bad"
    assert sub(spark, '{"a": 1} $ end $', name="x") == '{"a": 1} $ end $'
    assert sub(spark, "$name", name="$date and $$") == "$date and $$"  # values not re-scanned
    assert sub(spark, "$names $name_", name="x") == "$names $name_"


def test_render_and_values(spark):
    segs = spark.createDataFrame(
        [(1, 0, "B", "costs $date", 0.0, 60.0), (1, 1, "A", "ok", 60.0, 75.5)],
        "session_id long, seg_idx long, speaker string, text string, start_s double, end_s double")
    tmpl = spark.createDataFrame([("t", "[$speakers|$client_name|$date|$duration]\n$transcript")],
                                 "template_id string, body string")
    req = spark.createDataFrame([(1, "t", "", None)],
                                "session_id long, template_id string, client_name string, session_date string")
    got = render_prompts(session_values(segs), tmpl, req, default_date="2024-01-02").first()["prompt"]
    assert got == ("[A, B|Client|2024-01-02|1:15]\n[00:00 → 01:00] B: costs $date\n\n"
                   "[01:00 → 01:15] A: ok")


def test_builtin_templates(spark):
    t = load_templates(spark)
    ids = sorted(r[0] for r in t.select("template_id").collect())
    assert ids == ["birp", "cbt-soap", "dap", "informed-consent", "intake", "neuropsychoanalytic",
                   "progress", "psychodynamic", "soap"]
    for r in t.collect():
        for ph in ("$speakers", "$client_name", "$date", "$duration", "$transcript"):
            assert ph in r["body"]


def test_is_local(spark):
    cases = {"http://localhost:11434/v1": True, "http://127.0.0.1:8080": True, "http://0.0.0.0": True,
             "http://[::1]:8080/v1": True, "http://LOCALHOST/": True, "https://api.openai.com/v1": False,
             "not a url": False, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = dict(rows(df.select("u", ep.is_local("u").alias("l"))))
    assert got == cases


def test_gate_and_request(spark):
    p = spark.createDataFrame([(1, "t", "x" * 24004), (2, "t", "hi")], "session_id long, template_id string, prompt string")
    tg = spark.createDataFrame([(1, "http://localhost:11434/v1//", None, None), (2, "https://x.org/v1", "m", False)],
                               "session_id long, base_url string, model string, allow_remote boolean")
    got = {r["session_id"]: r for r in gate_requests(p, tg).collect()}
    assert got[1]["gate"] == "ok" and got[1]["too_long"] and got[1]["est_tokens"] == 6001
    assert got[1]["url"] == "http://localhost:11434/v1/chat/completions"
    assert got[2]["gate"] == "refused"
    import json
    body = json.loads(got[1]["request"])
    assert body == {"model": "llama3", "messages": [{"role": "user", "content": "x" * 24004}], "temperature": 0.3}


def test_responses(spark):
    data = [(1, 200, '{"choices":[{"message":{"content":"note"}}]}'), (2, 200, '{"choices":[]}'),
            (3, 200, '{"choices":[{"text":"x"}]}'), (4, 500, "boom"), (5, 200, '{"other": 1}')]
    df = spark.createDataFrame(data, "session_id long, status int, body string")
    got = {r[0]: (r[1], r[2]) for r in rows(parse_responses(df), "session_id", "content", "error")}
    assert got[1] == ("note", None)
    assert got[2][1].startswith("Unexpected LLM response format: ")
    assert got[3][0] is None and got[5][1] is not None
    assert got[4] == (None, "LLM request failed: 500 boom")


def test_call_endpoint_hook(spark):
    req = spark.createDataFrame([(1, "t", "ok", "u", "{}"), (2, "t", "refused", "u", "{}"), (3, "t", "ok", "u", "bad")],
                                "session_id long, template_id string, gate string, url string, request string")
    made = []

    def make_client():
        made.append(1)

        def call(pdf):
            if (pdf["request"] == "bad").any():
                raise ValueError("bad request")
            return pd.DataFrame({"status": [200] * len(pdf), "body": ['{"choices":[{"message":{"content":"n"}}]}'] * len(pdf)})
        return call

    out = sorted(rows(call_endpoint(req.repartition(1), make_client), "session_id", "status"))
    assert out == [(1, 200), (3, 599)]  # refused never reaches the hook, one failure stays alone


def test_client_that_cannot_be_made(spark):
    req = spark.createDataFrame([(1, "t", "ok", "u", "{}"), (2, "t", "ok", "u", "{}")],
                                "session_id long, template_id string, gate string, url string, request string")

    def make_client():
        raise OSError("no model")

    out = sorted(rows(call_endpoint(req, make_client), "session_id", "status", "body"))
    assert out == [(i, 599, "client error: OSError: no model") for i in (1, 2)]


def test_every_response_has_content_or_error(spark):
    good = '{"choices":[{"message":{"content":"note"}}]}'
    data = [(1, None, good), (2, 200, None), (3, 500, None), (4, 302, good), (5, 200, good + " junk"),
            (6, 200, '{"choices":[{"message":{"content":{"a":1}}}]}'), (7, 204, good), (8, 200, "x" * 500)]
    df = spark.createDataFrame(data, "session_id long, status int, body string")
    got = {r[0]: (r[1], r[2]) for r in rows(parse_responses(df), "session_id", "content", "error")}
    assert len(got) == len(data) and all((c is None) != (e is None) for c, e in got.values())
    assert [i for i, (c, _) in got.items() if c] == [7]
    assert got[8][1].endswith("x" * 500)  # the whole body


def test_no_request_vanishes(spark):
    segs = spark.createDataFrame([(1, 0, "A", "x", 0.0, 5.0)],
                                 "session_id long, seg_idx long, speaker string, text string, start_s double, end_s double")
    tmpl = spark.createDataFrame([("t", "$duration|$transcript")], "template_id string, body string")
    req = spark.createDataFrame([(1, "t"), (1, "absent"), (2, "t")], "session_id long, template_id string")
    prompts = render_prompts(session_values(segs), tmpl, req, default_date="2024-01-02")
    assert sorted(rows(prompts, "session_id", "template_id", "prompt", "error"), key=str) == [
        (1, "absent", None, "template not found"), (1, "t", "0:05|[00:00 → 00:05] A: x", None), (2, "t", "0:00|", None)]
    sent = rows(gate_requests(prompts), "template_id", "request", "error")
    assert [(r, e) for t, r, e in sent if t == "absent"] == [(None, "template not found")]
