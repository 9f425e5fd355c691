"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or tables Spark derives from them) in
full; nothing is sampled, capped or filtered to keep a check cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import endpoint as ep
from ..functions.redact import redact_names_dynamic, redact_patterns, redact_text
from ..functions.text import split_names
from ..operators.align import align, assign_speakers, rejected_times
from ..operators.notes import (NO_TEMPLATE, gate_requests, parse_responses, prompt_budget, render_prompts,
                               session_values)
from ..operators.speakers import label_speakers
from ..operators.transcript import (format_transcript, from_editable, session_summary,
                                    to_editable)
from ..session import read_table
from ..sources import fixtures as fx
from ..operators import batch as bt
from ..operators.settings import resolve_settings
from ..sources.asr import ASR_WORD, flatten_words
from ..sources.jsonl import from_jsonl, parse_lines, split_lines, to_jsonl, to_jsonl_lines
from ..operators.scan import ordered_concat
from ..sources.templates import load_templates

# ---------------------------------------------------------------------------
# Fixed values used by the queries.
SPEAKER_NAMES = "Therapist, Client"
REDACT_NAMES = fx.NAMES
RUN_DATE = "2024-06-30"  # the "today" default, fixed so results are reproducible
# ---------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]


def q_redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", redact_patterns("text").alias("text"))


def q_redact_names(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.segments(spark, sf)
    return segs.select("session_id", "seg_idx", redact_text("text", REDACT_NAMES).alias("text"))


def q_transcript_plain(spark: SparkSession, sf: str) -> DataFrame:
    return format_transcript(fx.segments(spark, sf), timestamps=False)


def q_transcript_timed(spark: SparkSession, sf: str) -> DataFrame:
    return format_transcript(fx.segments(spark, sf), timestamps=True)


def q_session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return session_summary(fx.segments(spark, sf))


def q_assign_speaker(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.all_fixtures(spark, sf)
    return assign_speakers(f["words"], f["turns"])


def q_align_runs(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.all_fixtures(spark, sf)
    return align(f["words"], f["turns"])


def q_label_speakers(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.segments(spark, sf)
    return label_speakers(segs, SPEAKER_NAMES).select("session_id", "seg_idx", "speaker")


def q_editable_export(spark: SparkSession, sf: str) -> DataFrame:
    return to_editable(fx.segments(spark, sf))


def edited_documents(spark: SparkSession, sf: str) -> DataFrame:
    """S10 output with hand edits spliced in: text before the first header,
    a renamed speaker, a malformed header, extra blank lines in a body and
    CR line ends."""
    docs = to_editable(fx.segments(spark, sf))
    e = F.col("editable")
    sid = F.col("session_id")
    e = F.when(sid % 3 == 0, F.concat(F.lit("draft notes\n\n"), e)).otherwise(e)
    e = F.when(sid % 4 == 1, F.replace(e, F.lit("] user:\n"), F.lit("] Client :\n"))).otherwise(e)
    e = F.when(sid % 5 == 2, F.concat(e, F.lit("\n[1:2:3 → 00:04] bad:\ntrailing\n\n\nmore\n"))).otherwise(e)
    e = F.when(sid % 6 == 5, F.replace(e, F.lit("\n"), F.lit("\r\n"))).otherwise(e)
    return docs.select("session_id", e.alias("editable"))


def q_editable_import(spark: SparkSession, sf: str) -> DataFrame:
    return from_editable(edited_documents(spark, sf))


def q_transcript_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """C1 (flagship): words x turns -> align -> label -> redact ->
    timestamped transcript, for all sessions at once."""
    f = fx.all_fixtures(spark, sf)
    segs = align(f["words"], f["turns"], names=SPEAKER_NAMES)
    segs = segs.withColumn("text", redact_text("text", REDACT_NAMES))
    return format_transcript(segs, timestamps=True)


def resolved_settings(spark: SparkSession, sf: str) -> DataFrame:
    """P6 for every session: explicit values over its configuration document."""
    conv = read_table(spark, sf, "conversations")
    return resolve_settings(fx.settings_from(conv), fx.config_from(conv))


def redact_as_set(segs: DataFrame, settings: DataFrame) -> DataFrame:
    """The texts of each session redacted, or not, as its settings say,
    with the names of its own."""
    j = segs.join(settings.select("session_id", "redact", "redact_names"), "session_id", "left")
    names = F.coalesce(split_names("redact_names"), F.array().cast("array<string>"))
    names = F.filter(names, lambda n: n != "")
    text = F.when(F.coalesce("redact", F.lit(False)), redact_names_dynamic(redact_patterns("text"), names))
    return j.withColumn("text", text.otherwise(F.col("text"))).select(*segs.columns)


def notes_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """C2 up to the prompt: redact (before anything is rendered) -> session
    values -> one template per session (J4/J5), all as the resolved settings say."""
    st = resolved_settings(spark, sf)
    vals = session_values(redact_as_set(fx.segments(spark, sf), st))
    req = st.select("session_id", "template_id", "client_name", "session_date")
    return render_prompts(vals, load_templates(spark), req, default_date=RUN_DATE)


def q_render_notes(spark: SparkSession, sf: str) -> DataFrame:
    return notes_prompts(spark, sf)


def q_prompt_budget(spark: SparkSession, sf: str) -> DataFrame:
    return prompt_budget(notes_prompts(spark, sf))


def q_chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    return gate_requests(notes_prompts(spark, sf), resolved_settings(spark, sf))


def gate_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoint candidates derived from ``pages.url``: the page URL itself,
    its path on a loopback host, an IPv6 loopback, an upper-case host, and a
    string that is not a URL."""
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)?$", 1)
    k = F.col("page_id") % 5
    base = (F.when(k == 0, F.col("url"))
            .when(k == 1, F.concat(F.lit("http://localhost:11434"), path))
            .when(k == 2, F.concat(F.lit("http://[::1]:8080"), path))
            .when(k == 3, F.concat(F.lit("HTTP://127.0.0.1"), path))
            .otherwise(F.concat(F.lit("no url "), F.col("url"))))
    return pages.select("page_id", base.alias("base_url"), (F.col("page_id") % 2 == 0).alias("allow_remote"))


def q_endpoint_gate(spark: SparkSession, sf: str) -> DataFrame:
    t = gate_targets(spark, sf)
    return t.select("page_id", "base_url", ep.is_local("base_url").alias("is_local"),
                    ep.gate("base_url", "allow_remote").alias("gate"),
                    ep.completions_url("base_url").alias("url"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Response bodies derived from conversation turns, by
    ``(conv_id + turn) % 10``: good, empty ``choices``, no ``message``, HTTP
    500, not JSON, HTTP 302, no status, no body, text after the document,
    content that is no string."""
    conv = read_table(spark, sf, "conversations")
    good = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"))).alias("choices")))
    no_msg = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("choices")))
    obj = F.to_json(F.struct(F.array(F.struct(F.struct(F.struct(F.col("text").alias("a")).alias("content"))
                                              .alias("message"))).alias("choices")))
    k = (F.col("conv_id") + F.col("turn")) % 10
    body = (F.when(k == 0, good).when(k == 1, F.lit('{"choices":[]}')).when(k == 2, no_msg)
            .when(k == 3, F.lit("internal error")).when(k == 4, F.concat(F.lit("<html>"), F.col("text")))
            .when(k == 8, F.concat(good, F.lit(" junk"))).when(k == 9, obj)
            .when(k != 7, good))
    status = F.when(k == 3, 500).when(k == 5, 302).when(k != 6, 200)
    return conv.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn"),
                       status.alias("status"), body.alias("body"))


def q_chat_responses(spark: SparkSession, sf: str) -> DataFrame:
    return parse_responses(responses(spark, sf))


def q_jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = from_jsonl(to_jsonl(fx.segments(spark, sf)))
    return good


def faulty_lines(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines (session_id, seg_idx, line) with injected faults, by
    ``(session_id * 31 + seg_idx) % 13``: a dropped key, an extra key, a line
    cut in half, an empty line, a whitespace-only line, text after the object,
    a nested text, two objects."""
    segs = fx.segments(spark, sf)
    lines = to_jsonl_lines(segs).join(segs.select("session_id", "seg_idx", "speaker", "text", "start_s", "end_s"),
                                      ["session_id", "seg_idx"])
    k = (F.col("session_id") * 31 + F.col("seg_idx")) % 13
    dropped = F.to_json(F.struct("speaker", "text", F.col("start_s").alias("start")))
    extra = F.concat(F.expr("substring(line, 1, length(line) - 1)"), F.lit(',"mood":"x"}'))
    nested = F.to_json(F.struct("speaker", F.struct(F.lit(1).alias("a")).alias("text"),
                                F.col("start_s").alias("start"), F.col("end_s").alias("end")))
    cut = F.expr("substring(line, 1, length(line) div 2)")
    bad = (F.when(k == 0, dropped).when(k == 1, extra).when(k == 2, cut)
           .when(k == 3, F.lit("")).when(k == 4, F.lit("  \t"))
           .when(k == 5, F.concat("line", F.lit(" junk"))).when(k == 6, nested)
           .when(k == 7, F.concat("line", "line")).otherwise(F.col("line")))
    return lines.select("session_id", "seg_idx", bad.alias("line"))


def faulty_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """The faulty lines as one text per session."""
    return ordered_concat(faulty_lines(spark, sf), ["session_id"], "seg_idx", "line", "\n", "jsonl")


def q_jsonl_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(split_lines(faulty_jsonl(spark, sf)))


def asr_results(spark: SparkSession, sf: str) -> DataFrame:
    """Recogniser output shape derived from the segments: one row per
    recognised segment with its timed words; some segments carry no word
    list (null), as the recogniser may return."""
    segs = fx.segments(spark, sf)
    ws = F.transform(F.split("text", " ", -1), lambda w, i: F.struct(
        F.concat(F.lit(" "), w).alias("word"),
        (F.col("start_s") + i * fx.WORD_SECONDS).alias("start"),
        (F.col("start_s") + i * fx.WORD_SECONDS + fx.WORD_SECONDS).alias("end")))
    no_words = (F.col("session_id") * 7 + F.col("seg_idx")) % 9 == 0
    return segs.select("session_id", F.col("seg_idx").alias("seg_pos"),
                       F.when(no_words, F.lit(None).cast(f"array<{ASR_WORD}>")).otherwise(ws).alias("words"))


def q_flatten_asr(spark: SparkSession, sf: str) -> DataFrame:
    return flatten_words(asr_results(spark, sf))


def q_settings_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return resolved_settings(spark, sf)


def q_session_redaction(spark: SparkSession, sf: str) -> DataFrame:
    return redact_as_set(fx.segments(spark, sf), resolved_settings(spark, sf)).select("session_id", "seg_idx", "text")


def q_rejected_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words whose times were spoiled, by ``(session_id + word_idx) % 50``."""
    k = (F.col("session_id") + F.col("word_idx")) % 50
    w = fx.all_fixtures(spark, sf)["words"]
    w = w.withColumn("start_s", F.when(k != 0, F.col("start_s"))).withColumn(
        "end_s", F.when(k == 1, F.lit(1e13)).otherwise(F.col("end_s")))
    return rejected_times(w).select("session_id", "word_idx", "text", "reason")


def batch_stages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Input check of all expected sessions, and the endpoint gate of each
    session's resolved settings."""
    conv = read_table(spark, sf, "conversations")
    words = fx.words_from(fx.segments_from(conv))
    inputs = bt.input_status(fx.expected_from(conv), words)
    st = resolved_settings(spark, sf)
    gates = st.select("session_id", ep.gate(F.coalesce(F.when(F.col("base_url") != "", F.col("base_url")),
                                                       F.lit(ep.DEFAULT_BASE_URL)),
                                            "allow_remote").alias("gate"))
    return inputs, gates


def batch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """C3 up to the gate."""
    return bt.outcomes(*batch_stages(spark, sf))


def q_batch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return batch_outcomes(spark, sf)


def q_batch_report(spark: SparkSession, sf: str) -> DataFrame:
    return bt.report(batch_outcomes(spark, sf))


def note_results(spark: SparkSession, sf: str) -> DataFrame:
    """C2 to its end, per session: the ``content`` of its note or the ``error``
    that prevented it. The responses are those of the first turns."""
    found = parse_responses(responses(spark, sf).where("turn = 0")).withColumn("answered", F.lit(True))
    known = load_templates(spark).select("template_id", F.lit(True).alias("known"))
    j = (resolved_settings(spark, sf).select("session_id", "template_id").join(known, "template_id", "left")
         .join(found, "session_id", "left"))
    error = (F.when(F.col("known").isNull(), F.lit(NO_TEMPLATE))
             .when(F.col("answered").isNull(), F.lit("no response")).otherwise(F.col("error")))
    return j.select("session_id", "content", error.alias("error"))


def note_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    inputs, gates = batch_stages(spark, sf)
    return bt.outcomes(inputs, gates, notes=note_results(spark, sf))


def q_note_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """C3 over every stage: input, gate, template, response."""
    return note_outcomes(spark, sf)


def q_note_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """``{stem}.note.txt`` of every session that came through all stages."""
    return bt.artifacts(note_outcomes(spark, sf), note_results(spark, sf), "content")


def q_failed_names(spark: SparkSession, sf: str) -> DataFrame:
    return bt.failed_names(note_outcomes(spark, sf))


def q_failed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Expected sessions without an artifact."""
    expected = fx.expected_from(read_table(spark, sf, "conversations")).select("session_id", "stem")
    return bt.failed_sessions(expected, q_note_artifacts(spark, sf))


def q_render_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Three templates per session, one of which does not exist."""
    segs = fx.segments(spark, sf)
    wanted = F.array(F.lit("soap"), F.lit("dap"), F.lit("withdrawn"))
    req = fx.settings(spark, sf).select("session_id", "client_name", "session_date", F.explode(wanted).alias("template_id"))
    return render_prompts(session_values(segs), load_templates(spark), req, default_date=RUN_DATE)


def q_batch_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """S9 for a transcript-only batch: ``{stem}.txt`` = timestamped
    transcript + newline, for every session whose input arrived."""
    conv = read_table(spark, sf, "conversations")
    segs = fx.segments_from(conv)
    inputs = bt.input_status(fx.expected_from(conv), fx.words_from(segs))
    outs = bt.outcomes(inputs, transcript_only=True)
    return bt.artifacts(outs, format_transcript(segs, timestamps=True), "transcript")


QUERIES: dict[str, Query] = {
    "redact_documents": q_redact_documents,
    "redact_names": q_redact_names,
    "transcript_plain": q_transcript_plain,
    "transcript_timed": q_transcript_timed,
    "session_summary": q_session_summary,
    "assign_speaker": q_assign_speaker,
    "align_runs": q_align_runs,
    "label_speakers": q_label_speakers,
    "editable_export": q_editable_export,
    "editable_import": q_editable_import,
    "transcript_pipeline": q_transcript_pipeline,
    "render_notes": q_render_notes,
    "prompt_budget": q_prompt_budget,
    "chat_requests": q_chat_requests,
    "endpoint_gate": q_endpoint_gate,
    "chat_responses": q_chat_responses,
    "jsonl_roundtrip": q_jsonl_roundtrip,
    "jsonl_quarantine": q_jsonl_quarantine,
    "flatten_asr": q_flatten_asr,
    "settings_resolution": q_settings_resolution,
    "session_redaction": q_session_redaction,
    "rejected_words": q_rejected_words,
    "batch_outcomes": q_batch_outcomes,
    "batch_report": q_batch_report,
    "batch_artifacts": q_batch_artifacts,
    "note_outcomes": q_note_outcomes,
    "note_artifacts": q_note_artifacts,
    "failed_names": q_failed_names,
    "failed_sessions": q_failed_sessions,
    "render_fanout": q_render_fanout,
}
