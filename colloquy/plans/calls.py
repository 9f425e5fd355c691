"""The note pipeline to its end (C2): requests of all sessions, sent, answered
and parsed, with a client that answers from a recorded table; its report (A6);
and redaction with many names (D6)."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import endpoint as ep
from ..functions.dialect import WORD_CLASS
from ..operators.batch import write_outcomes
from ..operators.calls import answer_requests, patient
from ..operators.names import redact_many_names
from ..operators.notes import parse_responses
from ..session import read_table
from ..sources import fixtures as fx
from ..sources.files import store
from ..streaming.incremental import scratch_dir
from . import oracle as sql
from .queries import note_outcomes, q_chat_requests, responses

PER_BUCKET = 500  # recorded answers a bucket, on average: what a look-up reads


def bucket_of(session: object, buckets: int) -> int:
    """In Python what ``record`` does in SQL."""
    return zlib.crc32(str(session).encode()) % buckets


def record(answers: DataFrame, path: str) -> int:
    """``answers(session_id, status, body)`` for ``replay``, dealt to as many
    buckets as keep each small; their number."""
    buckets = max(1, -(-answers.count() // PER_BUCKET))
    dealt = answers.select("session_id", "status", "body", F.pmod(F.crc32(F.col("session_id").cast("string")), F.lit(buckets)).alias("bucket"))
    dealt.repartition("bucket").write.partitionBy("bucket").parquet(path)
    return buckets


def replay(path: str, buckets: int) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    """A client that answers a session's request with what was recorded for it."""

    def make() -> Callable[[pd.DataFrame], pd.DataFrame]:
        import pyarrow.dataset as ds

        files, root = store(path)

        def recorded(session: object) -> list[dict]:
            try:
                bucket = ds.dataset(f"{root}/bucket={bucket_of(session, buckets)}", filesystem=files, format="parquet")
            except FileNotFoundError:  # nothing was recorded for any session of the bucket
                return []
            return bucket.to_table(["status", "body"], filter=ds.field("session_id") == session).to_pylist()[:1]

        def client(pdf: pd.DataFrame) -> pd.DataFrame:
            out = [answer for session in pdf["session_id"].tolist() for answer in recorded(session)]
            return pd.DataFrame(out, columns=["status", "body"])

        return client

    return make


def q_note_calls(spark: SparkSession, sf: str) -> DataFrame:
    """U1 in C2: resolved settings, redaction, prompts, gate, calls in several
    batches, parsed answers."""
    base = scratch_dir(spark, "calls")
    recorded = os.path.join(base, "recorded")
    buckets = record(responses(spark, sf).where("turn = 0"), recorded)
    client = patient(replay(recorded, buckets), tries=2, first_wait=0.0)
    answered = answer_requests(q_chat_requests(spark, sf), client, os.path.join(base, "answers"), per_batch=500)
    return parse_responses(answered)


def q_observed_report(spark: SparkSession, sf: str) -> DataFrame:
    """The batch report from the job that writes the outcomes."""
    return write_outcomes(note_outcomes(spark, sf), scratch_dir(spark, "outcomes"))


def session_names(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names a session is to be rid of: the first word of each of its turns, in
    turn order, then a tenth of all customers, most of whom no text names. The
    tenths are lists, and the sessions say which one they have."""
    conv = read_table(spark, sf, "conversations")
    said = conv.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("ord"), F.regexp_extract("text", f"({WORD_CLASS}+)", 1).alias("name"))
    others = read_table(spark, sf, "customer").select((F.col("c_custkey") % 10).alias("list_id"), (F.col("c_custkey") + 1000000).alias("ord"), F.col("c_name").alias("name"))
    members = conv.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 10).alias("list_id"))
    return said, others, members


def q_redact_many_names(spark: SparkSession, sf: str) -> DataFrame:
    """D6 with hundreds of names a session and more, by those that occur."""
    said, others, members = session_names(spark, sf)
    return redact_many_names(fx.segments(spark, sf), said, shared=others, members=members).select("session_id", "seg_idx", "text")


QUERIES = {"note_calls": q_note_calls, "observed_report": q_observed_report, "redact_many_names": q_redact_many_names}

_BASE = f"coalesce(nullif(s.base_url, ''), {sql.sql_string(ep.DEFAULT_BASE_URL)})"
ORACLE = {
    "observed_report": sql.with_(sql.NOTE_CTES, "SELECT status, stage, count(*) AS n_sessions FROM nouts GROUP BY status, stage"),
    # names of one word match whole words; those of customers hold a sign that no text has
    "redact_many_names": sql.with_(sql.FIXTURE_CTES, r"""
SELECT s.session_id, s.seg_idx, array_to_string(list_transform(
         regexp_extract_all(s.text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'),
         lambda w: CASE WHEN list_contains(n.names, lower(w)) THEN '[NAME]' ELSE w END), '') AS text
FROM seg s JOIN (
  SELECT conv_id AS session_id, list(DISTINCT lower(regexp_extract(text, '[\p{L}\p{N}_]+'))) AS names
  FROM conversations GROUP BY conv_id) n ON s.session_id = n.session_id"""),
    "note_calls": sql.with_(sql.PROMPT_CTES + "," + sql.RESPONSES_CTE + f""",
answer AS (SELECT session_id, content, {sql.RESPONSE_ERROR} AS error FROM parsed WHERE turn = 0)""", f"""
SELECT p.session_id, p.template_id, a.content, a.error
FROM prompts p JOIN resolved s ON p.session_id = s.session_id JOIN answer a ON a.session_id = p.session_id
WHERE p.prompt IS NOT NULL AND {sql.gate_sql(_BASE, 's.allow_remote')} <> 'refused'"""),
}
