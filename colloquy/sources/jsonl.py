"""Segments as JSON lines (S1 read, S2 strict check + quarantine, S3 write).

A line is accepted only if it is a JSON object with exactly the keys
``speaker, text, start, end`` and the required values parse; blank lines are
skipped. A bad line does not fail the job: it becomes a ``rejected`` row with
its reason, and ``seg_idx`` numbers the accepted lines of a session in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsondoc import single_json
from ..functions.redact import redact_patterns
from ..functions.text import strip
from ..operators.scan import ordered_concat, running_sum
from ..operators.settings import json_kind
from .lines import file_session, numbered_lines, read_lines

# ---------------------------------------------------------------------------
# The interchange row's keys (sorted) and its schema.
SEGMENT_KEYS = ["end", "speaker", "start", "text"]
LINE_SCHEMA = "speaker string, text string, start double, end double"
# ---------------------------------------------------------------------------

REASON_JSON, REASON_KEYS, REASON_TYPES = "bad_json", "wrong_keys", "bad_value"


def to_jsonl_lines(segs: DataFrame) -> DataFrame:
    """S3 per row: ``{"speaker","text","start","end"}`` in that key order."""
    obj = F.struct("speaker", "text", F.col("start_s").alias("start"), F.col("end_s").alias("end"))
    return segs.select("session_id", "seg_idx", F.to_json(obj, {"ignoreNullFields": "false"}).alias("line"))


def to_jsonl(segs: DataFrame) -> DataFrame:
    """S3 per session: lines joined by ``\\n`` in ``seg_idx`` order."""
    return ordered_concat(to_jsonl_lines(segs), ["session_id"], "seg_idx", "line", "\n", "jsonl")


def split_lines(docs: DataFrame, text_col: str = "jsonl") -> DataFrame:
    """Whole text per session -> non-blank ``(session_id, line_no, line)``."""
    lines = docs.select("session_id", F.posexplode(F.split(F.col(text_col), "\n", -1))
                        .alias("line_no", "line"))
    return (lines.where(strip("line") != "")
            .withColumn("line_no", F.col("line_no").cast("bigint")))


def line_fault(line: Column) -> Column:
    """Why a line is no segment, else null: the whole line must be one JSON
    object with exactly the four keys, strings and numbers where they belong."""
    doc = single_json(line)
    keys = F.array_sort(F.json_object_keys(line))
    good = F.lit(True)
    for k in SEGMENT_KEYS:
        good &= json_kind(doc, k).isin(*(("int", "float") if k in ("start", "end") else ("str",)))
    rec = F.from_json(line, LINE_SCHEMA)
    good &= rec["start"].isNotNull() & rec["end"].isNotNull()
    return (F.when(doc.isNull() | keys.isNull(), F.lit(REASON_JSON))
            .when(keys != F.array(*[F.lit(k) for k in SEGMENT_KEYS]), F.lit(REASON_KEYS))
            .when(~F.coalesce(good, F.lit(False)), F.lit(REASON_TYPES)))


def parse_lines(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every line (``session_id, line_no, line`` and the columns to ``keep``) with ``status`` (``ok``/``rejected``), ``reason`` and
    the parsed fields; accepted lines get ``seg_idx`` (ordinal per session),
    rejected ones keep the ``line`` itself, redacted, so it can be repaired."""
    line = F.col("line")
    p = lines.select("session_id", "line_no", "line", *keep, line_fault(line).alias("reason"),
                     F.from_json(line, LINE_SCHEMA).alias("_r"))
    p = p.withColumn("_ok", F.col("reason").isNull().cast("int"))
    p = running_sum(p, ["session_id"], "line_no", "_ok", "_before", exclusive=True)
    ok = F.col("_ok") == 1
    return p.select(
        "session_id", "line_no", *keep,
        F.when(ok, F.lit("ok")).otherwise(F.lit("rejected")).alias("status"),
        "reason",
        F.when(ok, F.col("_before")).alias("seg_idx"),
        F.when(ok, F.col("_r.speaker")).alias("speaker"),
        F.when(ok, F.col("_r.text")).alias("text"),
        F.when(ok, F.col("_r.start")).alias("start_s"),
        F.when(ok, F.col("_r.end")).alias("end_s"),
        F.when(~ok, redact_patterns("line")).alias("line"),
    )


def from_jsonl(docs: DataFrame, text_col: str = "jsonl") -> tuple[DataFrame, DataFrame]:
    """``(good segments, rejected lines)``."""
    parsed = parse_lines(split_lines(docs, text_col))
    good = parsed.where(F.col("status") == "ok").select(
        "session_id", "seg_idx", "speaker", "text", "start_s", "end_s")
    rejected = parsed.where(F.col("status") != "ok").select("session_id", "line_no", "reason", "line")
    return good, rejected


def read_jsonl(spark: SparkSession, path: str, session: Callable[[Column], Column] = file_session,
               glob: str | None = None) -> DataFrame:
    """S1 from files: non-blank ``(session_id, line_no, line)`` of all files
    under ``path``, one session a file, named by ``session(file)``. A file is
    read in splits, so it may be of any size."""
    lines = numbered_lines(read_lines(spark, path, glob))
    return lines.where(strip("line") != "").select(session(F.col("file")).alias("session_id"), "line_no", "line")
