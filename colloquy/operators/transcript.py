"""Transcript text (F2, F3, S10, S11, W4) and session aggregates (A3-A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import to_java
from ..functions.text import clock, duration_text, parse_clock, strip
from .scan import ordered_concat, running_sum

# ---------------------------------------------------------------------------
# Transcript and editable-text formats.
ARROW = "→"
LINE_SEP = "\n\n"
# header line of the editable format (Python ``re`` syntax)
HEADER = r"^\[(\d+:\d+)\s*→\s*(\d+:\d+)\]\s*(.+?)\s*:$"
EMPTY_DURATION = "0:00"
# ---------------------------------------------------------------------------

# Java: UNIX_LINES so '.' takes '\r' and '$' is only end of line, as in Python
HEADER_JAVA = "(?d)" + to_java(HEADER)[:-1] + r"\z"


def time_range(start="start_s", end="end_s") -> Column:
    return F.concat(F.lit("["), clock(start), F.lit(f" {ARROW} "), clock(end), F.lit("]"))


def format_line(timestamps: bool) -> Column:
    """``speaker: text`` or ``[MM:SS → MM:SS] speaker: text``."""
    body = F.concat(F.col("speaker"), F.lit(": "), F.col("text"))
    if timestamps:
        return F.concat(time_range(), F.lit(" "), body)
    return body


def format_transcript(segs: DataFrame, timestamps: bool = False,
                      sessions: DataFrame | None = None, out: str = "transcript") -> DataFrame:
    """per session, lines in ``seg_idx`` order joined by a blank line.
    With ``sessions`` (``session_id`` list) sessions without segments get
    an empty string."""
    lines = segs.select("session_id", "seg_idx", format_line(timestamps).alias("_line"))
    res = ordered_concat(lines, ["session_id"], "seg_idx", "_line", LINE_SEP, out)
    if sessions is not None:
        res = (sessions.select("session_id").join(res, "session_id", "left")
               .select("session_id", F.coalesce(out, F.lit("")).alias(out)))
    return res


def to_editable(segs: DataFrame, sessions: DataFrame | None = None,
                out: str = "editable") -> DataFrame:
    """Header line + text per segment, blank line between blocks,
    trailing newline (a session without segments gives ``"\\n"``)."""
    block = F.concat(time_range(), F.lit(" "), F.col("speaker"), F.lit(":\n"), F.col("text"))
    blocks = segs.select("session_id", "seg_idx", block.alias("_blk_text"))
    res = ordered_concat(blocks, ["session_id"], "seg_idx", "_blk_text", LINE_SEP, "_body")
    if sessions is not None:
        res = sessions.select("session_id").join(res, "session_id", "left")
    return res.select("session_id", F.concat(F.coalesce("_body", F.lit("")), F.lit("\n")).alias(out))


def from_editable(docs: DataFrame, text_col: str = "editable") -> DataFrame:
    """S11 + W4 + F4: editable text -> segments.

    Each header opens a block running to the next header; text before the
    first header is dropped; malformed headers stay body text; the body is
    stripped and may hold blank lines; times come back as whole seconds.
    Returns ``session_id, seg_idx, speaker, text, start_s, end_s``.
    """
    lines = docs.select("session_id", F.posexplode(F.split(F.col(text_col), "\n", -1))
                        .alias("line_no", "line"))
    lines = lines.withColumn("_is_header", F.col("line").rlike(HEADER_JAVA).cast("int"))
    lines = running_sum(lines, ["session_id"], "line_no", "_is_header", "_block")
    lines = lines.where(F.col("_block") > 0)
    heads = lines.where(F.col("_is_header") == 1).select(
        "session_id", "_block",
        strip(F.regexp_extract("line", HEADER_JAVA, 3)).alias("speaker"),
        parse_clock(F.regexp_extract("line", HEADER_JAVA, 1)).alias("start_s"),
        parse_clock(F.regexp_extract("line", HEADER_JAVA, 2)).alias("end_s"),
    )
    bodies = ordered_concat(lines.where(F.col("_is_header") == 0),
                            ["session_id", "_block"], "line_no", "line", "\n", "_body")
    return (heads.join(bodies, ["session_id", "_block"], "left")
            .select("session_id", (F.col("_block") - 1).cast("bigint").alias("seg_idx"), "speaker",
                    strip(F.coalesce("_body", F.lit(""))).alias("text"), "start_s", "end_s"))


def session_summary(segs: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """A3-A5: duration ``m:ss``, sorted distinct speakers, counts."""
    agg = segs.groupBy("session_id").agg(
        duration_text(F.max("end_s") - F.min("start_s")).alias("duration"),
        F.array_join(F.array_sort(F.collect_set("speaker")), ", ").alias("speakers"),
        F.count(F.lit(1)).alias("n_segments"),
        F.size(F.collect_set("speaker")).cast("bigint").alias("n_speakers"),
    )
    if sessions is not None:
        agg = sessions.select("session_id").join(agg, "session_id", "left").select(
            "session_id",
            F.coalesce("duration", F.lit(EMPTY_DURATION)).alias("duration"),
            F.coalesce("speakers", F.lit("")).alias("speakers"),
            F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
            F.coalesce("n_speakers", F.lit(0)).alias("n_speakers"),
        )
    return agg
