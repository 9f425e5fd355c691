"""Incremental transcripts on Structured Streaming.

New session files (JSON lines, one file per session) arriving in a folder
are parsed, checked, redacted and appended to a Parquet table. One file is
one row (``wholetext``), so the whole chain is stateless: lines are split,
checked and numbered with higher-order functions inside the row, then
exploded; no streaming state and no watermark are needed (the reference has
no event time). ``trigger(availableNow=True)`` processes what is there and
stops; the checkpoint makes a rerun pick up only new files, exactly once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import redact_text
from ..functions.text import strip
from ..session import ensure_checkpoint_dir
from ..sources.jsonl import LINE_SCHEMA, line_fault

OUT_COLUMNS = ["session_id", "seg_idx", "speaker", "text", "start_s", "end_s"]


def parse_inline(text: Column) -> Column:
    """Whole JSONL text -> ``ARRAY<STRUCT<line_no, ok, speaker, text, start,
    end>>`` of its non-blank lines (same checks as S2)."""
    lines = F.split(text, "\n", -1)
    numbered = F.transform(lines, lambda ln, i: F.struct(i.alias("line_no"), ln.alias("line")))
    nonblank = F.filter(numbered, lambda x: strip(x["line"]) != "")

    def check(x: Column) -> Column:
        rec = F.from_json(x["line"], LINE_SCHEMA)
        return F.struct(x["line_no"].alias("line_no"), line_fault(x["line"]).isNull().alias("ok"),
                        rec["speaker"].alias("speaker"), rec["text"].alias("text"),
                        rec["start"].alias("start"), rec["end"].alias("end"))

    return F.transform(nonblank, check)


def segments_from_files(stream: DataFrame) -> DataFrame:
    """``(session_id, value)`` rows, one per file -> accepted segments."""
    parsed = stream.select("session_id", parse_inline(F.col("value")).alias("_l"))
    good = parsed.select("session_id", F.filter("_l", lambda x: x["ok"]).alias("_g"))
    seg = good.select("session_id", F.posexplode("_g").alias("seg_idx", "_s"))
    return seg.select(
        F.col("session_id").cast("bigint").alias("session_id"),
        F.col("seg_idx").cast("bigint").alias("seg_idx"),
        F.col("_s.speaker").alias("speaker"), F.col("_s.text").alias("text"),
        F.col("_s.start").alias("start_s"), F.col("_s.end").alias("end_s"))


def redact_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                  names: Sequence[str] | None = None, once: bool = True):
    """R1 + R2: start the stream; with ``once`` run to completion
    (``availableNow``) and return the finished query."""
    src = (spark.readStream.format("text").option("wholetext", True)
           .option("recursiveFileLookup", False).load(in_dir))
    segs = segments_from_files(src).withColumn("text", redact_text("text", names))
    w = (segs.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    q = w.trigger(availableNow=True).start() if once else w.start()
    if once:
        q.awaitTermination()
    return q


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (the shared
    folder the cluster names), never a machine-local temporary folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")
