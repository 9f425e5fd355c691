"""Transcripts and redacted segments of arriving files (R1, R2), exactly once.

Files with many sessions each arrive in a folder; a session lies in one file.
Each micro-batch runs the whole batch pipeline over its new files and writes
two tables, what was accepted and what was rejected and why, into folders named
by the batch. The checkpoint fixes which files a batch has, and a batch that
failed between its two tables overwrites both when it is run again, so every
row appears once whatever stopped the stream. Nothing is kept between batches:
there is no state and no watermark, as there is no event time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import redact_patterns, redact_text
from ..functions.text import strip
from ..operators.align import align
from ..operators.transcript import format_transcript
from ..sources.asr import parse_documents, rejected_documents, turns_from_documents, words_from_documents
from ..sources.jsonl import parse_lines
from ..session import dropping_tables, materialize
from ..sources.lines import located, numbered_lines

ACCEPTED, REJECTED = "accepted", "rejected"
TRANSCRIPTS = "session_id long, transcript string, batch_id long"
SEGMENTS = "session_id long, seg_idx long, speaker string, text string, start_s double, end_s double, batch_id long"
REJECTS = "file string, line_no long, reason string, line string, batch_id long"
BAD_PREFIX = "no session id"

Batch = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """All rows of one batch in a folder of its own, which a rerun replaces."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_sink(spark: SparkSession, out_dir: str, table: str, schema: str) -> DataFrame:
    """All batches' rows of a table, with ``batch_id``."""
    return spark.read.schema(schema).parquet(f"{out_dir}/{table}")


def process_files(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, batch: Batch,
                  files_per_batch: int | None = None, once: bool = True):
    """Run ``batch`` (numbered lines -> accepted, rejected) over the files that
    arrive; with ``once`` over those that are there. Returns the query."""
    reader = spark.readStream.format("text").option("lineSep", "\n").option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def run(rows: DataFrame, batch_id: int) -> None:
        lines = numbered_lines(rows)
        lines = lines.where(strip("line") != "")
        with dropping_tables(rows.sparkSession):
            for table, out in zip((ACCEPTED, REJECTED), batch(lines)):
                write_batch(out, f"{out_dir}/{table}", batch_id)

    writer = located(reader.load(in_dir)).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if not once:
        return writer.start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def transcribe_batch(names: str | None, redacted: Sequence[str] | None) -> Batch:
    """Documents of recognised words and speaker tracks, one a line, to the
    transcripts of their sessions (C1): align, name, redact, format. A batch is
    read and parsed once, and so are its turns, which alignment reads many times."""

    def run(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        parsed = parse_documents(lines, "line").withColumn("line", F.when(F.col("reason").isNotNull(), F.col("line")))
        parsed = materialize(parsed, "parsed")
        turns = materialize(turns_from_documents(parsed).drop("extra"), "turns")
        segs = align(words_from_documents(parsed), turns, names=names)
        segs = segs.withColumn("text", redact_text("text", redacted))
        return format_transcript(segs, timestamps=True), rejected_documents(parsed).withColumn("line", redact_patterns("line")).select(
            "file", "line_no", "reason", "line")

    return run


def redact_batch(names: Sequence[str] | None) -> Batch:
    """R2: segments as JSON lines, each after its session's id and a tab, to
    redacted segments, numbered in the order of the file."""

    def run(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        session = F.expr("try_cast(substring_index(line, '\t', 1) as bigint)")
        known = lines.withColumn("session_id", F.when(F.instr("line", "\t") > 0, session))
        body = F.expr("substring(line, instr(line, '\t') + 1)")
        parsed = parse_lines(known.where("session_id is not null").withColumn("line", body), keep=("file",))
        good = parsed.where("status = 'ok'").withColumn("text", redact_text("text", names))
        bad = parsed.where("status <> 'ok'").select("file", "line_no", "reason", "line")
        strange = known.where("session_id is null").select("file", "line_no", F.lit(BAD_PREFIX).alias("reason"), redact_patterns("line").alias("line"))
        return good.select("session_id", "seg_idx", "speaker", "text", "start_s", "end_s"), bad.union(strange)

    return run


def transcripts_of_files(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, names: str | None = None,
                         redacted: Sequence[str] | None = None, files_per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """R1 over the files that are there: (transcripts, rejected lines) of all batches so far."""
    process_files(spark, in_dir, out_dir, checkpoint, transcribe_batch(names, redacted), files_per_batch)
    return read_sink(spark, out_dir, ACCEPTED, TRANSCRIPTS), read_sink(spark, out_dir, REJECTED, REJECTS)
