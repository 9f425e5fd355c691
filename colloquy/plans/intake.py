"""Registered queries of the file side: files read in splits (S1), raw model
output (S4, S5), arriving files (R1, R2) and files per session (S9), with SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..sources.asr import parse_documents, rejected_documents, turns_from_documents, words_from_documents
from ..sources.files import read_session_files, write_session_files
from ..sources.jsonl import parse_lines, read_jsonl
from ..streaming.arrivals import process_files, read_sink, redact_batch, transcripts_of_files, ACCEPTED, SEGMENTS
from ..streaming.incremental import scratch_dir
from . import oracle as sql
from .queries import REDACT_NAMES, SPEAKER_NAMES, faulty_lines, q_batch_artifacts
from ..sources.jsonl import to_jsonl_lines

N_FILES = 8  # files of many sessions that the stand-ins are written to
N_RECORDINGS = 16  # long recordings that the conversations are dealt to


def write_files(lines: DataFrame, folder: str, file: str, order: list[str], line: str) -> None:
    """Lines (one column) as text, one folder and file for each value of
    ``file``, in the given order."""
    lines.repartition(file).sortWithinPartitions(file, *order).select(file, line).write.partitionBy(file).text(folder)


def q_jsonl_files(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings as JSONL files with faults, read in splits."""
    lines = faulty_lines(spark, sf).withColumn("recording", F.col("session_id") % N_RECORDINGS)
    folder = scratch_dir(spark, "jsonl-files")
    write_files(lines, folder, "recording", ["session_id", "seg_idx"], "line")
    return parse_lines(read_jsonl(spark, folder, lambda f: F.regexp_extract(f, r"recording=(\d+)/", 1).cast("long")))


def track_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Diarizer output: two tracks a document, some with a field of their own."""
    t = fx.all_fixtures(spark, sf)["turns"]
    extra = F.when(F.col("turn_idx") % 2 == 1, (F.col("turn_idx") % 4).cast("long"))
    track = F.struct("speaker", F.col("start_s").alias("start"), F.col("end_s").alias("end"), extra.alias("confidence"))
    t = t.groupBy("session_id", F.floor(F.col("turn_idx") / 2).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", track.alias("t")))), lambda x: x["t"]).alias("tracks"))
    return t.select(F.to_json(F.struct("session_id", "part", "tracks")).alias("doc"))


def q_turns_from_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """S5 from JSON text."""
    return turns_from_documents(parse_documents(track_documents(spark, sf)))


def word_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Recogniser output, one segment a document: (session_id, part, doc, text)."""
    segs = fx.segments(spark, sf)
    words = F.transform(F.split("text", " ", -1), lambda w, i: F.struct(
        F.concat(F.lit(" "), w).alias("word"), (F.col("start_s") + i * fx.WORD_SECONDS).alias("start"),
        (F.col("start_s") + i * fx.WORD_SECONDS + fx.WORD_SECONDS).alias("end")))
    doc = F.to_json(F.struct("session_id", F.col("seg_idx").alias("part"), F.array(F.struct(words.alias("words"))).alias("segments")))
    return segs.select("session_id", F.col("seg_idx").alias("part"), doc.alias("doc"), "text")


def bad_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are no recogniser's, one for every ninth segment, of
    four kinds by ``(session_id + part) % 4``."""
    head = F.concat(F.lit('{"session_id":'), F.col("session_id").cast("string"), F.lit(',"part":'), F.col("part").cast("string"))
    k = (F.col("session_id") + F.col("part")) % 4
    doc = (F.when(k == 0, F.concat(head, F.lit(',"segments":[],"text":'), F.translate("text", "\n", " ")))
           .when(k == 1, F.concat(head, F.lit("}")))
           .when(k == 2, F.concat(head, F.lit(',"segments":[{"words":[{"word":"x"}]}]}')))
           .otherwise(F.concat(head, F.lit(',"tracks":[{"speaker":5,"start":0,"end":1}]}'))))
    words = word_documents(spark, sf).where("(session_id * 7 + part) % 9 = 0")
    return words.select("session_id", "part", doc.alias("doc"))


def q_words_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """S4 from JSON text."""
    return words_from_documents(parse_documents(word_documents(spark, sf).select("doc")))


def q_rejected_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that neither takes, among sound ones."""
    docs = word_documents(spark, sf).select("doc").union(bad_documents(spark, sf).select("doc"))
    return rejected_documents(parse_documents(docs))


def arriving_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lines (file, session_id, part, nth, line) of files that hold the tracks,
    the words and the bad documents of many sessions."""
    t = fx.all_fixtures(spark, sf)["turns"]
    track = F.array(F.struct("speaker", F.col("start_s").alias("start"), F.col("end_s").alias("end")))
    tracks = t.select("session_id", F.col("turn_idx").alias("part"), F.lit(0).alias("nth"), F.to_json(
        F.struct("session_id", F.col("turn_idx").alias("part"), track.alias("tracks"))).alias("line"))
    words = word_documents(spark, sf).select("session_id", "part", F.lit(1).alias("nth"), F.col("doc").alias("line"))
    bad = bad_documents(spark, sf).select("session_id", "part", F.lit(2).alias("nth"), F.col("doc").alias("line"))
    return tracks.union(words).union(bad).withColumn("file", F.col("session_id") % N_FILES)


def _transcribed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    base = scratch_dir(spark, "arrivals")
    folder = os.path.join(base, "in")
    write_files(arriving_documents(spark, sf), folder, "file", ["session_id", "part", "nth"], "line")
    return transcripts_of_files(spark, folder, os.path.join(base, "out"), os.path.join(base, "checkpoint"), SPEAKER_NAMES, REDACT_NAMES, files_per_batch=3)


def q_streaming_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """The transcripts of arriving files, in several batches. Equals the
    batch pipeline over the same sessions."""
    return _transcribed(spark, sf)[0].select("session_id", "transcript")


def q_streaming_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of arriving files that no transcript takes."""
    return _transcribed(spark, sf)[1].select(F.regexp_extract("file", r"/file=(\d+)/", 1).cast("long").alias("file"), "line_no", "reason", "line")


def q_streaming_redact(spark: SparkSession, sf: str) -> DataFrame:
    """R2: segments as JSON lines, many sessions a file, picked up by a stream,
    checked, numbered and redacted. Equals the batch redaction."""
    base = scratch_dir(spark, "stream-redact")
    folder, out = os.path.join(base, "in"), os.path.join(base, "out")
    lines = to_jsonl_lines(fx.segments(spark, sf)).withColumn("file", F.col("session_id") % N_FILES)
    lines = lines.withColumn("line", F.concat(F.col("session_id").cast("string"), F.lit("\t"), F.col("line")))
    write_files(lines, folder, "file", ["session_id", "seg_idx"], "line")
    process_files(spark, folder, out, os.path.join(base, "checkpoint"), redact_batch(REDACT_NAMES))
    return read_sink(spark, out, ACCEPTED, SEGMENTS).drop("batch_id")


def q_session_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each session that came through, written by the tasks,
    and read back by the manifest."""
    folder = scratch_dir(spark, "session-files")
    write_session_files(q_batch_artifacts(spark, sf), folder)
    return read_session_files(spark, folder).select("session_id", "file_name", "content")


QUERIES = {name.removeprefix("q_"): query for name, query in list(globals().items()) if name.startswith("q_") and query is not q_batch_artifacts}

BAD_CTE = """
bad AS (
  SELECT session_id, seg_idx AS part,
    CASE (session_id + seg_idx) % 4
      WHEN 0 THEN head || ',"segments":[],"text":' || translate(text, chr(10), ' ')
      WHEN 1 THEN head || '}'
      WHEN 2 THEN head || ',"segments":[{"words":[{"word":"x"}]}]}'
      ELSE head || ',"tracks":[{"speaker":5,"start":0,"end":1}]}' END AS doc,
    CASE (session_id + seg_idx) % 4 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'unknown_kind' WHEN 2 THEN 'bad_segments' ELSE 'bad_tracks' END AS reason
  FROM (SELECT *, '{"session_id":' || session_id || ',"part":' || seg_idx AS head FROM seg WHERE (session_id * 7 + seg_idx) % 9 = 0) h
)"""

ORACLE = {
    "jsonl_files": sql.with_(sql.jsonl_ctes(f"""
ln AS (
  SELECT * FROM (
    SELECT session_id % {N_RECORDINGS} AS session_id, line,
           row_number() OVER (PARTITION BY session_id % {N_RECORDINGS} ORDER BY session_id, seg_idx) - 1 AS line_no
    FROM fl) x
  WHERE {sql.strip('line')} <> ''
)"""), sql.QUARANTINE),
    "turns_from_tracks": sql.with_(sql.FIXTURE_CTES, """
SELECT session_id, CAST(turn_idx AS BIGINT) AS turn_idx, speaker, CAST(start_s AS DOUBLE) AS start_s, CAST(end_s AS DOUBLE) AS end_s,
       CASE WHEN turn_idx % 2 = 1 THEN '{"confidence":' || (turn_idx % 4) || '}' END AS extra FROM turns"""),
    "words_from_json": sql.with_(sql.FIXTURE_CTES, "SELECT * FROM words"),
    "rejected_documents": sql.with_(sql.FIXTURE_CTES + "," + BAD_CTE, "SELECT doc, reason FROM bad"),
    "streaming_transcripts": sql.ORACLE["transcript_pipeline"],
    "streaming_rejects": sql.with_(sql.FIXTURE_CTES + "," + BAD_CTE + f""",
lines AS (
  SELECT session_id, turn_idx AS part, 0 AS nth, NULL AS doc, NULL AS reason FROM turns
  UNION ALL SELECT session_id, seg_idx, 1, NULL, NULL FROM seg
  UNION ALL SELECT session_id, part, 2, doc, reason FROM bad),
numbered AS (
  SELECT *, session_id % {N_FILES} AS file, row_number() OVER (PARTITION BY session_id % {N_FILES} ORDER BY session_id, part, nth) - 1 AS line_no FROM lines)""",
                                   f"SELECT file, line_no, reason, {sql.redact_patterns('doc')} AS line FROM numbered WHERE nth = 2"),
    "streaming_redact": sql.ORACLE["streaming_redact"],
    "session_files": sql.ORACLE["batch_artifacts"],
}
