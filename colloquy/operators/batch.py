"""Batch processing with per-session isolation.

One bad session never stops the others: every expected session ends in an
outcome row (``ok`` or ``failed`` with the stage and reason), artifacts are
written only for successes, and the report is one global aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import endpoint as ep

# ---------------------------------------------------------------------------
# Artifact suffixes and outcome vocabulary.
TRANSCRIPT_SUFFIX = ".txt"
NOTE_SUFFIX = ".note.txt"
AUDIO_SUFFIX = ".wav"
# ---------------------------------------------------------------------------

OK, FAILED = "ok", "failed"
NO_STAGE, TOTAL = "none", "total"
STAGES = (NO_STAGE, "input", "summarize")


def input_status(expected: DataFrame, words: DataFrame) -> DataFrame:
    """``expected(session_id, stem, n_bytes)`` against the words that
    exist: ``missing`` (nothing arrived), ``empty`` (zero bytes or no
    words), else ``ok``. Word counts are a partial (map-side) aggregate."""
    counts = words.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_words"))
    j = expected.join(counts, "session_id", "left")
    status = (F.when(F.col("n_bytes").isNull(), F.lit("missing"))
              .when((F.col("n_bytes") == 0) | F.col("n_words").isNull(), F.lit("empty"))
              .otherwise(F.lit(OK)))
    return j.select("session_id", "stem", status.alias("input_status"),
                    F.coalesce("n_words", F.lit(0)).alias("n_words"))


def outcomes(inputs: DataFrame, gates: DataFrame | None = None,
             transcript_only: bool = False, notes: DataFrame | None = None) -> DataFrame:
    """C3 + X2: one row per expected session: ``status``, ``stage``,
    ``reason`` and, for successes, the artifact ``file_name``. ``gates``
    (``session_id, gate``) and ``notes`` (``session_id, error``, one row per
    session) apply to note runs: a refused endpoint, an absent template or an
    erroneous response fails that session only."""
    j = inputs
    if gates is not None and not transcript_only:
        j = j.join(gates.select("session_id", "gate"), "session_id", "left")
    else:
        j = j.withColumn("gate", F.lit(ep.GATE_OK))
    if notes is not None and not transcript_only:
        j = j.join(notes.select("session_id", "error"), "session_id", "left")
    else:
        j = j.withColumn("error", F.lit(None).cast("string"))
    bad_input = F.col("input_status") != OK
    refused = F.col("gate") == ep.GATE_REFUSED
    erroneous = F.col("error").isNotNull()
    status = F.when(bad_input | refused | erroneous, F.lit(FAILED)).otherwise(F.lit(OK))
    stage = F.when(bad_input, F.lit("input")).when(refused | erroneous, F.lit("summarize"))
    reason = (F.when(bad_input, F.concat(F.lit("input "), F.col("input_status")))
              .when(refused, F.lit("remote endpoint without allow_remote"))
              .otherwise(F.col("error")))
    suffix = TRANSCRIPT_SUFFIX if transcript_only else NOTE_SUFFIX
    return j.select(
        "session_id", "stem",
        F.concat(F.col("stem"), F.lit(AUDIO_SUFFIX)).alias("input_name"),
        status.alias("status"), stage.alias("stage"), reason.alias("reason"),
        F.when(status == OK, F.concat(F.col("stem"), F.lit(suffix))).alias("file_name"),
    )


def failed_sessions(expected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Expected sessions that produced no artifact."""
    return expected.join(artifacts.select("session_id"), "session_id", "left_anti")


def report(outs: DataFrame) -> DataFrame:
    """A6 totals per status and stage (a global partial aggregate). The
    failed names are the ``failed_names`` table, not one string: their
    number grows with the input."""
    return outs.groupBy("status", "stage").agg(F.count(F.lit(1)).alias("n_sessions"))


def observed_counts(outs: DataFrame, name: str = "outcomes") -> tuple[DataFrame, Observation]:
    """``outs`` and an observation that its first action fills with the A6
    totals: the job that writes the outcomes counts them on its way."""
    seen = Observation(name)
    stage = F.coalesce("stage", F.lit(NO_STAGE))
    metrics = [F.count_if((F.col("status") == s) & (stage == t)).alias(f"{s}:{t}") for s in (OK, FAILED) for t in STAGES]
    return outs.observe(seen, F.count(F.lit(1)).alias(TOTAL), *metrics), seen


def report_observed(spark: SparkSession, seen: Observation) -> DataFrame:
    """A6 totals from the observation: the rows of ``report``."""
    got = dict(seen.get)
    total = got.pop(TOTAL)
    if total != sum(got.values()):
        raise ValueError(f"{total} outcomes, {sum(got.values())} of a known status and stage")
    rows = [(s, None if t == NO_STAGE else t, n) for (s, t), n in ((k.split(":"), n) for k, n in got.items()) if n]
    return spark.createDataFrame(rows, "status string, stage string, n_sessions long")


def write_outcomes(outs: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write the outcomes and report on them (A6) in one job."""
    told, seen = observed_counts(outs)
    told.write.mode(mode).parquet(path)
    return report_observed(outs.sparkSession, seen)


def failed_names(outs: DataFrame) -> DataFrame:
    """A6 names: failed inputs; order them by ``input_name`` when shown."""
    return outs.where(F.col("status") == FAILED).select("input_name", "stage", "reason")


def artifacts(outs: DataFrame, contents: DataFrame, content_col: str) -> DataFrame:
    """``(session_id, file_name, content)`` for successes; content ends
    with a newline as the written files do."""
    ok = outs.where(F.col("status") == OK).select("session_id", "file_name")
    return ok.join(contents.select("session_id", content_col), "session_id").select(
        "session_id", "file_name", F.concat(F.col(content_col), F.lit("\n")).alias("content"))


def write_artifacts(arts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink: one Parquet table keyed by ``file_name`` (a file per session
    would mean millions of tiny files at scale)."""
    arts.write.mode(mode).parquet(path)
