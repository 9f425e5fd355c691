"""Tables derived from the driver's ``conversations`` (FIXTURES.md §4).

The reference works on timed words and speaker turns produced by models we
do not run; these builders derive the same shapes from the given tables with
Spark, so every query's work grows with the input. All times are multiples
of 1/8 s, so doubles are exact in every engine.

* ``session_texts``: conversations with injected PII / names / ``$`` (§E)
* ``segments``: one per turn, 0.25 s per space-separated token, 0.5 s gap
* ``turns``: segments shifted so gaps, overlaps and ties occur; sessions
  whose id ends in 9 have no diarization at all (the no-turns branch)
* ``words``: one per token, leading space kept, dense ``word_idx``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import running_sum
from ..session import read_table

# ---------------------------------------------------------------------------
# Fixed values of the derived fixtures (FIXTURES.md §4 and §E).
WORD_SECONDS = 0.25
TURN_GAP_SECONDS = 0.5
PII_SUFFIX = " Call 555-123-4567 or 01/15/1990, SSN 123-45-6789"
NAME_PREFIX = "John met jane SMITH. "
NAME_SUFFIX = " JOHN"
DOLLAR_SUFFIX = " costs $date"
NAMES = ["John", "Jane Smith"]
# ---------------------------------------------------------------------------


def session_texts(conv: DataFrame) -> DataFrame:
    t = F.col("text")
    t = F.when(F.col("conv_id") % 7 == 0, F.concat(t, F.lit(PII_SUFFIX))).otherwise(t)
    t = F.when(F.col("turn") % 5 == 2, F.concat(F.lit(NAME_PREFIX), t, F.lit(NAME_SUFFIX))).otherwise(t)
    t = F.when(F.col("conv_id") % 11 == 0, F.concat(t, F.lit(DOLLAR_SUFFIX))).otherwise(t)
    return conv.select("conv_id", "turn", "role", t.alias("text"))


def _n_tokens(text: str = "text"):
    # number of ' '-separated tokens = spaces + 1
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))) + 1


def segments_from(conv: DataFrame) -> DataFrame:
    s = session_texts(conv).select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").cast("int").alias("seg_idx"),
        F.col("role").alias("speaker"),
        "text",
        (_n_tokens() * F.lit(WORD_SECONDS)).cast("double").alias("_dur"),
    )
    s = running_sum(s, ["session_id"], "seg_idx", "_dur", "_before", exclusive=True)
    st = (F.col("seg_idx") * F.lit(TURN_GAP_SECONDS) + F.col("_before")).cast("double")
    return s.select("session_id", "seg_idx", "speaker", "text",
                    st.alias("start_s"), (st + F.col("_dur")).alias("end_s"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_from(read_table(spark, sf_dir, "conversations"))


def turns_from(segs: DataFrame) -> DataFrame:
    i = F.col("seg_idx")
    return segs.where(F.col("session_id") % 10 != 9).select(
        "session_id",
        i.alias("turn_idx"),
        "speaker",
        (F.col("start_s") + F.when(i % 3 == 1, 0.625).otherwise(0.0)).alias("start_s"),
        (F.col("end_s") + F.when(i % 4 == 2, 0.875).otherwise(0.0)).alias("end_s"),
    )


def words_from(segs: DataFrame) -> DataFrame:
    s = segs.withColumn("_n", _n_tokens().cast("bigint"))
    s = running_sum(s, ["session_id"], "seg_idx", "_n", "_off", exclusive=True)
    w = s.select("session_id", "_off", "start_s",
                 F.posexplode(F.split("text", " ", -1)).alias("_p", "_w"))
    st = F.col("start_s") + F.col("_p") * F.lit(WORD_SECONDS)
    return w.select(
        "session_id",
        (F.col("_off") + F.col("_p")).cast("bigint").alias("word_idx"),
        F.concat(F.lit(" "), F.col("_w")).alias("text"),
        st.alias("start_s"),
        (st + F.lit(WORD_SECONDS)).alias("end_s"),
    )


def all_fixtures(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    segs = segments(spark, sf_dir)
    return {"segments": segs, "turns": turns_from(segs), "words": words_from(segs)}


# ---------------------------------------------------------------------------
# Fixed values of the per-session settings fixture (FIXTURES.md §1, §E).
TEMPLATE_IDS = ["birp", "cbt-soap", "dap", "informed-consent", "intake",
                "neuropsychoanalytic", "progress", "psychodynamic", "soap",
                "withdrawn"]  # the last one does not exist
LOCAL_BASE = "http://localhost:11434/v1/"
REMOTE_BASE = "https://api.example.com/v1"
# ---------------------------------------------------------------------------


def settings_from(conv: DataFrame) -> DataFrame:
    """Explicit per-session settings; by ``conv_id % 3``: unset, valid,
    empty-or-remote. ``template_id`` picks one shipped template per session, or one that
    does not exist."""
    sid = F.col("conv_id")
    kind = sid % 3
    sessions = conv.select("conv_id").distinct()
    ids = F.array(*[F.lit(t) for t in TEMPLATE_IDS])
    day = F.lpad((sid % 28 + 1).cast("string"), 2, "0")

    def pick(valid, other):
        return F.when(kind == 1, valid).when(kind == 2, other)

    return sessions.select(
        sid.alias("session_id"),
        pick(F.concat(F.lit("Client-"), sid.cast("string")), F.lit("")).alias("client_name"),
        pick(F.concat(F.lit("2024-05-"), day), F.lit("")).alias("session_date"),
        pick(F.lit("Therapist, Client"), F.lit("Dr A,")).alias("speaker_names"),
        pick(F.lit(True), F.lit(False)).alias("redact"),
        pick(F.lit("John, Jane Smith"), F.lit(None).cast("string")).alias("redact_names"),
        pick(F.lit(LOCAL_BASE), F.lit(REMOTE_BASE)).alias("base_url"),
        pick(F.lit(False), (sid % 2 == 0)).alias("allow_remote"),
        pick(F.lit("llama3.1:8b"), F.lit(None).cast("string")).alias("model"),
        F.element_at(ids, (sid % len(TEMPLATE_IDS) + 1).cast("int")).alias("template_id"),
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings_from(read_table(spark, sf_dir, "conversations"))


def config_from(conv: DataFrame) -> DataFrame:
    """A configuration document per session, by ``conv_id % 4``: empty,
    all valid, wrong kinds, a boolean where an integer is expected."""
    sid = F.col("conv_id").cast("string")
    k = F.col("conv_id") % 4
    valid = F.concat(
        F.lit('{"transcribe": {"speakers": "Therapist,Client", "num_speakers": 2, "min_speakers": 1, "max_speakers": 4}, '
              '"summarize": {"client_name": "Cfg-'), sid,
        F.lit('", "session_date": "2024-07-01", "base_url": "http://127.0.0.1:8000/v1", '
              '"model": "cfg-model", "template": "dap", "allow_remote": true}, '
              '"redact": {"enabled": true, "names": "John"}}'))
    wrong = F.lit('{"transcribe": {"num_speakers": "two", "max_speakers": 2.5, "speakers": ["A", "B"]}, '
                  '"summarize": {"client_name": 5, "allow_remote": "yes", "session_date": 20240701}, '
                  '"redact": {"enabled": 0, "names": ["x"]}}')
    boolint = F.lit('{"transcribe": {"num_speakers": true}, '
                    '"summarize": {"allow_remote": false, "model": null}}')
    doc = F.when(k == 1, valid).when(k == 2, wrong).when(k == 3, boolint).otherwise(F.lit("{}"))
    return conv.select("conv_id").distinct().select(F.col("conv_id").alias("session_id"),
                                                    doc.alias("config"))


def expected_from(conv: DataFrame) -> DataFrame:
    """Sessions a batch expects: every conversation (``n_bytes`` = its text
    size), plus, for every 50th one, a companion whose input never arrived."""
    sizes = conv.groupBy("conv_id").agg(F.sum(F.length("text")).cast("bigint").alias("n_bytes"))
    real = sizes.select(F.col("conv_id").alias("session_id"), "n_bytes")
    ghost = sizes.where(F.col("conv_id") % 50 == 0).select(
        (F.col("conv_id") + 1_000_000).alias("session_id"), F.lit(None).cast("bigint").alias("n_bytes"))
    both = real.unionByName(ghost)
    return both.select("session_id",
                       F.concat(F.lit("session-"), F.lpad(F.col("session_id").cast("string"), 7, "0"))
                       .alias("stem"), "n_bytes")
