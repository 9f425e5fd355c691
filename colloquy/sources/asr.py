"""Model outputs as sources (S4 words, S5 turns).

Speech recognition yields a list of segments, each with a nullable list of
timed words; diarization yields speaker tracks in order. They arrive as one row
per recognised segment / track, or as the models' raw JSON: documents, each of
which is a part of one session,

    {"session_id": 7, "part": 0, "segments": [{"words": [{"word": " hi", "start": 0, "end": 0.25}]}, {"words": null}]}
    {"session_id": 7, "part": 1, "tracks": [{"speaker": "A", "start": 0, "end": 1.5}]}

so no row holds a whole session. Documents are parsed once, into a variant. One
that is not whole is rejected with a reason, and stops no other; fields that are
not known here are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsondoc import bound, single_json
from ..operators.scan import running_sum
from ..operators.settings import json_kind
from ..session import materialize

ASR_WORD = "struct<word:string,start:double,end:double>"


def flatten_words(asr: DataFrame) -> DataFrame:
    """``(session_id, seg_pos, words ARRAY<STRUCT<word,start,end>>)`` ->
    ``words`` table. Segments whose ``words`` is null are skipped;
    ``word_idx`` is dense per session in (segment, word) order, computed
    from per-segment counts (no session-wide sort)."""
    a = asr.withColumn("_n", F.coalesce(F.size("words"), F.lit(0)).cast("bigint"))
    a = a.withColumn("_n", F.greatest("_n", F.lit(0)))  # size(null) may be -1
    a = running_sum(a, ["session_id"], "seg_pos", "_n", "_off", exclusive=True)
    w = a.select("session_id", "_off", F.posexplode("words").alias("_p", "_w"))
    return w.select("session_id", (F.col("_off") + F.col("_p")).cast("bigint").alias("word_idx"),
                    F.col("_w.word").alias("text"), F.col("_w.start").alias("start_s"),
                    F.col("_w.end").alias("end_s"))


def turns_from_tracks(tracks: DataFrame) -> DataFrame:
    """``(session_id, track_pos, speaker, start, end)`` -> ``turns``
    keeping label, times, other columns and track order as ``turn_idx``."""
    others = [c for c in tracks.columns if c not in ("session_id", "track_pos", "speaker", "start", "end")]
    return tracks.select("session_id", F.col("track_pos").cast("bigint").alias("turn_idx"),
                         "speaker", F.col("start").alias("start_s"), F.col("end").alias("end_s"), *others)


# ---------------------------------------------------------------------------
# Reasons why a document is rejected.
BAD_JSON, BAD_KIND, BAD_SESSION, BAD_SEGMENTS, BAD_TRACKS = "bad_json", "unknown_kind", "bad_session", "bad_segments", "bad_tracks"
# ---------------------------------------------------------------------------

VARIANTS = "array<variant>"
TRACK_FIELDS = ("speaker", "start", "end")


def _number(v: Column, path: str) -> Column:
    return json_kind(v, path).isin("int", "float")


def _all(items: Column, fits) -> Column:
    """Do all of the array's items fit? Null for no array."""
    return F.forall(items, lambda x: F.coalesce(fits(x), F.lit(False)))


def _each(items: Column, fits) -> Column:
    """Do all of the array's items fit? False for no array."""
    return F.coalesce(_all(items, fits), F.lit(False))


def parse_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """``docs`` with ``session_id``, ``part``, ``kind`` (words or turns),
    ``reason`` (null if sound) and the parsed ``value``."""
    v = F.col("value")
    word = lambda w: (json_kind(w, "word") == "str") & _number(w, "start") & _number(w, "end")
    # lists are known by their items: to ask for their kind would walk all that is in them
    segment = lambda s: F.coalesce(_all(F.try_variant_get(s, "$.words", VARIANTS), word),
                                   F.coalesce(json_kind(s, "words"), F.lit("null")) == "null")
    track = lambda t: (json_kind(t, "speaker") == "str") & _number(t, "start") & _number(t, "end")
    has = lambda c: F.variant_get(v, f"$.{c}", "variant").isNotNull()
    kind = F.when(has("segments"), "words").when(has("tracks"), "turns")
    reason = (F.when(v.isNull() | F.try_variant_get(v, "$", "map<string,variant>").isNull(), BAD_JSON)
              .when(F.col("kind").isNull(), BAD_KIND)
              .when(~F.coalesce((json_kind(v, "session_id") == "int") & (json_kind(v, "part") == "int"), F.lit(False)), BAD_SESSION)
              .when((F.col("kind") == "words") & ~_each(F.try_variant_get(v, "$.segments", VARIANTS), segment), BAD_SEGMENTS)
              .when((F.col("kind") == "turns") & ~_each(F.try_variant_get(v, "$.tracks", VARIANTS), track), BAD_TRACKS))
    # each step is a generator of one row, which later filters do not repeat
    once = lambda c: F.explode(F.array(c))
    parsed = docs.select("*", once(single_json(doc)).alias("value")).select("*", once(kind).alias("kind"))
    parsed = parsed.select("*", once(reason).alias("reason"))
    sound = F.col("reason").isNull()
    for c in ("session_id", "part"):
        parsed = parsed.withColumn(c, F.when(sound, F.try_variant_get(v, f"$.{c}", "bigint")))
    return parsed


def words_from_documents(parsed: DataFrame) -> DataFrame:
    """The ``words`` table of the sound documents with segments, in the
    order of part, segment and word. The documents' words are written once, as
    numbering them reads them twice."""
    said = F.variant_get("value", "$.segments", f"array<struct<words:array<{ASR_WORD}>>>")
    words = F.flatten(F.transform(said, lambda s: F.coalesce(s["words"], F.array().cast(f"array<{ASR_WORD}>"))))
    sound = parsed.where("reason is null and kind = 'words'").select("session_id", F.col("part").alias("seg_pos"), words.alias("words"))
    return flatten_words(materialize(sound, "words"))


def turns_from_documents(parsed: DataFrame) -> DataFrame:
    """The ``turns`` table of the sound documents with tracks, in track
    order, with ``extra``: a track's other fields as JSON, null if none. The
    documents' tracks are written once, as the words are."""

    def typed(t: Column) -> Column:
        others = F.map_filter(F.try_variant_get(t, "$", "map<string,variant>"), lambda k, _: ~k.isin(*TRACK_FIELDS))
        extra = bound(others, lambda m: F.when(F.size(m) > 0, F.to_json(m)))
        return F.struct(*(F.variant_get(t, f"$.{c}", kind).alias(c) for c, kind in zip(TRACK_FIELDS, ("string", "double", "double"))),
                        extra.alias("extra"))

    tracks = F.transform(F.try_variant_get("value", "$.tracks", VARIANTS), typed)
    sound = parsed.where("reason is null and kind = 'turns'").select("session_id", "part", tracks.alias("tracks"))
    sound = materialize(sound, "tracks").withColumn("_n", F.size("tracks").cast("bigint"))
    sound = running_sum(sound, ["session_id"], "part", "_n", "_off", exclusive=True)
    each = sound.select("session_id", "_off", F.posexplode("tracks").alias("_p", "_t"))
    return turns_from_tracks(each.select("session_id", (F.col("_off") + F.col("_p")).alias("track_pos"), "_t.*"))


def rejected_documents(parsed: DataFrame) -> DataFrame:
    """The documents that no table takes, with their ``reason``."""
    return parsed.where("reason is not null").drop("value", "kind", "session_id", "part")
