"""Word-to-speaker alignment.

Rules reproduced:

* a word goes to the turn with the largest positive overlap
  ``min(ends) - max(starts)``; ties go to the earlier turn in list order;
* with no positive overlap, to the first turn (list order) whose closed
  interval holds the word's midpoint; else ``Unknown``;
* a session with no turns at all puts every word under ``Speaker``;
* consecutive words of one speaker (list order) form one segment: text is
  the plain concatenation, stripped; start of its first word, end of its
  last word.

Plan shape (one hot session must not land in one task):

1. Words and turns meet in time bins of five widths, each 32 times the one
   before. An interval has the narrowest width at which it spans no more than
   ``FAN`` bins, so a turn of hours makes no more rows than one of seconds.
   Both sides are keyed by (session, whose width, width, bin): a word looks up
   the widths that turns have, and a turn, should a word be longer than itself,
   the wider ones. A pair that overlaps, or whose word midpoint lies in the turn,
   always shares a key; the arg-max is idempotent, so a pair that shares several
   needs no dedupe. This bounds the candidate pairs by local time, instead of
   all words x all turns of a session.
2. Attributed words are hash-partitioned once by ``(session_id, block)``
   (block = ``word_idx`` div BLOCK). The previous-word test and the local
   run counter are windows inside one block, and the words of a local run
   become one piece there, with no new shuffle.
3. The pieces are written once. One summary row per block, read from their
   narrow columns, carries the boundary test, the run offset (a window over
   blocks), the no-turns flag and the block's speaker names; it joins the pieces
   by ``(session_id, block)``, so no word, piece or segment is ever joined or
   sorted by its session alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import materialize
from .scan import BLOCK, block_of
from .speakers import labels_in, names_array, rank_first

# ---------------------------------------------------------------------------
# Labels used when no turn fits / no turns exist at all.
UNKNOWN = "Unknown"
NO_TURNS = "Speaker"
# ---------------------------------------------------------------------------

# narrowest time bin (power of two: exact floor), ratio of the widths, and bins of an interval
BIN_SECONDS = 32.0
RATIO, FAN, N_WIDTHS = 32, 32, 5


# times outside of +-MAX_SECONDS (about 115 days) are no times of a recording
MAX_SECONDS = 1e7


def time_fault(start: str = "start_s", end: str = "end_s") -> Column:
    """Why a pair of times can't be placed, else null."""
    s, e = F.col(start), F.col(end)
    far = lambda t: F.isnan(t) | (F.abs(t) > F.lit(MAX_SECONDS))
    return (F.when(s.isNull() | e.isNull(), F.lit("missing time"))
            .when(far(s) | far(e), F.lit("implausible time")))


def rejected_times(rows: DataFrame) -> DataFrame:
    """The words or turns that alignment leaves out, with a ``reason``; the
    others are those it takes, so no row is in neither table."""
    return rows.withColumn("reason", time_fault()).where(F.col("reason").isNotNull())


def _widths(bin_seconds: float) -> list[float]:
    return [bin_seconds * RATIO**i for i in range(N_WIDTHS)]


def _bin(t: Column, width: Column) -> Column:
    return F.floor(t / width)


def _level(a: Column, b: Column, bin_seconds: float) -> Column:
    """The narrowest width at which an interval spans ``FAN`` bins at most."""
    out = F.lit(N_WIDTHS - 1)
    for i, w in reversed(list(enumerate(_widths(bin_seconds)[:-1]))):
        out = F.when(_bin(F.greatest(a, b), F.lit(w)) - _bin(F.least(a, b), F.lit(w)) < FAN, F.lit(i)).otherwise(out)
    return out


def _keys(a: Column, b: Column, wanted: Column, bin_seconds: float) -> Column:
    """Bins of an interval at the levels of ``wanted``, structs (whose, level):
    structs (whose, level, bin)."""
    width = F.array(*[F.lit(w) for w in _widths(bin_seconds)])

    def at(k: Column) -> Column:
        w = F.get(width, k["level"])
        return F.transform(F.sequence(_bin(F.least(a, b), w), _bin(F.greatest(a, b), w)),
                           lambda x: F.struct(k["whose"].alias("whose"), k["level"].alias("level"), x.alias("bin")))

    return F.flatten(F.transform(wanted, at))


def attribute_words(words: DataFrame, turns: DataFrame,
                    bin_seconds: float = BIN_SECONDS, block: int = BLOCK) -> DataFrame:
    """Every word with its best turn's speaker in ``_spk`` (null when
    no turn qualifies) and its ``_blk``; rows of ``rejected_times`` take no
    part, so one faulty session stops no other; clustered by ``(session_id, _blk)``.
    A small job of its own collects the widths that turns have (five at most).
    """
    ws, we = F.col("start_s"), F.col("end_s")
    words, turns = (d.where(time_fault().isNull()) for d in (words, turns))
    turns = turns.where(F.col("end_s") >= F.col("start_s"))  # others never qualify
    used = sorted(r[0] for r in turns.select(_level(ws, we, bin_seconds).alias("l")).distinct().collect()) or [0]
    key = lambda whose, level: F.struct(F.lit(whose).alias("whose"), level.alias("level"))
    own = _level(ws, we, bin_seconds)
    of_turns = F.filter(F.array(*[key("turn", F.lit(i)) for i in used]), lambda k: k["level"] >= F.col("_lvl"))
    of_words = F.transform(F.sequence(F.col("_lvl") + 1, F.lit(N_WIDTHS)), lambda i: key("word", i))
    wb = words.withColumn("_lvl", own)
    # a word is looked up at its own width only by shorter turns
    wb = wb.select("session_id", "word_idx", "text", "start_s", "end_s", F.explode(_keys(
        ws, we, F.when(F.col("_lvl") > used[0], F.concat(of_turns, F.array(key("word", F.col("_lvl"))))).otherwise(of_turns),
        bin_seconds)).alias("_k")).select("*", "_k.*").drop("_k")
    ts, te = F.col("_ts"), F.col("_te")
    tb = turns.withColumn("_lvl", own).select(
        "session_id", F.col("turn_idx").alias("_tidx"), F.col("speaker").alias("_tspk"),
        F.col("start_s").alias("_ts"), F.col("end_s").alias("_te"),
        F.explode(_keys(ws, we, F.filter(F.concat(F.array(key("turn", F.col("_lvl"))), of_words), lambda k: k["level"] < N_WIDTHS),
                        bin_seconds)).alias("_k")).select("*", "_k.*").drop("_k")
    ov = F.least(we, te) - F.greatest(ws, ts)
    mid = (ws + we) / 2
    cond = ((ov > 0) | ((ts <= mid) & (mid <= te)))
    for c in ("session_id", "whose", "level", "bin"):
        cond &= wb[c] == tb[c]
    pairs = wb.join(tb, cond, "left").select(
        wb["session_id"], "word_idx", "text", "start_s", "end_s", "_tspk",
        F.when(F.col("_tidx").isNotNull(),
               F.struct(-F.greatest(ov, F.lit(0.0)), F.col("_tidx"))).alias("_rank"),
    )
    return (pairs.withColumn("_blk", block_of("word_idx", block))
            .repartition("session_id", "_blk")
            .groupBy("session_id", "_blk", "word_idx")
            .agg(F.any_value("text").alias("text"),
                 F.any_value("start_s").alias("start_s"),
                 F.any_value("end_s").alias("end_s"),
                 F.min_by("_tspk", "_rank").alias("_spk")))


def _turn_sessions(turns: DataFrame) -> DataFrame:
    return turns.select("session_id").distinct().withColumn("_has_turns", F.lit(True))


def _speaker() -> Column:
    """J2 on top of J1: sessions without turns have one label of their own."""
    return F.when(F.col("_has_turns").isNull(), F.lit(NO_TURNS)).otherwise(F.coalesce("_spk", F.lit(UNKNOWN)))


def assign_speakers(words: DataFrame, turns: DataFrame,
                    bin_seconds: float = BIN_SECONDS, block: int = BLOCK) -> DataFrame:
    """J1 + J2 per word: ``session_id, word_idx, speaker``. The no-turns flag
    is joined by session on one row per block, then to the words by block."""
    att = attribute_words(words, turns, bin_seconds, block)
    flags = (words.select("session_id", block_of("word_idx", block).alias("_blk")).distinct()
             .join(_turn_sessions(turns), "session_id", "left"))
    return att.join(flags, ["session_id", "_blk"]).select("session_id", "word_idx", _speaker().alias("speaker"))


def run_pieces(att: DataFrame) -> DataFrame:
    """W1/W2 inside each block of attributed words clustered by ``(session_id,
    _blk)``: consecutive words of one speaker as one piece, numbered from 0 in
    ``_lrun``."""
    att = att.withColumn("_spk", F.coalesce("_spk", F.lit(UNKNOWN)))
    w = Window.partitionBy("session_id", "_blk").orderBy("word_idx")
    prev, first = F.lag("_spk").over(w), F.row_number().over(w) == 1
    att = att.withColumn("_chg", F.when(first | prev.eqNullSafe(F.col("_spk")), 0).otherwise(1))
    att = att.withColumn("_lrun", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (att.groupBy("session_id", "_blk", "_lrun")
            .agg(F.any_value("_spk").alias("_spk"),
                 F.array_join(F.transform(
                     F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), "").alias("_txt"),
                 F.min_by("start_s", "word_idx").alias("_start"),
                 F.max_by("end_s", "word_idx").alias("_end")))


def block_runs(pieces: DataFrame, turns: DataFrame, names: Column | None = None) -> DataFrame:
    """One row per block of ``pieces``: ``_before`` is the number of the run
    that the block's first piece belongs to, ``_names`` the block's speakers and
    their names (W3/J3: the i-th speaker to appear in a session has ``names[i]``)."""
    narrow = pieces.select("session_id", "_blk", "_lrun", "_spk")
    blocks = (narrow.groupBy("session_id", "_blk")
              .agg(F.min_by(F.struct("_spk"), "_lrun").alias("_first"),
                   F.max_by(F.struct("_spk"), "_lrun").alias("_last"),
                   F.max("_lrun").alias("_nchg"))
              .join(_turn_sessions(turns), "session_id", "left"))
    wb = Window.partitionBy("session_id").orderBy("_blk")
    prev = F.lag("_last").over(wb)
    blocks = blocks.withColumn("_bchg", F.when(prev.isNotNull() & prev.eqNullSafe(F.col("_first")), 0).otherwise(1))
    blocks = blocks.withColumn("_before", F.sum(F.col("_bchg") + F.col("_nchg")).over(
        wb.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_nchg") - 1)
    blocks = blocks.select("session_id", "_blk", "_before", "_has_turns")
    if names is None:
        return blocks
    seen = narrow.groupBy("session_id", "_blk", "_spk").agg(F.min("_lrun").alias("_lrun"))
    seen = seen.join(blocks, ["session_id", "_blk"]).select(
        "session_id", "_blk", _speaker().alias("speaker"), F.struct("_blk", "_lrun").alias("_at"))
    named = labels_in(seen, ["session_id", "_blk"], rank_first(seen, "_at"), names)
    return blocks.join(named, ["session_id", "_blk"])


def merge_runs(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """A1: pieces -> segments ``session_id, seg_idx, speaker, text, start_s, end_s``."""
    told = pieces.join(blocks, ["session_id", "_blk"])
    speaker = _speaker()
    if "_names" in blocks.columns:
        speaker = F.try_element_at("_names", speaker)
    segs = (told.groupBy("session_id", (F.col("_before") + F.col("_lrun")).cast("bigint").alias("seg_idx"))
            .agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("_blk", "_txt"))), lambda x: x["_txt"]), "").alias("_text"),
                F.min_by("_start", "_blk").alias("start_s"),
                F.max_by("_end", "_blk").alias("end_s"),
                F.any_value(speaker).alias("speaker")))
    return segs.select("session_id", "seg_idx", "speaker", strip("_text").alias("text"), "start_s", "end_s")


def align(words: DataFrame, turns: DataFrame, bin_seconds: float = BIN_SECONDS,
          block: int = BLOCK, names: str | list[str] | None = None) -> DataFrame:
    """A2: words x turns -> segments for all sessions at once (a session
    with no words yields no segments); with ``names`` their speakers are
    named by first appearance (W3/J3) on the way, so that the segments are
    computed once."""
    pieces = materialize(run_pieces(attribute_words(words, turns, bin_seconds, block)), "pieces")
    return merge_runs(pieces, block_runs(pieces, turns, None if names is None else names_array(names)))
