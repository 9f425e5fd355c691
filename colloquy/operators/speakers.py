"""Speaker naming (W3 rank by first appearance, J3 name join, F5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_names
from .scan import BLOCK, block_of


def rank_first(rows: DataFrame, at: str) -> DataFrame:
    """``session_id, speaker, rank`` (0-based, by the least ``at``).
    The per-speaker minimum is a partial (map-side) aggregate; the window
    only sees one row per distinct speaker of a session."""
    first = rows.groupBy("session_id", "speaker").agg(F.min(at).alias("_first"))
    w = Window.partitionBy("session_id").orderBy("_first")
    return first.select("session_id", "speaker", (F.row_number().over(w) - 1).alias("rank"))


def speaker_ranks(segs: DataFrame) -> DataFrame:
    return rank_first(segs, "seg_idx")


def labels_in(seen: DataFrame, group: list[str], ranks: DataFrame, names: Column) -> DataFrame:
    """``group`` columns with ``_names``, a map from each speaker of the group
    to its name; ``seen``: the distinct speakers of each group. A group is a
    block of a session, so the map stays small and no long row is joined by
    its session alone."""
    label = F.coalesce(F.get(names, F.col("rank")), F.col("speaker"))
    told = seen.select(*group, "speaker").join(ranks, ["session_id", "speaker"])
    return told.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("speaker", label))).alias("_names"))


def names_array(names: str | Sequence[str] | None) -> Column:
    """F5 for a literal: ``"A, B"`` or ``["A", "B"]`` -> stripped array."""
    if names is None:
        return F.array().cast("array<string>")
    if isinstance(names, str):
        return split_names(F.lit(names))
    return F.array(*[F.lit(n.strip()) for n in names])


def label_speakers(segs: DataFrame, names: str | Sequence[str] | None = None,
                   settings: DataFrame | None = None,
                   names_col: str = "speaker_names", block: int = BLOCK) -> DataFrame:
    """The speaker ranked i gets ``names[i]``; others keep their label.

    ``names`` is one list for every session; alternatively ``settings``
    (``session_id`` + comma-separated ``names_col``) gives one per session.
    """
    ranks = speaker_ranks(segs)
    if settings is not None:
        ranks = ranks.join(settings.select("session_id", split_names(names_col).alias("_given")),
                           "session_id", "left")
        arr = F.col("_given")
    else:
        arr = names_array(names)
    blocked = segs.withColumn("_sblk", block_of("seg_idx", block))
    key = ["session_id", "_sblk"]
    named = labels_in(blocked.where(F.col("speaker").isNotNull()).select(*key, "speaker").distinct(), key, ranks, arr)
    joined = blocked.join(named, key, "left")
    return joined.select(*[F.coalesce(F.try_element_at("_names", F.col("speaker")), F.col("speaker")).alias("speaker")
                           if c == "speaker" else F.col(c) for c in segs.columns])
