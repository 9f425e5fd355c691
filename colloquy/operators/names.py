"""D6 with many names a session.

The rule folds the names over a text in their order, so that an earlier name
may hide a later one. A name that is not in the text changes nothing, and with
thousands of names almost none is; so the fold only runs over names that can be.

Every run of word characters in a name stands in a text, where the name matches,
as a whole word: the name's ends are word boundaries. Replacing names by
``[NAME]`` makes no new words besides NAME. So a name of which any run of word
characters is none of the text's words cannot match at any step. The longest run
decides which names a session gets, all of them which names a text gets. Words
are compared in a form in which all that the pattern calls equal is equal (ASCII
lower case; other letters alike), so no match is lost; names without a word
character, or whose runs are all NAME, are always tried.

Names that many sessions share are given once, as a list, with the sessions that
have the list: no row is made for each session and name of its list, only for
those whose word the session says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import WORD_CLASS
from ..functions.redact import redact_names_dynamic
from ..functions.text import strip
from .scan import BLOCK, block_of

# ---------------------------------------------------------------------------
# The letters beyond ASCII that match an ASCII letter when case
# is ignored, and the word that a replacement leaves.
FOLDED, FOLDED_TO = "Kſİı", "ksii"
TOKEN_WORD = "name"
# ---------------------------------------------------------------------------


def comparable(word: Column) -> Column:
    """Equal for words that match each other when case is ignored."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_replace(F.translate(word, upper + FOLDED, upper.lower() + FOLDED_TO), r"[^\x00-\x7F]", "?")


def words_of(text: Column) -> Column:
    """The distinct words of a text, comparable."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD_CLASS}+)"), F.lit(1))
    return F.array_distinct(F.transform(F.array_distinct(found), comparable))


def _keyed(names: DataFrame) -> DataFrame:
    """``names(..., name)``, stripped, with ``needs``: the words that a text
    must have, longest first, and ``key``: the first of them, null for any."""
    named = names.withColumn("name", strip("name")).where("name <> ''")
    needs = F.filter(words_of(F.col("name")), lambda w: w != TOKEN_WORD)
    by_length = F.transform(F.array_sort(F.transform(needs, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    return named.withColumn("needs", by_length).withColumn("key", F.get("needs", F.lit(0)))


PRESENT = ("session_id", "ord", "name", "key", "needs")


def present_names(rows: DataFrame, names: DataFrame, text: str = "text", shared: DataFrame | None = None,
                  members: DataFrame | None = None) -> DataFrame:
    """(session_id, ord, name, key, needs) of the names that may occur in a text
    of their session; ``shared(list_id, ord, name)`` are names of every session
    that ``members(session_id, list_id)`` says has the list."""
    keyed = _keyed(names).select(*PRESENT)
    said = rows.select("session_id", F.explode(words_of(F.col(text))).alias("key")).distinct()
    own = keyed.where("key is not null").join(said, ["session_id", "key"], "left_semi").select(*PRESENT)
    own = own.union(keyed.where("key is null"))
    if shared is None:
        return own
    listed, has = _keyed(shared).select("list_id", "ord", "name", "key", "needs"), members.distinct()
    found = said.join(has, "session_id").join(listed.where("key is not null"), ["list_id", "key"]).select(*PRESENT)
    always = has.join(listed.where("key is null"), "list_id").select(*PRESENT)
    return own.union(found).union(always)


def redact_many_names(rows: DataFrame, names: DataFrame, order: str = "seg_idx", text: str = "text", block: int = BLOCK,
                      shared: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """D6 on ``rows(session_id, <order>, <text>, ...)`` with ``names(session_id,
    ord, name)`` and those of the session's lists (see ``present_names``): as the
    fold of all names of the session in the order of ``ord``, by way of those
    that occur. Names travel by block of a session, so no row is joined by its
    session alone."""
    lists = present_names(rows, names, text, shared, members).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "name", "needs"))).alias("_names"))
    blocked = rows.withColumn("_nblk", block_of(order, block))
    by_block = blocked.select("session_id", "_nblk").distinct().join(lists, "session_id")
    told = blocked.join(by_block, ["session_id", "_nblk"], "left")
    # a text's words are bound once, not found anew for every name
    own = F.get(F.transform(F.array(words_of(F.col(text))), lambda words: F.filter(
        "_names", lambda n: F.forall(n["needs"], lambda w: F.array_contains(words, w)))), F.lit(0))
    redacted = redact_names_dynamic(F.col(text), F.transform(own, lambda n: n["name"]))
    return told.select(*[F.coalesce(redacted, F.col(text)).alias(c) if c == text else F.col(c) for c in rows.columns])
