"""Scalar text helpers (Column -> Column), all JVM-side built-ins.

F1 clock format, F4 clock parse, F5 name-list split, F6 strip, F7 file stem,
A3 duration text.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import WHITESPACE_CHARS


#: decimal digits of all scripts in the basic plane and their ASCII digits
DIGITS = "".join(c for c in map(chr, range(128, 0xFFFF)) if unicodedata.category(c) == "Nd")
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove every Unicode whitespace code point at
    both ends (Spark's plain ``trim`` removes spaces only)."""
    return F.btrim(_c(c), F.lit(WHITESPACE_CHARS))


def _floor_div_mod(t: Column, d: int) -> tuple[Column, Column]:
    # Python divmod on ints: floor quotient, non-negative remainder for d > 0
    r = F.pmod(t, F.lit(d))
    return (t - r) / F.lit(d), r


def clock(seconds) -> Column:
    """F1 ``MM:SS`` of truncated seconds; minutes unbounded (3661 -> 61:01)."""
    t = _c(seconds).cast("bigint")
    m, s = _floor_div_mod(t, 60)
    return F.format_string("%02d:%02d", m.cast("bigint"), s)


def duration_text(seconds) -> Column:
    """A3 ``m:ss`` (minutes unpadded) of truncated seconds."""
    t = _c(seconds).cast("bigint")
    m, s = _floor_div_mod(t, 60)
    return F.format_string("%d:%02d", m.cast("bigint"), s)


def parse_clock(ts) -> Column:
    """F4 ``M:SS`` -> seconds as double; null when not exactly two integer
    parts. Decimal digits of any script count, and numbers beyond 64 bits."""
    parts = F.split(F.translate(_c(ts), DIGITS, ASCII_DIGITS), ":")

    def number(x: Column) -> Column:
        return F.coalesce(x.try_cast("bigint").cast("double"),
                          F.when(x.rlike("^[0-9]+$"), x.try_cast("double")))

    return F.when(F.size(parts) == 2, number(parts.getItem(0)) * 60 + number(F.get(parts, 1)))


def split_names(names) -> Column:
    """F5 comma split, each item stripped; empty items kept."""
    return F.transform(F.split(_c(names), ","), lambda x: strip(x))


def file_stem(name) -> Column:
    """F7 ``Path.stem``: file name without its last suffix."""
    return F.regexp_extract(_c(name), r"^(.+?)(\.[^.]*)?$", 1)
