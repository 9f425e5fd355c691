"""Strict JSON documents: a text that is one JSON value and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def single_json(text) -> Column:
    """The JSON value of ``text`` as a variant; null when the text is null, not
    JSON, or holds anything besides that one value. The parser stops after the
    first value, so the text is put into an array in front of a mark of its own
    hash: only one whole value leaves exactly the value and the mark."""
    t = F.col(text) if isinstance(text, str) else text
    mark = F.concat(F.lit("#"), F.xxhash64(t).cast("string"))
    pair = F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"'), mark, F.lit('"]')))

    def value(p: Column) -> Column:
        whole = (F.try_variant_get(p, "$[1]", "string") == mark) & F.try_variant_get(p, "$[2]", "variant").isNull()
        return F.when(whole, F.try_variant_get(p, "$[0]", "variant"))

    return bound(pair, value)
