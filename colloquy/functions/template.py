"""Single-pass ``$name`` / ``${name}`` substitution as one expression.

The body is cut into tokens (escaped dollar, braced name, bare name, plain
text, stray dollar); each name token is looked up once and replaced by its
value, everything else is kept. Values are never re-scanned, so a ``$`` in a
transcript stays as it is. Unknown names and malformed placeholders are left
untouched; ``$$`` becomes ``$``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Placeholder token grammar and the placeholder names.
TOKEN = r"\$\$|\$\{[_A-Za-z][_A-Za-z0-9]*\}|\$[_A-Za-z][_A-Za-z0-9]*|[^$]+|\$"
PLACEHOLDERS = ("transcript", "speakers", "date", "duration", "client_name")
DEFAULT_CLIENT = "Client"
# ---------------------------------------------------------------------------


def _name_of(t: Column) -> Column:
    braced = F.substring(t, F.lit(3), F.length(t) - 3)
    bare = F.substring(t, F.lit(2), F.length(t) - 1)
    return F.when(F.startswith(t, F.lit("${")), braced).otherwise(bare)


def substitute(body, values: Mapping[str, Column]) -> Column:
    """``Template(body).safe_substitute(values)`` for Column values."""
    b = F.col(body) if isinstance(body, str) else body
    tokens = F.regexp_extract_all(b, F.lit(TOKEN), F.lit(0))

    def one(t: Column) -> Column:
        name = _name_of(t)
        looked = None
        for k, v in values.items():
            looked = (F.when(name == F.lit(k), v) if looked is None
                      else looked.when(name == F.lit(k), v))
        is_name = F.startswith(t, F.lit("$")) & (F.length(t) > 1) & (t != F.lit("$$"))
        out = F.when(t == F.lit("$$"), F.lit("$"))
        if looked is not None:
            out = out.when(is_name, F.coalesce(looked.otherwise(F.lit(None)), t))
        return out.otherwise(t)

    return F.array_join(F.transform(tokens, one), "")
