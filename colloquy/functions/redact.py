"""D1-D6 redaction as one narrow projection of built-in ``regexp_replace``.

The rules run in order over the already rewritten text, then each name in
the order given. Names are never merged into one alternation: a later name
may hit text produced by an earlier one, exactly as sequential replacement
does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import JAVA_BOUNDARY, java_quote, to_java, to_re2
from .text import strip

# ---------------------------------------------------------------------------
# The redaction rules (Python ``re`` syntax), their tokens and
# flags, in the order they are applied.
PHONE = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
DATE = r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b"
ADDRESS = (
    r"\b\d{1,5}\s+[\w\s]{1,30}"
    r"(?:street|st|avenue|ave|boulevard|blvd|drive|dr|lane|ln"
    r"|road|rd|court|ct|place|pl|way|circle|cir)\b"
)
RULES = [
    (PHONE, "[PHONE]", False),
    (SSN, "[SSN]", False),
    (EMAIL, "[EMAIL]", False),
    (DATE, "[DATE]", False),
    (ADDRESS, "[ADDRESS]", True),  # ignore case
]
NAME_TOKEN = "[NAME]"
# Every rule above needs a digit or an '@' somewhere in the text.
NEEDS = r"[\d@]"
# ---------------------------------------------------------------------------


def java_rules() -> list[tuple[str, str]]:
    return [(("(?iu)" if ic else "") + to_java(p), tok) for p, tok, ic in RULES]


def re2_rules() -> list[tuple[str, str]]:
    return [(("(?i)" if ic else "") + to_re2(p), tok) for p, tok, ic in RULES]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def redact_patterns(text) -> Column:
    """D1-D5 in order; rows without a digit or '@' skip the chain."""
    t = _c(text)
    out = t
    for pat, tok in java_rules():
        out = F.regexp_replace(out, F.lit(pat), F.lit(tok))
    return F.when(t.rlike(to_java(NEEDS)), out).otherwise(t)


def name_pattern_java(name: str) -> str:
    return "(?iu)" + JAVA_BOUNDARY + java_quote(name) + JAVA_BOUNDARY


def redact_names(text, names: Sequence[str] | None) -> Column:
    """D6 with a literal name list (stripped, empties skipped)."""
    out = _c(text)
    for n in names or []:
        n = n.strip()
        if n:
            out = F.regexp_replace(out, F.lit(name_pattern_java(n)), F.lit(NAME_TOKEN))
    return out


def redact_names_dynamic(text, names) -> Column:
    """D6 with a per-row ``ARRAY<STRING>`` of names (e.g. per session)."""
    prefix = F.lit("(?iu)" + JAVA_BOUNDARY + "\\Q")
    suffix = F.lit("\\E" + JAVA_BOUNDARY)

    def step(acc, n):
        quoted = F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        return F.regexp_replace(acc, F.concat(prefix, quoted, suffix), F.lit(NAME_TOKEN))

    cleaned = F.filter(F.transform(_c(names), lambda x: strip(x)), lambda x: x != "")
    return F.aggregate(F.coalesce(cleaned, F.array().cast("array<string>")), _c(text), step)


def redact_text(text, names: Sequence[str] | None = None) -> Column:
    """``redact_text``: D1-D5 then D6 with a literal list."""
    return redact_names(redact_patterns(text), names)
