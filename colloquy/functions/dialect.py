"""Regex dialect, decided once.

Patterns in this package are written in Python's ``re`` syntax (the
behaviour we must reproduce) and translated here into:

* Java regex for Spark (``to_java``): exact. ``\\w``, ``\\d``, ``\\s`` become
  explicit Unicode classes that equal Python's, and ``\\b`` becomes a
  lookaround pair over the same word class.
* RE2 for the DuckDB oracle (``to_re2``): classes as above, but RE2 has no
  lookaround, so ``\\b`` stays RE2's ASCII word boundary. Only text where a
  non-ASCII letter touches a match edge can differ; the oracle check on the
  driver tables shows whether it occurs.

The translation is a token walk over escapes; it knows nothing beyond the
four class escapes and character-class brackets.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Python's character classes for ``str`` patterns.
# WHITESPACE_RANGES are the code points for which str.isspace() holds (equal
# to what Python's ``\s`` matches and what str.strip() removes); WORD is
# Python's ``\w``; DIGIT is Python's ``\d``.
WHITESPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x1F), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0),
    (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
    (0x205F, 0x205F), (0x3000, 0x3000),
]
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
# ---------------------------------------------------------------------------

WHITESPACE = "".join(
    "\\x{%X}" % a if a == b else "\\x{%X}-\\x{%X}" % (a, b)
    for a, b in WHITESPACE_RANGES
)
WHITESPACE_CHARS = "".join(
    chr(c) for a, b in WHITESPACE_RANGES for c in range(a, b + 1)
)
WORD_CLASS = "[" + WORD + "]"
WS_CLASS = "[" + WHITESPACE + "]"
# Python's \b: a word character on exactly one side.
JAVA_BOUNDARY = "(?:(?<={w})(?!{w})|(?<!{w})(?={w}))".format(w=WORD_CLASS)


def _translate(pattern: str, boundary: str) -> str:
    out = []
    in_class = False
    i = 0
    n = len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            e = pattern[i + 1]
            if e == "w":
                out.append(WORD if in_class else WORD_CLASS)
            elif e == "d":
                out.append(DIGIT)
            elif e == "s":
                out.append(WHITESPACE if in_class else WS_CLASS)
            elif e == "b" and not in_class:
                out.append(boundary)
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            # a leading ']' or '^]' is literal inside a class
            if pattern.startswith("^", i + 1):
                out.append("^")
                i += 1
            if pattern.startswith("]", i + 1):
                out.append("\\]")
                i += 1
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def to_java(pattern: str) -> str:
    """Python ``re`` pattern (str semantics) -> equivalent Java regex."""
    return _translate(pattern, JAVA_BOUNDARY)


def to_re2(pattern: str) -> str:
    """Python ``re`` pattern -> RE2 (DuckDB) regex; ``\\b`` stays ASCII."""
    return _translate(pattern, r"\b")


def java_quote(literal: str) -> str:
    """Quote a literal for Java regex (``\\Q..\\E`` safe against ``\\E``)."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def sql_string(s: str) -> str:
    """ANSI SQL string literal (DuckDB: no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"
