"""Per-session settings from explicit values, a configuration document
and defaults.

Precedence per key: an explicit value (even an empty string) wins; else the
configuration value if its JSON kind fits the expected type; else null (the
consumer's default applies). A configured value of the wrong kind is ignored
and reported. Booleans only switch on: explicit OR a truthy configured value.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Output column -> (configuration path, expected kind).
STRING_KEYS = {
    "speaker_names": ("transcribe.speakers", "str"),
    "client_name": ("summarize.client_name", "str"),
    "session_date": ("summarize.session_date", "str"),
    "base_url": ("summarize.base_url", "str"),
    "model": ("summarize.model", "str"),
    "template_id": ("summarize.template", "str"),
}
INT_KEYS = {
    "num_speakers": ("transcribe.num_speakers", "int"),
    "min_speakers": ("transcribe.min_speakers", "int"),
    "max_speakers": ("transcribe.max_speakers", "int"),
}
BOOL_KEYS = {"allow_remote": "summarize.allow_remote", "redact": "redact.enabled"}
NAMES_KEY = ("redact_names", "redact.names")
# type of a variant, up to its first bracket -> kind
KINDS = {"STRING": "str", "BIGINT": "int", "BOOLEAN": "bool", "DECIMAL": "float", "DOUBLE": "float", "ARRAY": "list",
         "OBJECT": "dict", "VOID": "null"}
# ---------------------------------------------------------------------------


def json_kind(doc: Column, path: str) -> Column:
    """Kind of the value at ``path``: str, int, float, bool, list, dict,
    null; SQL NULL when the key is absent or the document is not JSON. The
    value is looked at once; of a list or an object that is all of it."""
    t = F.schema_of_variant(F.variant_get(doc, "$." + path, "variant"))
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*KINDS.items())]), F.regexp_extract(t, "^[A-Z]+", 0))


def truthy(doc: Column, path: str) -> Column:
    """Python truthiness of the configured value (absent -> false)."""
    p = "$." + path
    k = json_kind(doc, path)
    return F.coalesce(
        F.when(k == "bool", F.variant_get(doc, p, "boolean"))
        .when(k.isin("int", "float"), F.variant_get(doc, p, "double") != 0)
        .when(k == "str", F.variant_get(doc, p, "string") != "")
        .when(k == "list", F.size(F.variant_get(doc, p, "array<variant>")) > 0)
        .when(k == "dict", F.schema_of_variant(F.variant_get(doc, p, "variant")) != "OBJECT<>")
        .when(k == "null", F.lit(False)),
        F.lit(False))


def resolve_settings(explicit: DataFrame, config: DataFrame) -> DataFrame:
    """``explicit``: ``session_id`` + typed columns (null = not given);
    ``config``: ``session_id, config`` (JSON text). Returns one row per
    session of ``explicit`` with resolved values and ``ignored`` (sorted,
    comma-joined configuration keys of the wrong kind)."""
    j = explicit.join(config.select("session_id", F.try_parse_json("config").alias("_doc")),
                      "session_id", "left")
    doc = F.col("_doc")
    out = [F.col("session_id")]
    ignored = []

    def given(c: str) -> Column:
        return F.col(c) if c in explicit.columns else F.lit(None)

    for col, (path, kind) in {**STRING_KEYS, **INT_KEYS}.items():
        k = json_kind(doc, path)
        typ = "string" if kind == "str" else "bigint"
        cfg = F.when(k == kind, F.variant_get(doc, "$." + path, typ))
        out.append(F.coalesce(given(col).cast(typ), cfg).alias(col))
        ignored.append(F.when(given(col).isNull() & k.isNotNull() & (k != kind), F.lit(path)))
    for col, path in BOOL_KEYS.items():
        out.append((F.coalesce(given(col).cast("boolean"), F.lit(False)) | truthy(doc, path)).alias(col))
    col, path = NAMES_KEY
    k = json_kind(doc, path)
    use = given(col).isNull() & truthy(doc, path)
    out.append(F.coalesce(given(col).cast("string"),
                          F.when(use & (k == "str"), F.variant_get(doc, "$." + path, "string"))).alias(col))
    ignored.append(F.when(use & (k != "str"), F.lit(path)))
    out.append(F.array_join(F.array_sort(F.filter(F.array(*ignored), lambda x: x.isNotNull())), ",")
               .alias("ignored"))
    return j.select(*out)
