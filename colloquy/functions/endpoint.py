"""Destination checks and chat payloads.

All are column expressions: the gate and the size flag are computed before
any call, and refused rows never reach the hook (U1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsondoc import single_json

# ---------------------------------------------------------------------------
# Loopback hosts, token estimate, request defaults.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
CHARS_PER_TOKEN = 4
TOKEN_WARNING_THRESHOLD = 6000
DEFAULT_BASE_URL = "http://localhost:11434/v1"
DEFAULT_MODEL = "llama3"
TEMPERATURE = 0.3
COMPLETIONS_PATH = "/chat/completions"
CONTENT_PATH = "$.choices[0].message.content"
# ---------------------------------------------------------------------------

GATE_OK, GATE_REMOTE, GATE_REFUSED = "ok", "remote_allowed", "refused"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host_of(url) -> Column:
    """Lower-cased host without IPv6 brackets; null when not a URL."""
    return F.lower(F.translate(F.try_parse_url(_c(url), F.lit("HOST")), "[]", ""))


def is_local(url) -> Column:
    """Host in the loopback set; unparsable -> false."""
    return F.coalesce(host_of(url).isin(*LOCAL_HOSTS), F.lit(False))


def gate(url, allow_remote) -> Column:
    """``ok`` (local), ``remote_allowed`` or ``refused``."""
    return (F.when(is_local(url), F.lit(GATE_OK))
            .when(F.coalesce(_c(allow_remote), F.lit(False)), F.lit(GATE_REMOTE))
            .otherwise(F.lit(GATE_REFUSED)))


def estimated_tokens(prompt) -> Column:
    """P5: characters // 4 (code points)."""
    return F.floor(F.length(_c(prompt)) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def too_long(prompt) -> Column:
    return estimated_tokens(prompt) > F.lit(TOKEN_WARNING_THRESHOLD)


def completions_url(base_url) -> Column:
    """Base without trailing slashes + ``/chat/completions``."""
    base = F.coalesce(_c(base_url), F.lit(DEFAULT_BASE_URL))
    return F.concat(F.regexp_replace(base, F.lit("/+$"), F.lit("")), F.lit(COMPLETIONS_PATH))


def request_body(prompt, model=None) -> Column:
    """``{"model", "messages": [{"role": "user", "content"}], "temperature"}``;
    null without a prompt."""
    m = F.coalesce(_c(model), F.lit(DEFAULT_MODEL)) if model is not None else F.lit(DEFAULT_MODEL)
    msg = F.struct(F.lit("user").alias("role"), _c(prompt).alias("content"))
    body = F.to_json(F.struct(m.alias("model"), F.array(msg).alias("messages"),
                              F.lit(TEMPERATURE).alias("temperature")))
    return F.when(_c(prompt).isNotNull(), body)


def is_success(status) -> Column:
    """A status from 200 to 299; null is no success."""
    return F.coalesce(_c(status).between(200, 299), F.lit(False))


def response_content(body) -> Column:
    """``choices[0].message.content`` if the body is one JSON document and
    the content a string, else null."""
    found = F.try_variant_get(single_json(_c(body)), CONTENT_PATH, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def response_error(status, body) -> Column:
    """Error text, with the whole body, for any status but a success or an
    unexpected shape; null exactly when there is content."""
    text = F.coalesce(_c(body), F.lit(""))
    return (F.when(~is_success(status), F.concat(F.lit("LLM request failed: "),
                                                 F.coalesce(_c(status).cast("string"), F.lit("no status")),
                                                 F.lit(" "), text))
            .when(response_content(body).isNull(), F.concat(F.lit("Unexpected LLM response format: "), text)))
