"""Note prompts: values (G1), rendering (G2/G3), template fan-out (J4),
session metadata (J5), gate and size (P4/P5/A7), requests and responses
(G4/G5) and the completion hook (U1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import endpoint as ep
from ..functions.template import DEFAULT_CLIENT, substitute
from ..functions.text import duration_text
from .scan import block_of, join_sorted
from .transcript import EMPTY_DURATION, LINE_SEP, format_line


# Fixed value: reason of a request for an unknown template.
NO_TEMPLATE = "template not found"


def session_values(segs: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Per session in one two-level aggregation: timestamped ``transcript``
    (F3), ``speakers`` (A4), ``duration`` (A3), ``n_segments`` (A5).
    Level one groups ``(session_id, block of seg_idx)``, so a very long
    session is spread over many tasks; level two combines block pieces."""
    lines = segs.select("session_id", "seg_idx", "speaker", "start_s", "end_s",
                        format_line(True).alias("_line"), block_of("seg_idx").alias("_blk"))
    part = lines.groupBy("session_id", "_blk").agg(
        join_sorted(F.collect_list(F.struct(F.col("seg_idx").alias("k"), F.col("_line").alias("v"))),
                     LINE_SEP).alias("_piece"),
        F.collect_set("speaker").alias("_spk"),
        F.min("start_s").alias("_min"), F.max("end_s").alias("_max"),
        F.count(F.lit(1)).alias("_n"),
    )
    vals = part.groupBy("session_id").agg(
        join_sorted(F.collect_list(F.struct(F.col("_blk").alias("k"), F.col("_piece").alias("v"))),
                     LINE_SEP).alias("transcript"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_spk")))), ", ").alias("speakers"),
        duration_text(F.max("_max") - F.min("_min")).alias("duration"),
        F.sum("_n").alias("n_segments"),
    )
    if sessions is not None:
        vals = sessions.select("session_id").join(vals, "session_id", "left").select(
            "session_id",
            F.coalesce("transcript", F.lit("")).alias("transcript"),
            F.coalesce("speakers", F.lit("")).alias("speakers"),
            F.coalesce("duration", F.lit(EMPTY_DURATION)).alias("duration"),
            F.coalesce("n_segments", F.lit(0)).alias("n_segments"))
    return vals


def _given(c: str) -> Column:
    # empty string counts as not given
    return F.when(F.col(c) != "", F.col(c))


def render_prompts(values: DataFrame, templates: DataFrame, requests: DataFrame,
                   default_date: str | None = None) -> DataFrame:
    """G3 for every ``(session_id, template_id)`` request row.

    ``requests`` may carry ``client_name`` and ``session_date`` (J5). No
    request vanishes: a session without segments has an empty transcript and
    duration ``0:00``; a template that does not exist leaves ``prompt`` null
    and says so in ``error``. How the template table is joined (J4) is left to
    Spark, which knows its size in bytes."""
    req = requests
    for c in ("client_name", "session_date"):
        if c not in req.columns:
            req = req.withColumn(c, F.lit(None).cast("string"))
    today = (F.lit(default_date) if default_date
             else F.date_format(F.current_date(), "yyyy-MM-dd"))
    rows = (req.join(values, "session_id", "left")
            .join(templates.select("template_id", "body"), "template_id", "left"))
    vals = {
        "transcript": F.coalesce("transcript", F.lit("")),
        "speakers": F.coalesce("speakers", F.lit("")),
        "date": F.coalesce(_given("session_date"), today),
        "duration": F.coalesce("duration", F.lit(EMPTY_DURATION)),
        "client_name": F.coalesce(_given("client_name"), F.lit(DEFAULT_CLIENT)),
    }
    return rows.select("session_id", "template_id", substitute("body", vals).alias("prompt"),
                       F.when(F.col("body").isNull(), F.lit(NO_TEMPLATE)).alias("error"))


def gate_requests(prompts: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """P4 + P5 + G4: ``gate``, token estimate and flag, URL and JSON body.
    ``targets`` (by ``session_id``) may carry ``base_url``, ``model`` and
    ``allow_remote``."""
    p = prompts
    if targets is not None:
        p = p.join(targets.select("session_id", "base_url", "model", "allow_remote"), "session_id", "left")
    for c, typ in (("base_url", "string"), ("model", "string"), ("allow_remote", "boolean")):
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast(typ))
    base = F.coalesce(_given("base_url"), F.lit(ep.DEFAULT_BASE_URL))
    return p.select(
        "session_id", "template_id",
        ep.gate(base, "allow_remote").alias("gate"),
        ep.estimated_tokens("prompt").alias("est_tokens"),
        ep.too_long("prompt").alias("too_long"),
        ep.completions_url(base).alias("url"),
        ep.request_body("prompt", F.coalesce(_given("model"), F.lit(ep.DEFAULT_MODEL))).alias("request"),
        F.col("error") if "error" in prompts.columns else F.lit(None).cast("string").alias("error"),
    )


def prompt_budget(prompts: DataFrame) -> DataFrame:
    """Per template, prompts, prompts over the limit, largest estimate."""
    est = ep.estimated_tokens("prompt")
    return prompts.where(F.col("prompt").isNotNull()).groupBy("template_id").agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.count_if(est > F.lit(ep.TOKEN_WARNING_THRESHOLD)).alias("n_too_long"),
        F.max(est).alias("max_tokens"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Every response has either ``content`` or ``error``."""
    return responses.select(
        *[c for c in responses.columns if c not in ("status", "body")],
        F.when(ep.is_success("status"), ep.response_content("body")).alias("content"),
        ep.response_error("status", "body").alias("error"),
    )


def sendable(requests: DataFrame) -> DataFrame:
    """The requests that the gate lets through."""
    return requests.where((F.col("gate") != ep.GATE_REFUSED) & F.col("request").isNotNull())


CLIENT_ERROR = 599  # status of a request whose client failed
KEYS = ("session_id", "template_id")


def call_endpoint(requests: DataFrame, make_client: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                  keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Send already gated requests through a user-supplied client.

    ``make_client()`` runs once per partition (models / connections are
    loaded once, not per row); the returned callable maps a pandas batch with
    the ``keys``, ``url, request`` to ``status, body`` and keeps its own time limit. Refused
    rows and rows without a request are dropped before the hook. If a batch
    fails, its rows are sent one by one, so only those that fail themselves
    become error rows; a client that can't be made fails its rows, not the job.
    """
    ready = sendable(requests).select(*keys, "url", "request")
    kept = list(keys)
    schema = T.StructType([*ready.select(*keys).schema.fields, T.StructField("status", T.IntegerType()), T.StructField("body", T.StringType())])

    def answer(client: Callable, pdf: pd.DataFrame) -> pd.DataFrame:
        out = client(pdf)
        if len(out) != len(pdf):
            raise ValueError(f"{len(out)} answers to {len(pdf)} requests")
        return pdf[kept].reset_index(drop=True).assign(status=out["status"].astype("Int32").values, body=out["body"].values)

    def failed(pdf: pd.DataFrame, e: Exception) -> pd.DataFrame:
        return pdf[kept].assign(
            status=CLIENT_ERROR, body=f"client error: {type(e).__name__}: {e}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, broken = None, None
        try:
            client = make_client()
        except Exception as e:  # noqa: BLE001 - the rows carry the error
            broken = e
        for pdf in batches:
            if broken is not None:
                yield failed(pdf, broken)
                continue
            try:
                yield answer(client, pdf)
                continue
            except Exception:  # noqa: BLE001 - find the rows that fail
                pass
            for i in range(len(pdf)):
                row = pdf.iloc[i:i + 1]
                try:
                    one = answer(client, row)
                except Exception as e:  # noqa: BLE001
                    one = failed(row, e)
                yield one

    return ready.mapInPandas(run, schema)
