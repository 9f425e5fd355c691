"""Completion calls that can be stopped and resumed.

Requests are dealt to batches by their content. The answers of a batch are
committed to a table before the next batch is sent, and requests whose answer is
there are not sent again, in this run or a later one: a run stopped between
batches repeats nothing, a run stopped inside a batch repeats that batch at
most. The requests are computed once and written by batch, so a batch reads its
own rows alone, however many batches there are. Tasks keep a rate of their own and try again, waiting longer each time,
where the endpoint or the client says that it might help. No speculative
execution: it would send requests twice.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize
from .notes import CLIENT_ERROR, KEYS, call_endpoint, sendable

# ---------------------------------------------------------------------------
# Statuses after which another try may help.
TOO_MANY, SERVER_ERRORS = 429, range(500, 600)
# ---------------------------------------------------------------------------

PER_BATCH = 10_000
Client = Callable[[pd.DataFrame], pd.DataFrame]


def may_pass(status: object) -> bool:
    return not pd.isna(status) and (int(status) == TOO_MANY or int(status) in SERVER_ERRORS)


def patient(make_client: Callable[[], Client], per_second: float | None = None, tries: int = 3, first_wait: float = 1.0,
            sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Callable[[], Client]:
    """A client that sends one request at a time, at most ``per_second`` of a
    task, and tries up to ``tries`` times, after waits that double."""

    def make() -> Client:
        client, due = make_client(), clock()

        def send(row: pd.DataFrame) -> pd.DataFrame:
            nonlocal due
            for k in range(tries):
                if per_second:
                    now = clock()
                    if now < due:
                        sleep(due - now)
                    due = max(now, due) + 1 / per_second
                try:
                    out = client(row)
                    if len(out) != 1:
                        raise ValueError(f"{len(out)} answers to 1 request")
                except Exception as e:  # noqa: BLE001 - the answer carries the error
                    out = pd.DataFrame({"status": [CLIENT_ERROR], "body": [f"client error: {type(e).__name__}: {e}"]})
                if not may_pass(out["status"].iloc[0]):
                    break
                if k + 1 < tries:
                    sleep(first_wait * 2**k)
            return out[["status", "body"]]

        return lambda pdf: pd.concat([send(pdf.iloc[i:i + 1]) for i in range(len(pdf))], ignore_index=True).astype({"status": "Int32"})

    return make


def call_id(keys: tuple[str, ...] = KEYS):
    """Names a request by its keys and content."""
    return F.sha2(F.to_json(F.struct(*keys, "url", "request")), 256)


def answers(requests: DataFrame, path: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The answers committed so far: call_id, ``keys``, status, body."""
    schema = requests.select(F.lit("").alias("call_id"), *keys, F.lit(0).cast("int").alias("status"), F.lit("").alias("body")).schema
    requests.limit(0).select(F.lit("").alias("call_id"), *keys, F.lit(0).cast("int").alias("status"), F.lit("").alias("body")).write.mode("append").parquet(path)
    return requests.sparkSession.read.schema(schema).parquet(path)


def answer_requests(requests: DataFrame, make_client: Callable[[], Client], path: str, keys: tuple[str, ...] = KEYS,
                    per_batch: int = PER_BATCH, tasks: int = 8, again: bool = False,
                    after_batch: Callable[[int], None] | None = None) -> DataFrame:
    """U1 for the ``requests(keys, gate, url, request)`` that may be sent:
    their answers (``keys``, status, body) from the table at ``path``, where
    those that are not there yet are added, ``per_batch`` at a time and by
    ``tasks`` clients at once. Requests of equal keys and content are sent once. With
    ``again``, those that failed for now (429, 5xx, client errors) are sent
    again. ``after_batch`` is told of each batch that is committed."""
    spark = requests.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("calls under spark.speculation would be sent twice")
    asked = sendable(requests).select(*keys, "gate", "url", "request").withColumn("call_id", call_id(keys))
    asked = materialize(asked.dropDuplicates(["call_id"]), "asked")
    lasting = ~(F.col("status").between(SERVER_ERRORS.start, SERVER_ERRORS.stop - 1) | (F.col("status") == TOO_MANY))
    known = answers(requests, path, keys)
    if again:
        known = known.where(F.coalesce(lasting, F.lit(True)))
    pending = asked.join(known.select("call_id"), "call_id", "left_anti")
    n_batches = max(1, -(-pending.select("call_id").count() // per_batch))
    folder = os.path.join(ensure_checkpoint_dir(spark), f"batches-{uuid.uuid4().hex}")
    dealt = pending.withColumn("_batch", F.pmod(F.xxhash64("call_id"), F.lit(n_batches)))
    dealt.repartition("_batch").write.partitionBy("_batch").parquet(folder)
    batches = spark.read.schema(dealt.schema).parquet(folder)
    for i in range(n_batches):
        sent = batches.where(F.col("_batch") == i).repartition(tasks, "call_id")
        call_endpoint(sent, make_client, ("call_id", *keys)).select("call_id", *keys, "status", "body").write.mode("append").parquet(path)
        if after_batch is not None:
            after_batch(i)
    # the last answer that lasts, else any
    got = answers(requests, path, keys).groupBy("call_id").agg(
        F.max_by(F.struct(*keys, "status", "body"), F.struct(F.coalesce(lasting, F.lit(True)), F.hash("body"))).alias("a"))
    return asked.select("call_id").join(got, "call_id").select("a.*")
