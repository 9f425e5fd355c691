"""Session construction and the few cluster settings this engine relies on."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale. AQE re-plans joins from real shuffle sizes
# (so a broadcast happens only when the measured side is small), coalesces
# small partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # rows here are small but CPU-heavy (regex, explode): do not merge small
    # shuffles below this size, keep them spread over the cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "colloquy",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when a local session has none (tests) do we set a fresh scratch
    folder of our own; on a cluster its absence is an error, as executors
    share no local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="colloquy-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


_dropped_after = threading.local()


@contextmanager
def dropping_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``materialize`` writes inside, in this thread:
    what reads them must have ended."""
    outer, _dropped_after.paths = getattr(_dropped_after, "paths", None), []
    try:
        yield
    finally:
        written, _dropped_after.paths = _dropped_after.paths, outer
        for folder in written:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read
    back: several readers compute it once, each reads only its columns, and a
    lost executor costs no recomputation. Unlike a persisted relation it holds
    no executor memory; the folder goes with the checkpoint folder, or with
    ``dropping_tables``."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"{tag}-{uuid.uuid4().hex}")
    if getattr(_dropped_after, "paths", None) is not None:
        _dropped_after.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a
    local checkpoint: it would not survive the loss of an executor)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
