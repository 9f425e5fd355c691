"""Note templates as a table ``template_id, body, description``."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem, strip

BUILTIN_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "templates")


def first_line(body) -> F.Column:
    """First non-empty stripped line, whole; cutting it is up to the display."""
    lines = F.transform(F.split(body, "\n", -1), lambda x: strip(x))
    first = F.get(F.filter(lines, lambda x: x != ""), 0)
    return F.coalesce(first, F.lit(""))


def load_templates(spark: SparkSession, directory: str | None = None) -> DataFrame:
    """Whole files, newlines kept; ``template_id`` is the file stem. The built-in
    templates lie beside this package on the driver, so the driver reads them;
    ``directory`` names a folder that all executors share."""
    if directory is None:
        raw = spark.createDataFrame([(p.name, p.read_text(encoding="utf-8")) for p in sorted(Path(BUILTIN_DIR).glob("*.txt"))],
                                    "name string, value string")
    else:
        raw = spark.read.text(directory, wholetext=True, pathGlobFilter="*.txt").withColumn("name", F.col("_metadata.file_name"))
    return raw.select(
        file_stem("name").alias("template_id"),
        F.col("value").alias("body"),
        first_line(F.col("value")).alias("description"),
    )
