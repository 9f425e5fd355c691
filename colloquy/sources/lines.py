"""Numbered lines of text files of any size.

Spark reads a large file in splits, each in a task of its own, and gives a line
no number. Here a line's number is the number of lines in the splits before its
own plus its place in it: the lines of a split are consecutive in its task, so
the place is the distance to the split's first line in Spark's row id, and the
splits are counted in a pass that reads no text into the shuffle. Only one small
row per split is ever shuffled; no file has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT_COUNT = "spark.sql.files.minPartitionNum"
CHANGED = "a file changed, or was split anew, while its lines were numbered"


def located(text_lines: DataFrame) -> DataFrame:
    """(line, file, block) of a text source, batch or stream: the file and the
    byte where the line's split begins."""
    return text_lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                             F.col("_metadata.file_block_start").alias("block"))


def pin_splits(spark: SparkSession) -> None:
    """Fix the size of file splits for the session: by default it follows the
    number of cores, which changes when an executor is lost between two scans."""
    if spark.conf.get(SPLIT_COUNT, None) is None:
        spark.conf.set(SPLIT_COUNT, str(spark.sparkContext.defaultParallelism))


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``located`` lines of all files under ``path``, ended by line feeds alone."""
    pin_splits(spark)
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    return located((reader.option("pathGlobFilter", glob) if glob else reader).text(path))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) of ``located`` lines, numbered from 0 in each
    file. Fails, and may be run again, if the files change meanwhile."""
    at = lines.withColumn("_id", F.monotonically_increasing_id())
    spans = at.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    place = F.col("_id") - F.col("_first")
    number = F.when(place.between(0, F.col("_n") - 1), F.col("_before") + place).otherwise(F.raise_error(F.lit(CHANGED)).cast("long"))
    return at.join(spans, ["file", "block"], "left").select("file", number.alias("line_no"), "line")


def file_session(file: Column, pattern: str = r"([^/]+?)(?:\.[^./]*)?$") -> Column:
    """The part of a file's path that names its session: its stem."""
    return F.regexp_extract(file, pattern, 1)
