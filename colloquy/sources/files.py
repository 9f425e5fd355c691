"""A file for each session (S9), written by the tasks of a job.

A Python data source: each task writes its rows' files into a folder of its own
and lists them; the driver then moves whole task folders into place, one move a
task, and puts the manifest there last. A task that fails removes its folder; a
job that fails leaves no file. Readers go by the manifest, so they never see the
files of a job that has not ended, nor of attempts that lost.

Layout: ``{path}/{job}-{task}/{file_name}`` and ``{path}/_manifest/{task}.jsonl``
with one line for each file: session_id, file_name, path, n_bytes, sha256.
The folder may be on any store that pyarrow opens by its URI.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "session_files"
MANIFEST = "session_id long, file_name string, path string, n_bytes long, sha256 string"
STAGED, MANIFESTS = "_staged", "_manifest"


def store(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")  # Hadoop's short form
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    task: int
    folder: str
    n_files: int


class SessionFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        files, root = store(self.path)
        folder = f"{STAGED}/{self.job}/{task}-{attempt}"
        final = f"{self.job}-{task}"
        files.create_dir(f"{root}/{folder}", recursive=True)
        try:
            names, listed = set(), []
            for row in rows:
                name = row["file_name"]
                if not name or "/" in name or name in names:
                    raise ValueError(f"not a file name of its own: {name!r}")
                names.add(name)
                data = (row["content"] or "").encode()
                with files.open_output_stream(f"{root}/{folder}/{name}") as out:
                    out.write(data)
                listed.append(json.dumps({"session_id": row["session_id"], "file_name": name, "path": f"{final}/{name}",
                                          "n_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}))
            with files.open_output_stream(f"{root}/{STAGED}/{self.job}/{task}-{attempt}.jsonl") as out:
                out.write("".join(f"{x}\n" for x in listed).encode())
        except BaseException:
            files.delete_dir(f"{root}/{folder}")
            raise
        return Written(task, folder, len(listed))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        from pyarrow import fs

        earlier = files.get_file_info(fs.FileSelector(root, recursive=False)) if self.overwrite else []
        earlier = [x for x in earlier if x.base_name != STAGED and x.type == fs.FileType.Directory]
        for old in earlier:
            if old.base_name == MANIFESTS:  # first, so that no reader follows it to files that go
                files.delete_dir(old.path)
        for old in earlier:
            if old.base_name != MANIFESTS:
                files.delete_dir(old.path)
        files.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        done = [m for m in messages if m is not None and m.n_files]
        for m in done:
            files.move(f"{root}/{m.folder}", f"{root}/{self.job}-{m.task}")
        for m in done:
            files.move(f"{root}/{m.folder}.jsonl", f"{root}/{MANIFESTS}/{self.job}-{m.task}.jsonl")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store(self.path))

    def _clear(self, files, root: str) -> None:
        """What this job's attempts left behind."""
        from pyarrow import fs

        staged = f"{root}/{STAGED}/{self.job}"
        if files.get_file_info(staged).type == fs.FileType.Directory:
            files.delete_dir(staged)


class SessionFiles(DataSource):
    """``df.write.format("session_files").save(path)`` for rows (session_id, file_name, content)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> SessionFileWriter:
        return SessionFileWriter(self.options["path"], overwrite)


def write_session_files(artifacts: DataFrame, path: str, mode: str = "append") -> None:
    """Each row's content as a file of its own. File names must differ
    within a task; rows are dealt by session, so one session's do."""
    spark = artifacts.sparkSession
    spark.dataSource.register(SessionFiles)
    rows = artifacts.select(F.col("session_id").cast("long"), "file_name", "content").repartition("session_id")
    rows.write.format(FORMAT).mode(mode).save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files that committed jobs wrote: session_id, file_name, path, n_bytes, sha256."""
    return spark.read.schema(MANIFEST).json(f"{path}/{MANIFESTS}")


def read_session_files(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with each file's ``content``."""
    texts = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
             .select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("path"), F.col("value").alias("content")))
    return manifest(spark, path).join(texts, "path", "left").withColumn("content", F.coalesce("content", F.lit("")))
