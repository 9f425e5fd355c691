"""Helpers shared by the operators of this subpackage.

Words are hashed straight from the Arrow buffers of a batch of texts, so the
Python side never holds a list of words: a polynomial hash modulo 2^64 over a
random byte table, finished with a bit mixer. Texts are handled in pieces of a
few kilobytes (or one word), which bounds the memory of a task whatever the batch holds.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: Small enough that the working arrays stay in the cache.
PIECE_BYTES = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20240630).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared checkpoint
    folder and read it back. Survives the loss of executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids (8 bytes each) that may be sent to every executor, so that long rows stay where they are.
BROADCAST_IDS = 1_000_000


def within(ids: DataFrame) -> DataFrame:
    """``ids``, broadcast where a count shows that they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join. Without the hint adaptive
    execution collects every small side in the driver and broadcasts it; in a
    loop of joins as many hash tables (1 to 4 MB each, however few the rows)
    stay there until the driver's garbage is collected."""
    return df.hint("merge")


class Workspace:
    """Tables of one computation in a folder of their own under the shared
    checkpoint folder, deleted with the folder when the ``with`` block ends.
    What outlives the block must be written with ``saved`` inside of it."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.made = 0

    def saved(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.folder}/{self.made}-{tag}"
        self.made += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        drop_folder(self.spark, self.folder)


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by the worker process until another key is
    asked for: a worker that goes on to another operator's stage keeps no
    model, cache or tree of the one before."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this subpackage wrote, wherever it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (xor-shift and multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def grow(b: int) -> np.ndarray:
                a = np.full(max(n, 1 << 16), b, np.uint64)
                a[0] = 1
                return np.multiply.accumulate(a)

            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null has length 0."""
    col = col.fill_null("").cast(pa.large_binary())
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    return o, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def byte_table(lower: bool = False, spaces: bytes = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte, is it white space); ``lower`` folds A-Z."""
    codes = _BYTE_CODES.copy()
    if lower:
        codes[65:91] = codes[97:123]
    white = np.zeros(256, bool)
    white[list(spaces)] = True
    return codes, white


def _words_of(part: np.ndarray, cuts: np.ndarray, codes: np.ndarray, white: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of ``part``; ``cuts``: where texts begin."""
    n = len(part)
    inside = ~white.take(part)
    fresh = np.zeros(n + 1, bool)
    fresh[cuts] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    first = np.flatnonzero(inside & (~before | fresh[:n]))
    last = np.flatnonzero(inside & (~after | fresh[1:]))
    up, down = _BYTES.get(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes.take(part) * up, out=total[1:])
    return first, mix((total[last + 1] - total[first]) * down[first] + (last - first).astype(np.uint64) * _STEP)


def word_hashes(col: pa.Array, lower: bool = False, spaces: bytes = SPACE_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows ``lo..hi``: (lo, hi, hashes of all their words,
    word bounds: row ``lo+i`` has words ``bounds[i]:bounds[i+1]``). A row
    larger than a piece is hashed piece by piece, cut at white space."""
    offsets, data = text_buffers(col)
    codes, white = byte_table(lower, spaces)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + PIECE_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), rows)
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a > PIECE_BYTES:  # one long text
            found = []
            while a < b:
                e = min(a + PIECE_BYTES, b)
                while e < b:
                    gaps = np.flatnonzero(white[data[a:e]])
                    if len(gaps):
                        e = a + int(gaps[-1]) + 1
                        break
                    e = min(b, e + PIECE_BYTES)  # a word of megabytes
                found.append(_words_of(data[a:e], np.zeros(0, np.int64), codes, white)[1])
                a = e
            h = np.concatenate(found)
            bounds = np.array([0, len(h)])
        elif b > a:
            first, h = _words_of(data[a:b], offsets[lo:hi] - a, codes, white)
            bounds = np.searchsorted(first, offsets[lo:hi + 1] - a)
        else:
            h, bounds = np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64)
        yield lo, hi, h, bounds
        lo = hi


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word hashes (empty if fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n] + np.uint64(k * int(_STEP) % 2**64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def run_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run ``first:end`` of word hashes."""
    up, down = _WORDS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * _STEP)


#: Bytes of a batch that goes to a Python worker, whatever the rows' number and length.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` from now on, on both sides of the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
           ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives the memory it no longer holds back to the system at
    the end of a task: a worker process outlives its stage."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return outer


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, whatever their Python path is."""
    context = spark.sparkContext
    if getattr(context, "_colloquy_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="colloquy-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*")):
            if f.suffix in (".py", ".txt"):
                z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._colloquy_shipped = True
