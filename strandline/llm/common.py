"""Helpers shared by the corpus operators: Arrow batch access, mixing of 64-bit
hashes and tables cut to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers with good avalanche."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_list(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def byte_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that ``column`` holds about ``size`` bytes a piece, one row at least."""
    at, held = 0, 0
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the bytes of an Arrow batch between Spark and Python, unless the session has a bound of
    its own: a batch is held several times on both sides, and long texts would make the default of 64 MB the
    largest thing in memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, size)


def tidy() -> None:
    """Gives memory back to the system at the end of a task: Python workers live on, idle, and
    several share an executor's allowance."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc: ctypes.CDLL | None = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a local session (tests) uses a temporary folder; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/strandline-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep(spark: SparkSession) -> None:
    for path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone at exit; the folder is the application's own
            return


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    The table survives the loss of executors; the application's folder is removed at exit."""
    spark = df.sparkSession
    base = shared_dir(spark)
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if not _made:
        atexit.register(_sweep, spark)
    _made.add(base)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table made by ``written`` once nothing reads it any more."""
    if path := getattr(df, "_strandline_path", None):
        remove(df.sparkSession, path)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
