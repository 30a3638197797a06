"""Spark helpers that the operators share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass works on; a longer single text is a pass of its own.
CHUNK_BYTES = 1 << 18
#: Rows and bytes of an Arrow batch that goes to a Python worker; a longer single row is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20
PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Session settings for the operators: small Arrow batches, a checkpoint folder if none is set, and the package's
    place for Python workers (on a cluster it is installed there or comes with --py-files).

    On a cluster ``spark.checkpoint.dir`` names a folder that all machines share and is used as it is; a cluster
    without one is refused. Only in local mode (tests) a temporary folder is made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="taskloom-checkpoint-"))


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside drops its shuffle files when it ends: its rows are stored, nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: later plans read the rows from the shared folder, not from this plan."""
    prepare(df.sparkSession)
    with _own_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len(column) + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string() and column.type != pa.large_binary():
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:  # bytes below a null are not promised to be none
        size = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if int(size.sum()) != int(offsets[-1] - offsets[0]):
            column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
            return texts(column)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of documents, each of at most ``limit`` bytes or of one document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... of sizes[0] places, then those of the next, and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def give_back() -> None:
    """What this process has allocated and freed goes back to the system, where Arrow and the C library (glibc) can do so."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def shared_folder(spark: SparkSession) -> str:
    prepare(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def store(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet below the shared checkpoint folder and read them back.

    Like :func:`cut`, in columns that compress, and :func:`discard` can delete it.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _own_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
            df._stored_at = None
