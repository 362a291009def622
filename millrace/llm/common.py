"""Shared plumbing of the training-data operators: scratch tables, shipping, text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import scratch

#: Characters that count as white space in every contract of this subpackage.
SPACES = " \t\n\x0b\x0c\r"
_SCRATCH: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table under ``sf_dir``, only the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; only local sessions go without."""
    return scratch.folder(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as a Parquet table in the shared folder and rereads it.

    Losing executors afterwards costs at most a reread, never a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Deletes every scratch table written so far. Call it once results are saved."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; nothing is left to call
            return


atexit.register(release)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished phases now, not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows in the actions inside, for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidied(run):
    """A function over Arrow batches that gives freed memory back when it ends, as Spark keeps its process for later tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(to, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.join("millrace", os.path.relpath(p, root)))
    sc.addPyFile(to)
    sc._millrace_shipped = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int):
    """crc32 of the column's text, modulo ``n``; a null counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
