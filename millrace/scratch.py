"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder; elsewhere
    executors couldn't see that, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
    return _LOCAL[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and rereads it: whatever is derived from it afterwards sees the same rows, and a lost executor
    costs a reread."""
    spark = df.sparkSession
    path = f"{folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the tables written so far. Call it once results are saved; else it is done when the process ends."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone; nothing is left to call
            return


atexit.register(release)
