"""The folder that driver and executors share, and tables cut to it."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_here = threading.local()  # ``on_the_way``: paths of the tables cut within ``cut_alone``


def scratch(spark: SparkSession, name: str) -> str:
    """A path in ``spark.checkpoint.dir``.  Where that is unset a local session (tests) uses a temporary
    folder; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.gettempdir()
    path = f"{at.rstrip('/')}/strandline-{spark.sparkContext.applicationId}-{name}"
    if not _made:
        atexit.register(_sweep, spark)
    _made.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: what several branches of a plan
    need is computed once, and survives the loss of executors."""
    path = scratch(df.sparkSession, uuid.uuid4().hex)
    if (on_the_way := getattr(_here, "on_the_way", None)) is not None:
        on_the_way.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, cut; the tables that it cut on the way are needed no more and go, and so do
    their shuffle files, which Spark only removes when the driver collects its garbage."""
    outer, _here.on_the_way = getattr(_here, "on_the_way", None), []
    try:
        df = make()
        gone, _here.on_the_way = _here.on_the_way, outer
        out = cut(df)
    finally:
        _here.on_the_way = outer
    _delete(spark := df.sparkSession, gone)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in map(where, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _sweep(spark: SparkSession) -> None:
    try:
        _delete(spark, _made)
    except Exception:  # the session may be gone at exit; the folders are the application's own
        return
