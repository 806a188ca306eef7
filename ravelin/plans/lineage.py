"""Lineage cuts in the shared folder of the cluster, and joins that broadcast only what was measured."""

from __future__ import annotations

import gc
import math
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where it may be unset, one is chosen and set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    own = os.path.join(tempfile.gettempdir(), "ravelin-shared")
    spark.sparkContext.setCheckpointDir(own)
    return own


_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs start from the files, so the loss of an executor costs no recomputation.

    ``batch_rows`` bounds the rows of the Arrow batches that Python workers get meanwhile, where rows hold long texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ravelin/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_ARROW)
    try:
        if batch_rows is not None:
            spark.conf.set(_ARROW, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files that ``materialise`` wrote for ``df``, when nothing reads it any more; a frame that isn't plainly one of those is left alone."""
    spark = df.sparkSession
    folder = re.sub(r"^[a-z0-9]+:/*", "/", f"{shared_dir(spark)}/ravelin/")
    roots = {f.rpartition("/")[0] for f in df.inputFiles()}
    for root in roots:
        if re.sub(r"^[a-z0-9]+:/*", "/", root).startswith(folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Collect the driver's garbage: broadcast tables, shuffle files and plans of jobs that have ended stay until then. For loops of many jobs."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, *columns: str, rows: int = 500_000, n: int | None = None) -> DataFrame:
    """Shuffled by ``columns`` into tasks of about ``rows`` rows, counted, where ``spark.sql.shuffle.partitions`` would leave more in each; else as it is. What one task holds then doesn't grow with the table. ``n``: a count known before."""
    parts = math.ceil((df.count() if n is None else n) / rows)
    return df.repartition(parts, *columns) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def broadcast_below(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint when the measured row count is within the limit, else the plain side (a shuffle join)."""
    return F.broadcast(df) if rows <= limit else df
