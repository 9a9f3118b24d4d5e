"""Tables in the folder that driver and executors share, for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it a temporary folder. A cluster without it is an error: folders of single machines can't be shared."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: The paths that `released` is collecting, innermost last.
_collecting: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and return a scan of it: later uses don't recompute it, and no executor holds the only copy.

    The table goes when the session's file system closes; what outlives a crash stands in folders named tessera-*.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _collecting:
        _collecting[-1].append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def released(build: Callable[[], DataFrame]) -> DataFrame:
    """The result of build() as a table; the tables that were made on the way to it are deleted at once, not with the session."""
    _collecting.append([])
    try:
        df = build()
    finally:
        made = _collecting.pop()
    spark, kept = df.sparkSession, materialize(df)
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return kept
