"""Folders that the driver and executors share, and lineage cuts in them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: One temporary folder per application.
_own: dict[str, str] = {}
#: Paths made, by application.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one the cluster names in
    ``spark.checkpoint.dir``. On one machine, as in tests, a temporary folder does where that is
    unset; on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
        named = _own[sc.applicationId]
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses, until ``release``."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes what this application has put in the shared folder, its checkpoints included. Call it once
    the results that were made of it have been written; a result that is still to be computed needs it."""
    checkpoints = spark.sparkContext.getCheckpointDir()  # a folder of this application alone
    for path in [*_made.pop(spark.sparkContext.applicationId, []), *([checkpoints] if checkpoints else [])]:
        delete(spark, path)
    if checkpoints:
        place = spark._jvm.org.apache.hadoop.fs.Path(checkpoints)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` whose writing has ended; none if there is no such path."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    system = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(of(path)):
        return []
    return sorted(f.getPath().getName() for f in system.listStatus(of(path)) if f.isDirectory() and system.exists(of(f"{path}/{f.getPath().getName()}/_SUCCESS")))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a lost executor costs no
    recomputation of what came before."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
