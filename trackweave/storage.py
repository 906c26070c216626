"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that written() has made, by application.
_PATHS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset in local mode (tests), a folder of our own is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not (sc.master or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="trackweave-"))
        base = sc.getCheckpointDir()
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder below shared_dir(), not yet made; remove() deletes it with the tables of written()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder, in a folder for each value of by, and read it again.

    Results are read lazily, so a table must outlive the call that makes it; remove() drops those of a
    session once its results are stored.
    """
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession) -> int:
    """Delete the tables that written() made in this application; how many there were."""
    paths = _PATHS.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
