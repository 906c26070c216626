"""Versioned snapshots of a collection: saved where they were loaded from, and never half.

A version is a folder of JSON lines and a small file that names it. The file is written aside and takes
its number by one rename, which fails where that number is taken; until then readers see the version before. What a
reader has opened stays until vacuum() drops it. Paths go through Hadoop's file systems; on an object store without an
atomic rename one writer at a time is needed.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

VERSIONS = "_versions"


class Conflict(RuntimeError):
    """Another writer has saved in between."""


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions at path, ascending; none where there is nothing yet."""
    place, fs = _place(spark, f"{path}/{VERSIONS}")
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{10}\.json", n))


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    place, fs = _place(spark, f"{path}/{VERSIONS}/{version:010d}.json")
    stream = fs.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def folder(spark: SparkSession, path: str, version: int | None = None) -> str | None:
    """The folder that holds a version, the last one if none is named; None where there is none."""
    there = versions(spark, path)
    if not there:
        return None
    if version is not None and version not in there:
        raise ValueError(f"{path} has no version {version}")
    return f"{path}/{_manifest(spark, path, there[-1] if version is None else version)['data']}"


def save(table: DataFrame, path: str, read: int | None = None) -> int:
    """Save table as the next version at path, which it may itself have been read from; the version's number.

    read: the version that table was made from (0: none); Conflict if there is a later one. A writer that dies leaves files that no
    version names, and the version before.
    """
    spark = table.sparkSession
    last = (versions(spark, path) or [0])[-1]
    if read is not None and read != last:
        raise Conflict(f"{path} is at version {last}, not {read}")
    data = f"data-{uuid.uuid4().hex}"
    table.write.json(f"{path}/{data}")
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    aside, fs = _place(spark, f"{path}/{VERSIONS}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({"data": data}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    number = last + 1
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(_place(spark, f"{path}/{VERSIONS}/{number:010d}.json")[0]), gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
    except Py4JJavaError as e:
        fs.delete(aside, False)
        raise Conflict(f"{path} got version {number} from another writer") from e
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drop all versions but the last `keep`, and files of writers that died; how many folders went. Run it when nobody writes."""
    there = versions(spark, path)
    kept = {_manifest(spark, path, v)["data"] for v in there[-keep:]}
    place, fs = _place(spark, path)
    for v in there[:-keep]:
        fs.delete(_place(spark, f"{path}/{VERSIONS}/{v:010d}.json")[0], False)
    gone = [f.getPath() for f in fs.listStatus(place) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in kept] if fs.exists(place) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
