"""Readers with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave import snapshots
from trackweave.schemas import PROFILE, RESPONSE, TRACK


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def responses(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Response documents, one a file or (multi_line false) one a line; broken ones give null rows, which go."""
    return spark.read.schema(RESPONSE).option("mode", "PERMISSIVE").json(path, multiLine=multi_line).filter("id IS NOT NULL OR routes IS NOT NULL")


def _saved(spark: SparkSession, path: str, fields: str, version: int | None, mode: str) -> DataFrame:
    """Rows of a snapshot at path, or of JSON lines there, with ord.

    A line is one object with its ord, or an array of objects, whose ord is the place in it.
    """
    try:
        lines = spark.read.text(snapshots.folder(spark, path, version) or path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{fields}, ord bigint")
    several, options = F.ltrim("value").startswith("["), {"mode": mode}
    item = f"struct<{fields}, ord bigint>"
    objects = F.array(F.from_json(F.when(~several, F.col("value")), item, options))
    rows = lines.filter(F.trim("value") != "").select(several.alias("several"), F.posexplode(F.when(several, F.from_json(F.when(several, F.col("value")), f"array<{item}>", options)).otherwise(objects)).alias("place", "item"))
    return rows.withColumn("ord", F.when(F.col("several"), F.col("place").cast("bigint")).otherwise(F.col("item.ord"))).select(*(f"item.{f}" for f in rows.select("item.*").columns if f != "ord"), "ord")


def tracks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Saved tracks with their ord, of a snapshot or a file of lines; none is visible at first. A broken line is skipped, a missing path is empty."""
    return _saved(spark, path, TRACK, version, "PERMISSIVE").filter("id IS NOT NULL").withColumn("isVisible", F.lit(False))


def profiles(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Custom profiles with their ord; a missing path is empty, a broken line fails."""
    return _saved(spark, path, PROFILE, version, "FAILFAST")
