"""One file a track: chunks of text written in order, under names that don't clash.

Tasks write aside; the job's commit moves all files to their place, and a job that fails leaves none. Rows come sorted by
file, so a task holds one chunk at a time however long a file is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from trackweave.functions import text
from trackweave.operators.ordered import with_running_sum
from trackweave.operators.runs import in_order
from trackweave.sinks.exports import FOOT, gpx_head, gpx_point

#: Pieces that the numbering of equal names is cut into, so that a name that very many tracks have spreads.
PIECES = 256
FORMAT = "track_files"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _place(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator) -> Written:
        """Rows (file, chunk, text), those of a file together and in order."""
        fs, base = self._place()
        aside = f"{base}/_temporary-{self.job}/{uuid.uuid4().hex}"  # an attempt's own folder: a second attempt clashes with none
        fs.create_dir(aside, recursive=True)
        done = []
        for i, (name, chunks) in enumerate(groupby(rows, key=lambda r: r["file"])):
            with fs.open_output_stream(f"{aside}/{i}") as out:
                for chunk in chunks:
                    out.write(chunk["text"].encode())
            done.append((f"{aside}/{i}", f"{base}/{name}"))
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        fs, base = self._place()
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(base)):
                if not old.base_name.startswith("_temporary-"):
                    (fs.delete_file if old.is_file else fs.delete_dir)(old.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: fs.move(*f), (f for m in messages if m for f in m.files)))
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        fs, base = self._place()
        aside = f"{base}/_temporary-{self.job}"
        if fs.get_file_info(aside).type != pafs.FileType.NotFound:
            fs.delete_dir(aside)


class TrackFiles(DataSource):
    """Write-only source of (file, chunk, text); the path is one that pyarrow's file systems open, on all executors alike."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def file_names(tracks: DataFrame, suffix: str, key: str = "route_id", name: str = "name") -> DataFrame:
    """(key, file): the name with hyphens for white space, and " (1)", " (2)", ... before the suffix from the second track of a name on.

    White space is not in such names, so numbered names clash with none. Slashes and control characters become "_"; a missing or empty name is "track".
    """
    plain = F.regexp_replace(text.slug(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("track"))), r"[/\\\x{00}-\x{1F}]", "_")
    rows = tracks.select(key, plain.alias("__plain")).withColumn("__piece", F.pmod(F.xxhash64(key), F.lit(PIECES)))
    counted = with_running_sum(rows, ["__plain"], ["__piece", key], F.lit(1).cast("bigint"), "__n", "__piece")
    return counted.select(key, F.concat("__plain", F.when(F.col("__n") > 1, F.format_string(" (%d)", F.col("__n") - 1)).otherwise(""), F.lit(suffix)).alias("file"))


def gpx_chunks(points: DataFrame, order: list[str], bucket: str, meters: Column | None = None, name: str = "name") -> DataFrame:
    """(route_id, chunk, text): GPX documents of points(route_id, name, lon, lat, bucket, ...) in pieces, one a bucket, between a head and a foot.

    The texts of a route by chunk, one after the other, are its document.
    """
    middle = points.groupBy("route_id", bucket).agg(in_order(gpx_point(F.col("lon"), F.col("lat")), order).alias("p"))
    at = lambda i, b: F.struct(F.lit(i).alias("part"), b.alias("bucket"))
    none = F.lit(None).cast(points.schema[bucket].dataType)
    heads = points.groupBy("route_id").agg(F.first(name, ignorenulls=True).alias("name"), (F.lit(None).cast("double") if meters is None else F.first(meters)).alias("meters"))
    return (
        heads.select("route_id", at(0, none).alias("chunk"), F.concat(gpx_head(F.col("name"), text.distance_text(F.col("meters"))), F.lit("\n")).alias("text"))
        .unionByName(middle.select("route_id", at(1, F.col(bucket)).alias("chunk"), F.concat(F.array_join("p", "\n"), F.lit("\n")).alias("text")))
        .unionByName(heads.select("route_id", at(2, none).alias("chunk"), F.lit(FOOT).alias("text")))
    )


def write_gpx(points: DataFrame, path: str, order: list[str], bucket: str, meters: Column | None = None, name: str = "name", mode: str = "append") -> None:
    """A file <name>.gpx for each route of points below path; with mode overwrite nothing else stays there."""
    names = file_names(points.groupBy("route_id").agg(F.first(name, ignorenulls=True).alias("name")), ".gpx")
    chunks = gpx_chunks(points, order, bucket, meters, name)
    rows = chunks.join(names, "route_id").select("file", "chunk", "text").repartition("file").sortWithinPartitions("file", "chunk")
    register(points.sparkSession)
    rows.write.format(FORMAT).mode(mode).save(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TrackFiles)
