"""The three GeoJSON collections of a track: lines of one surface, symbols, and distance markers.

No route is one value: a collection comes as chunks, one for each bucket of the route's order, whose texts
one after the other are its features. A line that goes on over several buckets is written in pieces, opened in
the bucket where it begins and closed, with its whole distance, where it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geo import feature
from trackweave.operators.distance import INTERVAL_METERS, route_markers
from trackweave.operators.ordered import keyed_islands
from trackweave.operators.runs import in_order
from trackweave.operators.symbols import route_symbols
from trackweave.storage import written

LAYERS = ("line", "symbol", "marker")
# How GeoJSON begins and ends a collection and a line.
HEAD, FOOT = '{"type":"FeatureCollection","features":[', "]}"
OPEN = '{"type":"Feature","geometry":{"type":"LineString","coordinates":['


def _pieces(segments: DataFrame, bucket: str) -> DataFrame:
    """A row a bucket: __key and its pieces of runs in order (run, surface, distance, vertices, text)."""
    rows = keyed_islands(segments, ["route_id"], ["seg_idx"], F.col("surface"), "run_id", bucket)
    empty = F.array().cast("array<array<double>>")
    runs = rows.groupBy("__key", "run_id").agg(F.first("surface").alias("surface"), F.sum("distance").alias("distance"), F.flatten(in_order(F.coalesce("coordinates", empty), ["seg_idx"])).alias("c"))
    text = F.to_json("c")
    piece = F.struct("run_id", "surface", "distance", F.size("c").alias("vertices"), F.substring(text, F.lit(2), F.length(text) - 2).alias("text"))
    return runs.groupBy("__key").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))


def lines(segments: DataFrame, bucket: str) -> DataFrame:
    """Chunks of the runs of one surface, as lines through all their vertices.

    segments: route_id, seg_idx, surface, distance, coordinates and bucket. Only the first and the last piece of a bucket
    can belong to a run of other buckets; one small row each tells what of it lies before, and whether more comes.
    """
    chunks = written(_pieces(segments, bucket), "pieces")
    slim = lambda p: F.struct(p["run_id"].alias("run_id"), p["distance"].alias("distance"), p["vertices"].alias("vertices"))
    edges = chunks.select("__key", F.explode(F.array_distinct(F.array(slim(F.get("pieces", F.lit(0))), slim(F.element_at("pieces", -1))))).alias("p"))
    run = Window.partitionBy(F.col("__key.route_id"), F.col("p.run_id"))
    inside = run.orderBy(F.col(f"__key.{bucket}"))
    info = F.struct(
        F.coalesce(F.sum("p.vertices").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("p.distance").over(run).cast("double").alias("distance"),
        (F.row_number().over(inside) == 1).alias("begins"),
        F.lead(F.lit(True)).over(inside).isNull().alias("ends"),
    )
    known = edges.select(F.col("__key").alias("__at"), F.col("p.run_id").alias("run_id"), info.alias("info")).groupBy("__at").agg(F.map_from_entries(F.collect_list(F.struct("run_id", "info"))).alias("of"))
    whole = lambda p: F.struct(F.lit(0).cast("bigint").alias("before"), p["distance"].cast("double").alias("distance"), F.lit(True).alias("begins"), F.lit(True).alias("ends"))

    def fragment(p: Column) -> Column:
        of = F.coalesce(F.get(F.array(F.col("of")[p["run_id"]]), F.lit(0)), whole(p))
        properties = F.to_json(F.struct(p["surface"].alias("surfaceSmoothness"), of["distance"].alias("distance")))
        return F.concat(
            F.when(of["begins"], F.concat(F.when(p["run_id"] > 0, ",").otherwise(""), F.lit(OPEN))).otherwise(""),
            F.when((of["before"] > 0) & (p["vertices"] > 0), ",").otherwise(""),
            p["text"],
            F.when(of["ends"], F.concat(F.lit(']},"properties":'), properties, F.lit("}"))).otherwise(""),
        )

    ended = F.filter("pieces", lambda p: F.coalesce(F.col("of")[p["run_id"]]["ends"], F.lit(True)))
    out = chunks.join(known, F.col("__key") == F.col("__at"))
    return out.select(F.col("__key.route_id").alias("route_id"), F.lit(LAYERS[0]).alias("layer"), F.col(f"__key.{bucket}").alias("chunk"), F.size(ended).cast("bigint").alias("features"), F.array_join(F.transform("pieces", fragment), "").alias("text"))


def _points(rows: DataFrame, layer: str, bucket: str, coordinates: Column, properties: Column, order: list[str]) -> DataFrame:
    """Chunks of point features; all but a route's first feature begin with a comma."""
    text = F.to_json(feature("Point", coordinates, properties))
    chunks = rows.groupBy("route_id", bucket).agg(F.count("*").alias("features"), F.array_join(in_order(text, order), ",").alias("text"))
    chunks = written(chunks, layer)
    first = chunks.groupBy(F.col("route_id").alias("__of")).agg(F.min(bucket).alias("__first"))
    out = chunks.join(first, F.col("route_id").eqNullSafe(F.col("__of")))
    return out.select("route_id", F.lit(layer).alias("layer"), F.col(bucket).alias("chunk"), "features", F.concat(F.when(F.col(bucket) > F.col("__first"), ",").otherwise(""), "text").alias("text"))


def track_layers(segments: DataFrame, bucket: str, interval: int = INTERVAL_METERS, digits: int = 15) -> DataFrame:
    """(route_id, layer, chunk, features, text): the chunks of a track's collections of lines, symbols and markers.

    segments: route_id, seg_idx (its place in the route), surface, distance, stress, slope, coordinates or parts, and bucket,
    a piece of that order. features counts those that end in the chunk. A layer without features has no chunk. digits:
    decimals of the markers' places.
    """
    marks = route_markers(segments, interval, bucket)
    at = F.array(F.round("lon", digits), F.round("lat", digits))
    signs = route_symbols(segments, bucket)
    symbol = F.struct("symbol", "color", "rotation", "priority")
    return (
        lines(segments, bucket)
        .unionByName(_points(signs, LAYERS[1], bucket, F.col("coordinates"), symbol, ["seg_idx"]))
        .unionByName(_points(marks, LAYERS[2], bucket, at, F.struct("label"), ["marker"]))
    )


def documents(chunks: DataFrame) -> DataFrame:
    """(route_id, line, symbol, marker): the three collections as one text each, for routes that are no larger than a value may be.

    A route with a chunk of any layer has all three, empty where there is nothing.
    """
    text = lambda n: F.concat(F.lit(HEAD), F.array_join(in_order(F.when(F.col("layer") == n, F.col("text")), ["chunk"]), ""), F.lit(FOOT))
    return chunks.groupBy("route_id").agg(*(text(n).alias(n) for n in LAYERS))
