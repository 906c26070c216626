"""Registered queries over the driver tables, each with its DuckDB text where SQL gives the same rows.

The tables hold no routes, so columns stand in: events are the segments of a route for each user
(ordered by time, value the distance, event_type the surface), embeddings are points (the first two
numbers give lon and lat), lineitem rows are segments with stress and slope, orders are tracks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import checks, geo, keys, text
from trackweave.operators import collections as coll
from trackweave.operators import distance, geometry, routes, runs, sorting, statistics, symbols
from trackweave.sinks import exports
from trackweave.sources.dimensions import BIKE_TYPES, DEFAULT_SETTINGS, built_in_profiles, with_bike_type, with_surface
from trackweave.sources.documents import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORDER = ["ts", "event_id"]
INTERVAL = 500


def query(sql: str | None = None, name: str | None = None):
    """Register the function under its own name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments; a route is cut by days, so that a hot one spreads over tasks."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("route_id"), "ts", "event_id", F.col("value").cast("decimal(12,2)").alias("distance"), F.col("event_type").alias("surface"), F.date_trunc("day", "ts").alias("day"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(F.col("label").cast("bigint").alias("route_id"), "vec_id", (at(0) + 6).alias("lon"), (at(1) + 46).alias("lat"), "embedding")


SEG = "seg AS (SELECT user_id AS route_id, ts, event_id, CAST(value AS DECIMAL(12,2)) AS distance, event_type AS surface FROM events)"
ISLANDS = f"""WITH {SEG},
p AS (SELECT *, lag(surface) OVER w AS prev, row_number() OVER w AS n FROM seg WINDOW w AS (PARTITION BY route_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(CASE WHEN n > 1 AND surface IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM p)"""
PTS = "pts AS (SELECT CAST(label AS BIGINT) AS route_id, vec_id, CAST(embedding[1] AS DOUBLE) + 6 AS lon, CAST(embedding[2] AS DOUBLE) + 46 AS lat, embedding FROM embeddings)"
RUNNING = f"{SEG}, m AS (SELECT *, sum(distance) OVER (PARTITION BY route_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS after FROM seg)"


def meters_sql(a: str, b: str) -> str:
    h = f"pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)"
    return f"2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - ({h})))"


@query(ISLANDS + " SELECT route_id, run_id, any_value(surface) AS surface, CAST(sum(distance) AS DOUBLE) AS distance, count(*) AS n_segments FROM r GROUP BY route_id, run_id")
def surface_runs(spark, sf_dir):
    out = runs.surface_runs(segments(spark, sf_dir), ORDER, "day")
    return out.withColumn("distance", F.col("distance").cast("double"))


@query(ISLANDS + " SELECT route_id, max(run_id) + 1 AS n_runs FROM r GROUP BY route_id")
def run_counts(spark, sf_dir):
    return runs.run_counts(segments(spark, sf_dir), ORDER, "day")


@query(ISLANDS + " SELECT route_id, run_id, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY ts, event_id) AS path FROM r GROUP BY route_id, run_id")
def run_coordinates(spark, sf_dir):
    """Coordinates of runs; each event's id stands for its vertex."""
    s = segments(spark, sf_dir).withColumn("coordinates", F.array(F.array(F.col("event_id").cast("double"))))
    out = runs.run_coordinates(s, ORDER, "day")
    return out.select("route_id", "run_id", F.array_join(F.transform("coordinates", lambda c: c[0].cast("bigint").cast("string")), " ").alias("path"))


@query(f"WITH {RUNNING} SELECT route_id, event_id, CAST(after - distance AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after FROM m")
def running_distance(spark, sf_dir):
    out = distance.running_distance(segments(spark, sf_dir), ORDER, "day")
    return out.select("route_id", "event_id", F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after"))


@query(
    f"""WITH {RUNNING}, k AS (SELECT *, after - distance AS before, unnest(range(CAST(floor((after - distance) / {INTERVAL}) AS BIGINT) + 1, CAST(floor(after / {INTERVAL}) AS BIGINT) + 1)) AS marker FROM m WHERE distance > 0)
SELECT route_id, event_id, marker, round(CAST(marker * {INTERVAL} - before AS DOUBLE) / CAST(distance AS DOUBLE), 6) AS share FROM k"""
)
def distance_markers(spark, sf_dir):
    out = distance.distance_markers(distance.running_distance(segments(spark, sf_dir), ORDER, "day"), INTERVAL)
    return out.select("route_id", "event_id", F.col("marker").cast("bigint").alias("marker"), F.round("share", 6).alias("share"))


@query(f"WITH {PTS}, q AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM pts WINDOW w AS (PARTITION BY route_id ORDER BY vec_id)) SELECT route_id, vec_id, round({meters_sql('p', '')}, 3) AS meters FROM q")
def vertex_pairs_haversine(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("part", F.floor(F.col("vec_id") / 256))
    return distance.point_pairs(p, ["vec_id"], "part").select("route_id", "vec_id", F.round("meters", 3).alias("meters"))


@query(f"WITH {PTS}, q AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM pts WINDOW w AS (PARTITION BY route_id ORDER BY vec_id)) SELECT route_id, round(CAST(sum(CAST({meters_sql('p', '')} AS DECIMAL(18,6))) AS DOUBLE), 3) AS meters FROM q GROUP BY route_id")
def polyline_length(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("part", F.floor(F.col("vec_id") / 256))
    rows = distance.point_pairs(p, ["vec_id"], "part")
    return rows.groupBy("route_id").agg(F.round(F.sum(F.col("meters").cast("decimal(18,6)")).cast("double"), 3).alias("meters"))


@query(f"WITH {PTS} SELECT vec_id, round(lon + (CAST(embedding[3] AS DOUBLE) + 6 - lon) * 0.25, 9) AS lon, round(lat + (CAST(embedding[4] AS DOUBLE) + 46 - lat) * 0.25, 9) AS lat FROM pts")
def interpolate_points(spark, sf_dir):
    p = points(spark, sf_dir)
    to = lambda i, base: F.get("embedding", F.lit(i)).cast("double") + base
    return p.select("vec_id", F.round(geo.lerp(F.col("lon"), to(2, 6), F.lit(0.25)), 9).alias("lon"), F.round(geo.lerp(F.col("lat"), to(3, 46), F.lit(0.25)), 9).alias("lat"))


@query(f"WITH {PTS} SELECT route_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM pts GROUP BY route_id")
def bounding_boxes(spark, sf_dir):
    return geometry.bounding_boxes(points(spark, sf_dir))


@query("SELECT vec_id, CAST(embedding[len(embedding) // 2 + 1] AS DOUBLE) AS mid FROM embeddings")
def mid_vertex(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", geo.mid_vertex(F.col("embedding")).cast("double").alias("mid"))


def rated(spark, sf_dir):
    """lineitem as segments: stress 1 to 5 from the discount, slope -24 to 25 from the quantity."""
    stress = (F.floor(F.col("l_discount") * 40 + 0.5) + 1).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", stress.alias("stress"), (F.col("l_quantity") - 25).alias("slope"))


RULES = [(f"stress >= {least}", "car", color, priority, 0) for least, color, priority in symbols.STRESS_RULES] + [
    (f"slope {sign}{limit}", name, color, priority, turn) for limit, name, color, priority in symbols.SLOPE_RULES for sign, turn in ((">", 0), ("< -", 180))
]


def case_sql(i: int) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]!r}" for r in RULES) + " END"


RATED = "s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, floor(l_discount * 40 + 0.5) + 1 AS stress, l_quantity - 25 AS slope FROM lineitem)"
SYMBOLS = f"WITH {RATED}, c AS (SELECT *, {case_sql(1)} AS symbol, {case_sql(2)} AS color, CAST({case_sql(3)} AS INT) AS priority, CAST({case_sql(4)} AS INT) AS rotation FROM s)"


@query(SYMBOLS + " SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, symbol, color, priority, rotation FROM c WHERE symbol IS NOT NULL")
def segment_symbols(spark, sf_dir):
    rows = rated(spark, sf_dir).withColumn("s", symbols.symbol(F.col("stress"), F.col("slope"))).filter("s IS NOT NULL")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "s.*")


@query(SYMBOLS + " SELECT coalesce(symbol, 'none') AS symbol, coalesce(color, 'none') AS color, rotation, count(*) AS n FROM c GROUP BY ALL")
def symbol_histogram(spark, sf_dir):
    rows = rated(spark, sf_dir).withColumn("s", symbols.symbol(F.col("stress"), F.col("slope")))
    return rows.groupBy(F.coalesce("s.symbol", F.lit("none")).alias("symbol"), F.coalesce("s.color", F.lit("none")).alias("color"), F.col("s.rotation").alias("rotation")).agg(F.count("*").alias("n"))


def surfaced(spark, sf_dir):
    """Events with a surface name by event_id, one in ten unknown to the table."""
    names = [s for s, _, _ in symbols.SURFACES] + ["GLASS"]
    pick = F.get(F.array(*map(F.lit, names)), F.pmod("event_id", F.lit(10)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", pick.alias("surface"))


SURFACED = "e AS (SELECT event_id, [" + ", ".join(f"'{s}'" for s, _, _ in symbols.SURFACES) + ", 'GLASS'][CAST(event_id % 10 AS INT) + 1] AS surface FROM events)"
DIMENSION = "d(surface, color, label) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in symbols.SURFACES) + ")"


@query(f"WITH {SURFACED}, {DIMENSION} SELECT event_id, coalesce(color, '{symbols.DEFAULT_COLOR}') AS color, label FROM e LEFT JOIN d USING (surface)")
def surface_colors(spark, sf_dir):
    return with_surface(surfaced(spark, sf_dir), spark).select("event_id", "color", "label")


@query(f"WITH {SURFACED} SELECT event_id, CASE surface WHEN 'UNPAVED_INTERMEDIATE' THEN 'smooth' WHEN 'UNPAVED_BAD' THEN 'ok' WHEN 'UNPAVED_HORRIBLE' THEN 'technical' WHEN 'UNPAVED_IMPASSABLE' THEN 'technical' END AS class, surface LIKE 'UNPAVED%' AS unpaved FROM e")
def unpaved_filters(spark, sf_dir):
    return surfaced(spark, sf_dir).select("event_id", symbols.unpaved_class(F.col("surface")).alias("class"), symbols.is_unpaved(F.col("surface")).alias("unpaved"))


def listed(spark, sf_dir):
    """orders as tracks, with the number of their lines as waypoints; ord is the order's key."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("pts"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")


TRACK_KEYS = {
    "name": "lower(o_orderpriority)",
    "pts": "coalesce(pts, 0)",
    "date": "o_orderdate",
    "distance": "coalesce(o_totalprice, 0)",
    "time": "floor(coalesce(o_totalprice, 0) / 60)",
    "elevation": "coalesce(o_custkey, 0) % 1000",
    "match": "coalesce(o_custkey, 0) % 100",
    "saved": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
}
LISTED = "l AS (SELECT o.*, n.pts FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS pts FROM lineitem GROUP BY 1) n ON n.l_orderkey = o.o_orderkey)"


def _sort_query(sort: sorting.Sort):
    def run(spark, sf_dir):
        keyed = {k: F.expr(v) for k, v in TRACK_KEYS.items()}
        return sorting.positions(listed(spark, sf_dir), sorting.ordering(keyed, sort, "o_orderkey")).select("o_orderkey", "pos")

    return run


for _key, _sql in TRACK_KEYS.items():
    for _dir in ("asc", "desc"):
        query(f"WITH {LISTED} SELECT o_orderkey, row_number() OVER (ORDER BY {_sql} {_dir}, o_orderkey) AS pos FROM l", f"track_sort_{_key}_{_dir}")(_sort_query(sorting.Sort(_key, _dir)))
query(f"WITH {LISTED} SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM l", "track_sort_default")(_sort_query(sorting.Sort(None, "none")))


@query("SELECT * FROM (VALUES (0, 0::BIGINT, 'gravel-adventure', 'Gravel Adventure'), (0, 1, 'relaxed-road-trip', 'Relaxed Road Trip'), (0, 2, 'urban-commuter', 'Urban Commuter')) v(part, place, id, name) UNION ALL SELECT 1, c_custkey, 'custom-' || c_custkey, c_name FROM customer")
def profiles_union(spark, sf_dir):
    built_in = built_in_profiles(spark).select("id", "name", "ord")
    custom = table(spark, sf_dir, "customer").select(F.concat(F.lit("custom-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    return coll.concatenated(built_in, custom).select("ord.part", "ord.place", "id", "name")


def tracks(spark, sf_dir):
    """orders as a keyed collection, in the order of their keys."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "F").alias("isPermanent"), (F.col("o_custkey") % 3 == 0).alias("isVisible"), F.col("o_orderkey").alias("ord"))


TRACKS = "t AS (SELECT o_orderkey AS id, o_orderpriority AS name, o_totalprice AS price, o_orderstatus = 'F' AS isPermanent, o_custkey % 3 = 0 AS isVisible, o_orderkey AS ord FROM orders)"


def changes(spark, sf_dir):
    """New versions of every seventh track, every other of them under a new id."""
    t = tracks(spark, sf_dir).filter("id % 7 = 0")
    new_id = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 10_000_000)
    return t.select(new_id.alias("id"), F.lit("changed").alias("name"), (F.col("price") + 1).alias("price"), "isPermanent", "isVisible", "ord")


CHANGES = "c AS (SELECT CASE WHEN id % 2 = 0 THEN id ELSE id + 10000000 END AS id, 'changed' AS name, price + 1 AS price, isPermanent, isVisible, ord FROM t WHERE id % 7 = 0)"


@query(
    f"""WITH {TRACKS}, {CHANGES}, u AS (SELECT * FROM t UNION ALL SELECT id, name, price, isPermanent, isVisible, ord + (SELECT max(ord) + 1 FROM t) FROM c)
SELECT id, name, price, isPermanent, isVisible, min(ord) OVER (PARTITION BY id) AS ord FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY u.ord DESC) = 1"""
)
def tracks_upsert(spark, sf_dir):
    return coll.upsert(tracks(spark, sf_dir), changes(spark, sf_dir))


@query(f"WITH {TRACKS} SELECT id, name, ord FROM t WHERE id % 5 <> 0")
def tracks_delete(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return coll.delete(t, t.filter("id % 5 = 0")).select("id", "name", "ord")


@query(f"WITH {TRACKS}, {CHANGES} SELECT id, name, ord FROM t WHERE id IN (SELECT id FROM c)")
def tracks_by_ids(spark, sf_dir):
    return coll.only(tracks(spark, sf_dir), changes(spark, sf_dir)).select("id", "name", "ord")


@query(f"WITH {TRACKS}, {CHANGES} SELECT t.id, coalesce(c.name, t.name) AS name, coalesce(c.price, t.price) AS price, t.ord FROM t LEFT JOIN c USING (id)")
def tracks_update(spark, sf_dir):
    t = tracks(spark, sf_dir).select("id", "name", "price", "ord")
    return coll.update_if_present(t, changes(spark, sf_dir).select("id", "name", "price"))


@query(f"WITH {TRACKS} SELECT id FROM t WHERE id <> 33 AND isVisible")
def hide_others(spark, sf_dir):
    return coll.others_visible(tracks(spark, sf_dir), 33).select("id")


@query(f"WITH {TRACKS} SELECT id, isPermanent, name, ord FROM t WHERE id <> 3 OR isPermanent UNION ALL SELECT 20000000, true, 'Saved', (SELECT max(ord) + 1 FROM t) FROM t WHERE id = 3")
def promote_track(spark, sf_dir):
    out = coll.promote_copy(tracks(spark, sf_dir), 3, 20_000_000, "Saved")
    return out.select(F.col("id").cast("bigint").alias("id"), "isPermanent", "name", "ord")


@query(f"WITH {TRACKS} SELECT id, CASE WHEN id = 3 THEN true ELSE isPermanent END AS isPermanent, CASE WHEN id = 3 THEN 'Tour' ELSE name END AS name FROM t")
def promote_in_place(spark, sf_dir):
    return coll.promote_in_place(tracks(spark, sf_dir), 3, "  Tour ").select("id", "isPermanent", "name")


@query(f"WITH {TRACKS}, r AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'over' END AS name, CASE WHEN id % 5 = 0 THEN 0.0::DOUBLE END AS price FROM t WHERE id % 2 = 0) SELECT t.id, coalesce(r.name, t.name) AS name, coalesce(r.price, t.price) AS price FROM t LEFT JOIN r USING (id)")
def settings_overlay(spark, sf_dir):
    t = tracks(spark, sf_dir).select("id", "name", "price")
    over = t.filter("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, "over").alias("name"), F.when(F.col("id") % 5 == 0, 0.0).alias("price"))
    return coll.overlay(t, over)


@query("SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 0 ELSE 1 END, c_custkey) = 1")
def default_or_first(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    is_default = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 0)
    return coll.default_or_first(c, ["c_nationkey"], is_default, ["c_custkey"]).select("c_nationkey", "c_custkey", "c_name")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events")
def renumber_waypoints(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    return coll.renumbered(e, ["user_id"], ORDER, bucket="day").select("event_id", "number")


@query("SELECT user_id, count(*) + 1 AS next FROM events GROUP BY user_id")
def next_waypoint(spark, sf_dir):
    return coll.next_number(table(spark, sf_dir, "events"), ["user_id"])


@query("SELECT user_id, ts, event_id FROM events WHERE user_id NOT IN (SELECT DISTINCT user_id FROM events WHERE event_id % 50 = 0) UNION ALL SELECT user_id, ts, -event_id FROM events WHERE event_id % 50 = 0")
def replace_waypoints(spark, sf_dir):
    """Waypoints of some users are cleared and set anew, by those that these users' new rows hold."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return coll.replaced(e, e.filter("event_id % 50 = 0").withColumn("event_id", -F.col("event_id")), ["user_id"])


def saved(spark, sf_dir):
    """embeddings as saved tracks: every two numbers of a vector are a waypoint, numbered in it."""
    e, at = F.col("embedding"), lambda i: F.get("embedding", i).cast("double")
    way = lambda i: F.struct(i.cast("string").alias("id"), at(2 * i).alias("lng"), at(2 * i + 1).alias("lat"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.floor(F.size(e) / 2).cast("int") - 1), way).alias("waypoints"))


SAVED = "w AS (SELECT vec_id, embedding, unnest(range(len(embedding) // 2)) AS i FROM embeddings)"


@query(f"WITH {SAVED} SELECT vec_id AS id, CAST(i AS INT) AS ord, CAST(embedding[2 * i + 1] AS DOUBLE) AS lng, CAST(embedding[2 * i + 2] AS DOUBLE) AS lat FROM w")
def reload_waypoints(spark, sf_dir):
    """Waypoints of saved tracks without their ids, in order."""
    return routes.reloaded(saved(spark, sf_dir))


@query(f"WITH {SAVED} SELECT vec_id, CAST(i AS INT) AS ord, CAST(embedding[2 * i + 2] AS DOUBLE) AS lat, CAST(embedding[2 * i + 1] AS DOUBLE) AS lon FROM w")
def request_points(spark, sf_dir):
    return saved(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(routes.points_of(F.col("waypoints"))).alias("ord", "p")).select("vec_id", "ord", "p.lat", "p.lon")


@query(
    "WITH b(i, code, label) AS (VALUES " + ", ".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(BIKE_TYPES.items())) + ") SELECT c_custkey, coalesce(code, 'NONE') AS bikeType, coalesce(label, 'NONE') AS bike_label FROM customer LEFT JOIN b ON c_custkey % 25 = i"
)
def bike_labels(spark, sf_dir):
    codes = F.array(*(F.lit(c) for c in BIKE_TYPES))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.get(codes, (F.col("c_custkey") % 25).cast("int")), F.lit("NONE")).alias("bikeType"))
    return with_bike_type(c, spark).select("c_custkey", "bikeType", "bike_label")


@query(
    """WITH l AS (SELECT vec_id, label, unnest(range(CASE WHEN vec_id % 3 = 0 THEN 3 WHEN vec_id % 3 = 1 THEN 2 ELSE 0 END)) AS vertex_idx FROM embeddings)
SELECT vec_id AS seg_idx, CAST(vertex_idx AS INT) AS vertex_idx, CAST(vec_id + vertex_idx AS DOUBLE) AS lon, CAST(label AS DOUBLE) AS lat FROM l"""
)
def line_vertices(spark, sf_dir):
    """Vertices of lines, of multi-lines (one line after the other), and of points, which have none."""
    k, at = F.col("vec_id") % 3, lambda i: F.format_string("[%d,%d]", F.col("vec_id") + i, F.col("label"))
    kind = F.when(k == 0, "MultiLineString").when(k == 1, "LineString").otherwise("Point")
    coordinates = F.when(k == 0, F.concat(F.lit("[["), at(0), F.lit(","), at(1), F.lit("],["), at(2), F.lit("]]"))).when(k == 1, F.concat(F.lit("["), at(0), F.lit(","), at(1), F.lit("]"))).otherwise(at(0))
    geometry_ = F.struct(kind.alias("type"), F.parse_json(coordinates).alias("coordinates"))
    feature = F.struct(geometry_.alias("geometry"), F.struct(F.lit("UNKNOWN").alias("surfaceSmoothness")).alias("properties"))
    rows = routes.segments(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("route_id"), F.array(feature).alias("features")))
    return geometry.vertices(rows).select(F.col("route_id").alias("seg_idx"), "vertex_idx", "lon", "lat")


@query("SELECT user_id, min_by(event_id, (ts, event_id)) AS origin, max_by(event_id, (ts, event_id)) AS destination, greatest(count(*) - 2, 0) AS n_via FROM events GROUP BY user_id")
def origin_dest_via(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("route_id"), "ts", "event_id", F.col("event_id").alias("lat"), F.lit(0).alias("lon"))
    out = geometry.ends(e, ORDER)
    return out.select(F.col("route_id").alias("user_id"), F.col("origin.lat").alias("origin"), F.col("destination.lat").alias("destination"), "n_via")


@query("SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'Route ' || (user_id + 1) ELSE array_to_string(list_sort(list(DISTINCT event_type)), ', ') END AS name FROM events GROUP BY user_id")
def display_name(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("labels"))
    labels = F.when(F.col("user_id") % 4 != 0, F.col("labels"))
    return rows.select("user_id", text.display_name(labels, F.col("user_id")).alias("name"))


@query(f"SELECT o_orderkey, list_sum(list_transform(string_split(CAST(o_orderkey AS VARCHAR) || '-' || o_orderpriority, ''), lambda c: ascii(c)))::BIGINT % 8 AS slot, [{', '.join(map(repr, keys.HASH_COLORS))}][CAST(list_sum(list_transform(string_split(CAST(o_orderkey AS VARCHAR) || '-' || o_orderpriority, ''), lambda c: ascii(c))) % 8 AS INT) + 1] AS color, [{', '.join(map(repr, keys.ROUTE_COLORS))}][CAST(o_orderkey % 8 AS INT) + 1] AS route_color FROM orders")
def color_hash(spark, sf_dir):
    key = F.concat_ws("-", F.col("o_orderkey").cast("string"), "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", keys.hash_slot(key).alias("slot"), keys.color_or_hash(F.lit(""), key).alias("color"), keys.route_color(F.col("o_orderkey")).alias("route_color"))


@query(f"SELECT p_partkey, regexp_replace(p_name, '[{text.SPACE}]+', '-', 'g') AS slug FROM part")
def slug_names(spark, sf_dir):
    """File names from whole names."""
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query(
    f"""WITH p AS (SELECT page_id, url, '#' || upper(substr(md5(url), 1, CASE WHEN page_id % 3 = 0 THEN 5 ELSE 6 END)) AS color, page_id % 240 AS km, page_id % 4 AS n FROM pages)
SELECT page_id, color, regexp_full_match(color, '#[0-9A-Fa-f]{{6}}') AS hex, length(regexp_replace(url, '^[{text.SPACE}]+|[{text.SPACE}]+$', '', 'g')) > 0 AS named, length(regexp_replace(url, '^[{text.SPACE}]+|[{text.SPACE}]+$', '', 'g')) >= 3 AS search, n >= 2 AS route, n >= 1 AS circular, CASE WHEN km BETWEEN 10 AND 200 THEN km * 1000.0::DOUBLE END AS meters FROM p"""
)
def validation_flags(spark, sf_dir):
    n, km = F.col("page_id") % 4, F.col("page_id") % 240
    color = F.concat(F.lit("#"), F.upper(F.substring(F.md5("url"), F.lit(1), F.when(F.col("page_id") % 3 == 0, 5).otherwise(6))))
    return table(spark, sf_dir, "pages").select(
        "page_id", color.alias("color"), checks.is_hex_color(color).alias("hex"), checks.has_name(F.col("url")).alias("named"), checks.is_search_term(F.col("url")).alias("search"),
        checks.can_route(n).alias("route"), checks.can_route(n, circular=True).alias("circular"), checks.circular_meters(km).cast("double").alias("meters"),
    )


@query("SELECT event_id, CAST(floor(value / 60 + 0.5) AS BIGINT) AS minutes, value IS NULL OR value = 0 AS is_na FROM events")
def display_minutes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.js_round(F.col("value") / 60).alias("minutes"), (text.duration_text(F.col("value")) == "N/A").alias("is_na"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"WITH {TRACKS} SELECT nullif(count(*), 0) AS routes, nullif(count(*) FILTER (isPermanent), 0) AS saved, nullif(count(*) FILTER (NOT isPermanent), 0) AS temporary, count(*) FILTER (isVisible) AS visible, CAST(sum(id % 4) AS BIGINT) AS waypoints FROM t")
def diagnostic_counts(spark, sf_dir):
    points_of = F.array_repeat(F.lit(1), (F.col("id") % 4).cast("int"))
    return coll.counts(tracks(spark, sf_dir).withColumn("waypoints", points_of))


@query("SELECT o_custkey, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS fastest, min_by(o_orderkey, (-(o_orderkey % 17)::DOUBLE, o_orderkey)) AS friendliest FROM orders GROUP BY o_custkey")
def fastest_label(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("friendly", (F.col("o_orderkey") % 17).cast("double"))
    return statistics.labelled(o, "o_custkey", "o_orderkey", "o_totalprice", "friendly")


def weighed(spark, sf_dir):
    """lineitem as segments of a route for each order; the part's key modulo 1000 is the length."""
    stress = (F.floor(F.col("l_discount") * 40 + 0.5) + 1).cast("double")
    surface = F.get(F.array(*(F.lit(s) for s, _, _ in symbols.SURFACES)), F.pmod("l_partkey", F.lit(9)).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route_id"), stress.alias("stress"), (F.col("l_quantity") - 25).cast("double").alias("slope"), (F.col("l_partkey") % 1000 + 1).cast("double").alias("distance"), surface.alias("surface"))


WEIGHED = "g AS (SELECT l_orderkey AS route_id, floor(l_discount * 40 + 0.5) + 1 AS stress, l_quantity - 25 AS slope, CAST(l_partkey % 1000 + 1 AS DOUBLE) AS distance, [" + ", ".join(f"'{s}'" for s, _, _ in symbols.SURFACES) + "][CAST(l_partkey % 9 AS INT) + 1] AS surface FROM lineitem)"


@query(f"WITH {WEIGHED} SELECT route_id, round(100 * sum(CASE WHEN abs(slope) > 6 THEN distance ELSE 0 END) / sum(distance), 6) AS steep, round(sum(slope * distance) / sum(distance), 6) AS slope, round(100 * sum(CASE WHEN stress >= 4 THEN distance ELSE 0 END) / sum(distance), 6) AS traffic, round(100 * sum(CASE WHEN surface LIKE 'UNPAVED%' OR surface = 'PAVED_BAD' THEN distance ELSE 0 END) / sum(distance), 6) AS rough FROM g GROUP BY route_id")
def route_statistics(spark, sf_dir):
    out = statistics.summary(weighed(spark, sf_dir))
    return out.select("route_id", *(F.round(c, 6).alias(c) for c in ("steep", "slope", "traffic", "rough")))


@query("WITH d AS (SELECT user_id, CAST(value AS DECIMAL(12,2)) - lag(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id AS route_id, coalesce(CAST(sum(greatest(d, 0)) AS DOUBLE), 0) AS gain, coalesce(CAST(sum(greatest(-d, 0)) AS DOUBLE), 0) AS loss FROM d GROUP BY user_id")
def climbs(spark, sf_dir):
    """Rises and falls of the value along a user's events, by day so that a hot user spreads."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("route_id"), "ts", "event_id", F.col("value").cast("decimal(12,2)").alias("elevation"), F.date_trunc("day", "ts").alias("day"))
    return statistics.climbs(e, ORDER, "day")


@query("SELECT o_custkey AS response_id, o_orderkey AS route_idx, l_linenumber AS leg_idx, CAST(sum(l_partkey) AS DOUBLE) AS distanceMeters, CAST(sum(l_suppkey) AS DOUBLE) AS durationSeconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ROLLUP (o_custkey, o_orderkey, l_linenumber) HAVING o_custkey IS NOT NULL")
def distance_rollup(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    steps = steps.select(F.col("o_custkey").alias("response_id"), F.col("o_orderkey").alias("route_idx"), F.col("l_linenumber").alias("leg_idx"), F.col("l_partkey").cast("double").alias("distanceMeters"), F.col("l_suppkey").cast("double").alias("durationSeconds"))
    return statistics.rolled_up(steps)


POINT_SQL = """'{"locationType":"POINT","point":{"lat":' || (event_id % 90)::DOUBLE || ',"lon":' || (event_id % 180)::DOUBLE || '}}'"""


def fixed_sql(x: str, digits: int) -> str:
    """Fixed decimals of x as text; a number exactly between two goes away from zero."""
    halves = f"{x} * {2 * 2**digits}"
    return f"printf('%.{digits}f', CASE WHEN {halves} = floor({halves}) AND abs({halves} % 2) = 1 THEN {x} + sign({x}) * 0.01 ELSE {x} END)"


def shown_sql(x: str, shown: str, zero_is_missing: bool = True) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}){f' OR {x} = 0' if zero_is_missing else ''} THEN 'N/A' ELSE {shown} END"


@query(
    f"""WITH {PTS}, n AS (SELECT *, 'Label ' || route_id AS name FROM pts)
SELECT route_id, regexp_replace(name, '\\s+', '-', 'g') || '.gpx' AS file,
  '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gpx version="1.1" creator="trackweave" xmlns="http://www.topografix.com/GPX/1/1">' || chr(10) || '  <metadata>' || chr(10)
  || '    <name>' || name || '</name>' || chr(10) || '    <desc>Distance: N/A</desc>' || chr(10) || '  </metadata>' || chr(10) || '  <trk>' || chr(10) || '    <name>' || name || '</name>' || chr(10) || '    <trkseg>' || chr(10)
  || string_agg('      <trkpt lat="' || lat || '" lon="' || lon || '"></trkpt>', chr(10) ORDER BY vec_id) || chr(10) || '    </trkseg>' || chr(10) || '  </trk>' || chr(10) || '</gpx>' AS document
FROM n GROUP BY route_id, name"""
)
def gpx_document(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("name", F.concat(F.lit("Label "), F.col("route_id").cast("string")))
    return exports.gpx_documents(p, ["vec_id"])


@query(
    f"""SELECT event_id, {shown_sql('value', fixed_sql('(value * 100 / 1000)', 1) + " || 'km'")} AS wide, {shown_sql('value', fixed_sql('(value * 100 / 1000)', 1) + " || 'km'", False)} AS narrow,
  {shown_sql('value', "'↗' || " + fixed_sql('value', 0) + " || 'm'")} AS gain, CASE WHEN value IS NULL THEN 'N/A' WHEN value = floor(value) THEN CAST(value AS BIGINT) || '%' ELSE value || '%' END AS match
FROM events"""
)
def display_distance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.distance_text(F.col("value") * 100).alias("wide"), text.distance_text(F.col("value") * 100, zero_is_missing=False).alias("narrow"), text.gain_text(F.col("value")).alias("gain"), text.match_text(F.col("value")).alias("match"))


@query(
    f"""WITH p AS (SELECT user_id AS route_id, {POINT_SQL} AS stop, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id % 90, event_id % 180))
SELECT route_id, '{{"client":"WEB","origin":' || any_value(stop) FILTER (n = 1) || ',"destination":' || any_value(stop) FILTER (n = k) || ',"waypoints":[' || coalesce(string_agg(stop, ',' ORDER BY n) FILTER (n > 1 AND n < k), '') || '],"settings":'
  || '{json.dumps(DEFAULT_SETTINGS, separators=(",", ":"))[:-1]}' || CASE WHEN route_id % 2 = 0 THEN ',"desiredLengthMeters":50000.0' ELSE '' END || '}},"departureDateTime":"2026-01-01T00:00:00.000Z"}}' AS request
FROM p GROUP BY route_id"""
)
def routing_requests(spark, sf_dir):
    """The request document of each user's events, with a desired length for every second user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("route_id"), "ts", (F.col("event_id") % 90).cast("double").alias("lat"), (F.col("event_id") % 180).cast("double").alias("lon"))
    stops = geometry.first_last_via(e, ["ts"])
    out = routes.requests(stops, F.lit("2026-01-01").cast("timestamp"), desired_meters=F.when(F.col("route_id") % 2 == 0, 50_000.0))
    return out.select("route_id", F.to_json("request").alias("request"))


from trackweave.plans import documents, layers  # noqa: E402, F401  (register their queries)
