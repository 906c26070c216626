"""Registered queries of documents and edits of collections. See catalogue for the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.functions import keys
from trackweave.operators import collections as coll
from trackweave.operators import routes
from trackweave.plans.catalogue import CHANGES, TRACKS, changes, fixed_sql, query, tracks
from trackweave.schemas import RESPONSE
from trackweave.sources.documents import table


def responses(spark, sf_dir):
    """A response document of three routes for each customer, the second without geometry, read with the documents' schema."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    line = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[%d,1],[%d,2]]},"properties":{"distance":%d,"surfaceSmoothness":"PAVED_GOOD"}}]}'
    text = F.format_string(
        '{"id":"c%d","routes":[{"id":1,"labels":["FAST","%s"],"stats":{"distanceMeters":%d,"durationSeconds":%d,"elevationGainMeters":%d,"userSettingsMatch":%d},"geoJson":' + line + '},{"id":2,"stats":{}},{"id":3,"labels":[],"geoJson":' + line + "}]}",
        k, F.trim("c_mktsegment"), k * 10, k * 3, k % 50, k % 100, k % 90, k % 80, k % 70, k % 60, k % 50, k % 40,
    )
    return c.select(F.from_json(text, f"struct<{RESPONSE}>").alias("r")).select("r.*")


_COLOURS = f"[{', '.join(map(repr, keys.ROUTE_COLORS))}]"
APP = f"""a AS (SELECT c_custkey AS k, i, CASE WHEN i = 0 THEN 'FAST, ' || trim(c_mktsegment) ELSE 'Route 3' END AS name, {_COLOURS}[i + 1] AS color, CASE WHEN i = 0 THEN CAST(c_custkey * 10 AS DOUBLE) END AS meters, CASE WHEN i = 0 THEN c_custkey * 3 END AS seconds, CASE WHEN i = 0 THEN c_custkey % 50 END AS gain, CASE WHEN i = 0 THEN c_custkey % 100 END AS match
  FROM customer, (VALUES (0), (2)) v(i))"""


@query(f"WITH {APP} SELECT 'c' || k AS response_id, 'route-7-' || i AS id, CAST(i AS BIGINT) AS routeIndex, name, color, meters FROM a")
def app_routes(spark, sf_dir):
    """Routes with geometry as the app keeps them; the one without is counted by the index."""
    return routes.app_routes(responses(spark, sf_dir), F.lit(7)).select("response_id", "id", "routeIndex", "name", "color", F.col("stats.distanceMeters").alias("meters"))


@query(
    f"""WITH {APP} SELECT 'temp-8-' || i AS id, name, 1 AS pts, '01/02/26' AS date, CASE WHEN coalesce(meters, 0) = 0 THEN 'N/A' ELSE {fixed_sql('(meters / 1000)', 1)} || 'km' END AS distance,
  CASE WHEN coalesce(seconds, 0) = 0 THEN 'N/A' ELSE CAST(floor(seconds / 60 + 0.5) AS BIGINT) || 'min' END AS time, CASE WHEN coalesce(gain, 0) = 0 THEN 'N/A' ELSE '↗' || gain || 'm' END AS elevation, CASE WHEN match IS NULL THEN 'N/A' ELSE match || '%' END AS match, false AS saved, color FROM a"""
)
def track_list(spark, sf_dir):
    """Routes made temporary tracks, as the wide list shows them."""
    app = routes.app_routes(responses(spark, sf_dir), F.lit(7))
    way = F.array(F.struct(F.lit("w").alias("id"), F.lit(1.0).alias("lng"), F.lit(2.0).alias("lat")))
    return routes.list_rows(routes.temporary_tracks(app, way, F.lit(8), F.lit("2026-01-02").cast("timestamp")))


@query("SELECT 'c' || c_custkey || '/' || v.i AS route_id, 0 AS seg_idx, CAST(c_custkey % m AS DOUBLE) AS distance, 'PAVED_GOOD' AS surface, 2 AS vertices FROM customer, (VALUES (0, 70), (2, 40)) v(i, m)")
def response_segments(spark, sf_dir):
    """Segments of all routes of the response documents."""
    return routes.segments_table(responses(spark, sf_dir)).select("route_id", "seg_idx", "distance", "surface", F.size("coordinates").alias("vertices"))


@query(f"WITH {TRACKS} SELECT id, name, ord FROM t WHERE isPermanent")
def clear_temporary(spark, sf_dir):
    return coll.clear_temporary(tracks(spark, sf_dir)).select("id", "name", "ord")


@query(
    f"""WITH {TRACKS}, {CHANGES}, p AS (SELECT * FROM t WHERE isPermanent), u AS (SELECT * FROM p UNION ALL SELECT id, name, price, isPermanent, isVisible, ord + (SELECT max(ord) + 1 FROM p) FROM c)
SELECT id, name, price, isPermanent, min(ord) OVER (PARTITION BY id) AS ord FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY u.ord DESC) = 1"""
)
def add_routes(spark, sf_dir):
    """New tracks in place of the temporary ones."""
    return coll.add_routes(tracks(spark, sf_dir), changes(spark, sf_dir), replace=True).select("id", "name", "price", "isPermanent", "ord")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2)")
def routes_after_edit(spark, sf_dir):
    """Orders as routes stay where at least two lines, their waypoints, are left."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("set_id"), "o_orderdate")
    return coll.routes_after_edit(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_id"))).select(F.col("set_id").alias("o_orderkey"), "o_orderdate")


@query(
    """WITH s AS (SELECT vec_id, label, embedding, unnest(range(len(embedding) // 2)) AS i FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS n FROM s WHERE (i + vec_id) % 3 <> 0)
SELECT vec_id, CAST(n AS INT) AS "index", CASE WHEN i % 2 = 0 THEN 'PAVED_GOOD' ELSE 'UNPAVED_BAD' END AS surface, CAST(i AS DOUBLE) AS distance, CAST(embedding[2 * i + 1] AS DOUBLE) AS lon FROM k"""
)
def section_features(spark, sf_dir):
    """Every two numbers of a vector as a section, those without coordinates left out and the rest numbered anew."""
    e, v = F.col("embedding"), F.col("vec_id")
    at = lambda i: F.array(F.array(F.get(e, 2 * i).cast("double"), F.get(e, 2 * i + 1).cast("double")))
    section = lambda i: F.struct(F.when((i + v) % 3 != 0, at(i)).otherwise(F.array().cast("array<array<double>>")).alias("coordinates"), F.when(i % 2 == 0, "PAVED_GOOD").otherwise("UNPAVED_BAD").alias("surfaceSmoothness"), i.cast("double").alias("distance"))
    sections = F.transform(F.sequence(F.lit(0), F.floor(F.size(e) / 2).cast("int") - 1), section)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(routes.section_features(sections)).alias("f"))
    p = "f.properties."
    return rows.select("vec_id", F.col(f"{p}index").alias("index"), F.col(f"{p}surfaceSmoothness").alias("surface"), F.col(f"{p}distance").alias("distance"), F.col("f.geometry.coordinates")[0][0].alias("lon"))


_BOX = "CASE WHEN {} THEN 'STRICTLY_AVOID' ELSE 'AVOID_IF_POSSIBLE' END"


@query(f"SELECT c_custkey, {_BOX.format('c_custkey % 2 = 0')} AS stairs, {_BOX.format('c_acctbal < 0')} AS pavements, {_BOX.format('c_nationkey > 12')} AS oneways FROM customer")
def profile_from_form(spark, sf_dir):
    """Check boxes of each customer as settings."""
    boxes = {"stairs": F.col("c_custkey") % 2 == 0, "pavements": F.col("c_acctbal") < 0, "oneways": F.col("c_nationkey") > 12}
    return table(spark, sf_dir, "customer").select("c_custkey", *(v.alias(k) for k, v in routes.profile_from_form(boxes).items()))
