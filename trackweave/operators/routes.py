"""Route documents: requests, responses flattened to tables, app routes and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import geo, keys, text
from trackweave.functions.checks import has_routes, is_line
from trackweave.operators.collections import overlay_struct
from trackweave.schemas import EXTRA_NUMBERS
from trackweave.sources.dimensions import DEFAULT_SETTINGS, SETTINGS_NAMES, default_settings


def location(point: Column) -> Column:
    return F.struct(F.lit("POINT").alias("locationType"), F.struct(point["lat"].alias("lat"), point["lon"].alias("lon")).alias("point"))


def requests(stops: DataFrame, departure: Column, settings: Column | None = None, desired_meters: Column | None = None) -> DataFrame:
    """stops(route_id, origin, destination, via[, ...]) with `request`, the document to send.

    settings, where its fields are not null, go over the defaults, and desired_meters over these.
    """
    base = default_settings()
    if settings is not None:
        base = overlay_struct(base, settings, SETTINGS_NAMES)
    if desired_meters is not None:
        base = F.struct(*(base[n].alias(n) for n in DEFAULT_SETTINGS), F.coalesce(desired_meters, base["desiredLengthMeters"]).alias("desiredLengthMeters"))
    request = F.struct(
        F.lit("WEB").alias("client"),
        location(F.col("origin")).alias("origin"),
        location(F.col("destination")).alias("destination"),
        F.transform("via", location).alias("waypoints"),
        base.alias("settings"),
        F.date_format(departure, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("departureDateTime"),
    )
    return stops.withColumn("request", request)


def route_rows(responses: DataFrame) -> DataFrame:
    """(response_id, route_idx, route) of every route; a response without routes has none, whatever its status."""
    return responses.filter(has_routes(F.col("routes"))).select(F.col("id").alias("response_id"), F.posexplode("routes").alias("route_idx", "route"))


def routes_table(responses: DataFrame) -> DataFrame:
    """One row a route: ends, statistics, box and extras, whose numbers in text become doubles or null."""
    rows = route_rows(responses)
    stats = [F.col(f"route.stats.{c}") for c in rows.select("route.stats.*").columns]
    extras = [F.expr(f"try_cast(route.dummyMap.{c} AS double)").alias(c) for c in EXTRA_NUMBERS]
    box = [F.col(f"route.boundingBox.{corner}.{c}").alias(f"{name}_{c}") for corner, name in (("topLeft", "top_left"), ("bottomRight", "bottom_right")) for c in ("lat", "lon")]
    return rows.select("response_id", "route_idx", F.col("route.type").alias("type"), F.col("route.labels").alias("labels"), F.col("route.start").alias("start"), F.col("route.end").alias("end"), *stats, *box, *extras)


def legs_table(responses: DataFrame) -> DataFrame:
    rows = route_rows(responses).select("response_id", "route_idx", F.posexplode("route.legs").alias("leg_idx", "leg"))
    return rows.select("response_id", "route_idx", "leg_idx", "leg.mode", "leg.start", "leg.end", "leg.stats.*", F.col("leg.steps").alias("steps"))


def steps_table(responses: DataFrame) -> DataFrame:
    rows = legs_table(responses).select("response_id", "route_idx", "leg_idx", F.posexplode("steps").alias("step_idx", "step"))
    warning = [F.expr(f"try_cast(step.start.warning.properties.{c} AS double)").alias(f"warning_{c}") for c in ("length", "stress")]
    return rows.select("response_id", "route_idx", "leg_idx", "step_idx", "step.start", "step.end", "step.via", "step.distanceMeters", "step.durationSeconds", "step.instruction.*", *warning)


def via_table(responses: DataFrame) -> DataFrame:
    rows = steps_table(responses).select("response_id", "route_idx", "leg_idx", "step_idx", F.posexplode("via").alias("via_idx", "p"))
    return rows.select("response_id", "route_idx", "leg_idx", "step_idx", "via_idx", "p.lat", "p.lon", "p.elevationMeters")


def segments(features: DataFrame) -> DataFrame:
    """features(route_id, features) to a row each: (route_id, seg_idx, the properties, surface, coordinates, parts).

    coordinates are all vertices, parts those of each line: lengths are measured inside parts.
    """
    rows = features.select("route_id", F.posexplode("features").alias("seg_idx", "f"))
    parts = geo.parts(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return rows.select("route_id", "seg_idx", "f.properties.*", F.col("f.properties.surfaceSmoothness").alias("surface"), F.flatten(parts).alias("coordinates"), parts.alias("parts"))


def features_of(document: Column) -> Column:
    """The features of a collection; a document that is one feature gives that one, any other null."""
    alone = F.array(F.struct(F.lit("Feature").alias("type"), document["geometry"].alias("geometry"), document["properties"].alias("properties")))
    return F.when(document["features"].isNotNull(), document["features"]).when(document["geometry"].isNotNull(), alone)


def segments_table(responses: DataFrame) -> DataFrame:
    """Segments of every route with route_id "<response>/<index>"."""
    rows = route_rows(responses).select(F.concat_ws("/", "response_id", F.col("route_idx").cast("string")).alias("route_id"), features_of(F.col("route.geoJson")).alias("features"))
    return segments(rows)


def collection_or_null(document: Column) -> Column:
    """A collection as it is if it has features, else null."""
    return F.when(document["features"].isNotNull(), document)


def points_of(waypoints: Column) -> Column:
    """Waypoints (id, lng, lat) as points (lat, lon) of a request; ids go."""
    return F.transform(waypoints, lambda w: F.struct(w["lat"].alias("lat"), w["lng"].alias("lon")))


def reloaded(tracks: DataFrame) -> DataFrame:
    """(id, ord, lng, lat) of the waypoints of saved tracks, to be added again under new ids; ord counts from 0."""
    rows = tracks.select("id", F.posexplode("waypoints").alias("ord", "w"))
    return rows.select("id", "ord", "w.lng", "w.lat")


def line_features(features: Column) -> Column:
    return F.filter(features, lambda f: is_line(f["geometry"]))


def section_features(sections: Column) -> Column:
    """Sections as line features, numbered anew; those without coordinates go."""
    kept = F.filter(sections, lambda s: F.coalesce(F.size(s["coordinates"]) > 0, F.lit(False)))
    feature = lambda s, i: F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), s["coordinates"].alias("coordinates")).alias("geometry"), F.struct(s["surfaceSmoothness"].alias("surfaceSmoothness"), s["distance"].alias("distance"), i.alias("index")).alias("properties")
    )
    return F.transform(kept, feature)


def app_routes(responses: DataFrame, stamp: Column, circular: bool = False) -> DataFrame:
    """Routes that have geometry, as the app keeps them; routeIndex counts the ones without it too."""
    rows = route_rows(responses).filter("route.geoJson IS NOT NULL")
    index = F.col("route_idx").cast("bigint")
    name = text.display_name(F.col("route.labels"), index, "Circular Route" if circular else "Route")
    fields = ("distanceMeters", "durationSeconds", "elevationGainMeters", "elevationDropMeters", "userSettingsMatch", "safetyScore", "bikeFriendlyRoutesPercentage")
    return rows.select(
        "response_id",
        F.concat_ws("-", F.lit("route"), stamp.cast("string"), index.cast("string")).alias("id"),
        F.col("route.geoJson").alias("geojson"),
        F.struct(*(F.col(f"route.stats.{f}").alias(f) for f in fields)).alias("stats"),
        F.col("route.labels").alias("labels"),
        index.alias("routeIndex"),
        name.alias("name"),
        keys.route_color(index).alias("color"),
    )


def temporary_tracks(routes: DataFrame, waypoints: Column, stamp: Column, created: Column) -> DataFrame:
    """App routes as temporary, visible tracks with all waypoints."""
    fields = ("id", "geojson", "stats", "labels", "routeIndex", "name", "color")
    return routes.select(
        F.concat_ws("-", F.lit("temp"), stamp.cast("string"), F.col("routeIndex").cast("string")).alias("id"),
        "name",
        waypoints.alias("waypoints"),
        F.struct(*fields).alias("route"),
        F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt"),
        F.lit(False).alias("isPermanent"),
        "color",
        F.lit(True).alias("isVisible"),
        F.col("routeIndex").alias("ord"),
    )


def list_rows(tracks: DataFrame, wide: bool = True) -> DataFrame:
    """What the track list shows: in the wide view zero statistics are missing, in the narrow one they are not."""
    stats = lambda f: F.col(f"route.stats.{f}")
    return tracks.select(
        "id",
        "name",
        F.size("waypoints").alias("pts"),
        text.date_text(F.to_timestamp("createdAt")).alias("date"),
        text.distance_text(stats("distanceMeters"), wide).alias("distance"),
        text.duration_text(stats("durationSeconds"), wide).alias("time"),
        text.gain_text(stats("elevationGainMeters"), wide).alias("elevation"),
        text.match_text(stats("userSettingsMatch")).alias("match"),
        F.col("isPermanent").alias("saved"),
        keys.color_or_hash(F.col("color"), F.col("id")).alias("color"),
    )


def profile_from_form(checked: dict[str, Column]) -> dict[str, Column]:
    """Check boxes (stairs, pavements, oneways) as settings."""
    return {k: F.when(v, "STRICTLY_AVOID").otherwise("AVOID_IF_POSSIBLE") for k, v in checked.items()}
