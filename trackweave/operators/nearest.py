"""The k nearest places of each point on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import geo

#: Cubes of the finest level have an edge of 4 ** -9 radii, 24 m; each level above has cubes of four times that edge, and level 0 is one cube.
FINEST = 10
AXES = ("x", "y", "z")


def _edge(level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(4.0 ** (1 - j)) for j in range(FINEST + 1))), level + 1)


def _packed(cube: list[Column]) -> Column:
    x, y, z = (c.cast("bigint") for c in cube)
    return (x * (1 << 21) + y) * (1 << 21) + z


def _placed(rows: DataFrame) -> DataFrame:
    """rows(lon, lat) with their place on the unit sphere and their finest cube; no rows without coordinates."""
    lon, lat = F.radians("lon"), F.radians("lat")
    at = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    return rows.filter("lon IS NOT NULL AND lat IS NOT NULL").withColumns(at).withColumns({f"c{a}": F.floor((F.col(a) + 1) * 4.0 ** (FINEST - 1)) for a in AXES})


def _levels() -> Column:
    """A row's cube at each level, as an array of (level, cube)."""
    return F.array(*(F.struct(F.lit(j).alias("level"), _packed([F.shiftright(f"c{a}", 2 * (FINEST - j)) for a in AXES]).alias("cube")) for j in range(FINEST + 1)))


def _first(rows: DataFrame, by: list[str], order: list[str], k: int, name: str) -> DataFrame:
    """The first k rows of each group, numbered; Spark keeps k a group in each task before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def _around(asked: DataFrame) -> DataFrame:
    """asked, once for each cube of its level within the diagonal of a cube that the sphere goes through."""
    rows = asked.withColumn("edge", _edge(F.col("level"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(124))))
    to, low, high, cube = F.lit(0.0), F.lit(0.0), F.lit(0.0), []
    for n, a in enumerate(AXES):
        cube.append(F.floor((F.col(a) + 1) / F.col("edge")) + F.floor(F.col("i") / 5**n) % 5 - 2)
        begin, end = cube[n] * F.col("edge") - 1, (cube[n] + 1) * F.col("edge") - 1
        to += F.pow(F.greatest(begin - F.col(a), F.lit(0.0), F.col(a) - end), 2)
        low += F.pow(F.greatest(begin, -end, F.lit(0.0)), 2)
        high += F.pow(F.greatest(F.abs(begin), F.abs(end)), 2)
    near = (to <= F.pow(F.col("edge") * 3**0.5 + 1e-9, 2)) & (low <= 1 + 1e-9) & (high >= 1 - 1e-9)
    return rows.filter(near).withColumn("cube", _packed(cube))


def nearest(queries: DataFrame, places: DataFrame, k: int, key: str, place: str) -> DataFrame:
    """(key, rank, place, meters): the k nearest rows of places(place, lon, lat) for each row of queries(key, lon, lat), in degrees.

    Great-circle distances count in whole millimetres, equal ones by place. With fewer than k places all are given; rows without
    coordinates neither ask nor answer; repeated rows of queries give their rows again, repeated places are places each. Other columns are
    ignored.

    Cubes of the space around the sphere are the join key, so poles and the date line are places like others. A query takes the finest level
    at which its own cube holds k places: its k nearest are then within that cube's diagonal, and it meets the cubes of that level within
    reach. Queries at one spot ask once; of places at one spot the k least are kept, as no other can be in an answer. The work for a query
    follows the density around it; a query beside a cluster, in a cube that ends far from it, meets the whole cluster.
    """
    spots = _placed(_first(places.select(place, "lon", "lat"), ["lon", "lat"], [place], k, "n").drop("n"))
    asked = _placed(queries.select("lon", "lat").distinct())
    fine = [f"c{a}" for a in AXES]
    held = spots.groupBy(*fine).agg(F.count("*").alias("n")).select("n", F.inline(_levels())).groupBy("level", "cube").agg(F.sum("n").alias("n")).filter(F.col("n") >= k)
    level = asked.select(*fine).distinct().select(*fine, F.inline(_levels())).join(held, ["level", "cube"]).groupBy(*fine).agg(F.max("level").alias("level"))
    asked = asked.join(level, fine, "left").withColumn("level", F.coalesce("level", F.lit(0)))
    found = _around(asked).select(F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "level", "cube")
    pairs = found.join(spots.select(place, "lon", "lat", F.inline(_levels())), ["level", "cube"])
    meters = F.round(geo.haversine(F.col("lon1"), F.col("lat1"), F.col("lon"), F.col("lat")), 3)
    best = _first(pairs.select("lon1", "lat1", place, meters.alias("meters")), ["lon1", "lat1"], ["meters", place], k, "rank")
    rows = queries.select(F.col(key), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    return rows.join(best, ["lon1", "lat1"]).select(key, F.col("rank").cast("bigint").alias("rank"), place, "meters")
