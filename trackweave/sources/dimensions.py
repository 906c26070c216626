"""Fixed tables: surfaces, bicycle types, default settings and built-in profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators.symbols import SURFACES
from trackweave.schemas import PROFILE, SETTINGS_FIELDS

# Bicycle type codes and labels.
BIKE_TYPES = {
    "CITY_BIKE": "City Bike", "ROAD_BIKE": "Road Bike", "MOUNTAIN_BIKE": "Mountain Bike", "HYBRID_BIKE": "Hybrid Bike", "FOLDING_BIKE": "Folding Bike",
    "ELECTRIC_BIKE": "E-Bike", "CARGO_BIKE": "Cargo Bike", "FIXIE_BIKE": "Fixie Bike", "GRAVEL_BIKE": "Gravel Bike", "RECUMBENT_BIKE": "Recumbent Bike",
    "ELECTRIC_CITY_BIKE": "E-City Bike", "ELECTRIC_ROAD_BIKE": "E-Road Bike", "ELECTRIC_FOLDING_BIKE": "E-Folding Bike", "ELECTRIC_CARGO_BIKE": "E-Cargo Bike",
    "ELECTRIC_FIXIE_BIKE": "E-Fixie Bike", "ELECTRIC_HYBRID_BIKE": "E-Hybrid Bike", "ELECTRIC_GRAVEL_BIKE": "E-Gravel Bike",
    "ELECTRIC_RECUMBENT_BIKE": "E-Recumbent Bike", "SCOOTER": "Scooter", "BIG_WHEEL_SCOOTER": "Big Wheel Scooter", "ELECTRIC_SCOOTER": "E-Scooter",
}
# Settings of a request that says nothing else.
DEFAULT_SETTINGS = {
    "bikeType": "GRAVEL_BIKE", "averageSpeed": 20.0, "allowedTransportModes": ["BIKE"], "stairs": "AVOID_IF_POSSIBLE", "pavements": "AVOID_IF_POSSIBLE",
    "oneways": "AVOID_IF_POSSIBLE", "traffic": "AVOID_IF_REASONABLE", "surface": "IGNORE", "climbs": "IGNORE", "bikeSharingProvidersIds": [],
    "addRouteGeoJson": True, "optimizeWaypointOrder": True,
}
SETTINGS_NAMES = [*DEFAULT_SETTINGS, "desiredLengthMeters"]
# The built-in profiles, by what differs from the defaults.
BUILT_IN = (
    {"id": "gravel-adventure", "name": "Gravel Adventure", "description": "For the adventurous gravel cyclist who loves unpaved roads.", "isDefault": True, "surface": "AVOID_BAD_SMOOTHNESS_ONLY", "traffic": "AVOID_IF_POSSIBLE", "climbs": "AVOID_IF_REASONABLE"},
    {"id": "relaxed-road-trip", "name": "Relaxed Road Trip", "description": "A comfortable ride on smooth surfaces, avoiding traffic and steep climbs.", "isDefault": False, "bikeType": "HYBRID_BIKE", "surface": "AVOID_NON_SMOOTH", "traffic": "AVOID_IF_POSSIBLE", "climbs": "AVOID_IF_POSSIBLE", "averageSpeed": 18.0, "stairs": "STRICTLY_AVOID"},
    {"id": "urban-commuter", "name": "Urban Commuter", "description": "A fast and efficient ride for city commuting.", "isDefault": False, "bikeType": "CITY_BIKE", "surface": "AVOID_NON_SMOOTH", "averageSpeed": 15.0},
)


def surfaces(spark: SparkSession) -> DataFrame:
    """(surface, color, label), 9 rows."""
    return spark.createDataFrame(list(SURFACES), "surface string, color string, label string")


def bike_types(spark: SparkSession) -> DataFrame:
    """(code, label), 21 rows."""
    return spark.createDataFrame(list(BIKE_TYPES.items()), "code string, label string")


def default_settings() -> Column:
    """The default settings as a struct, desiredLengthMeters null."""
    kinds = dict(x.strip().split(" ", 1) for x in SETTINGS_FIELDS.split(","))
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.struct(*(value(DEFAULT_SETTINGS.get(n)).cast(kinds[n]).alias(n) for n in SETTINGS_NAMES))


def built_in_profiles(spark: SparkSession) -> DataFrame:
    """The three built-in profiles with ord 0 to 2."""
    rows = [DEFAULT_SETTINGS | {"isCustom": False, "desiredLengthMeters": None} | p | {"ord": i} for i, p in enumerate(BUILT_IN)]
    names = [x.strip().split(" ")[0] for x in f"{PROFILE}, ord bigint".split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], f"{PROFILE}, ord bigint")


def with_bike_type(df: DataFrame, spark: SparkSession, code: str = "bikeType") -> DataFrame:
    """df with bike_label: the label of its bike code, or the code itself where there is none."""
    dim = bike_types(spark).toDF("__code", "bike_label")
    return df.join(F.broadcast(dim), F.col(code) == F.col("__code"), "left").withColumn("bike_label", F.coalesce("bike_label", code)).drop("__code")


def with_surface(df: DataFrame, spark: SparkSession, surface: str = "surface") -> DataFrame:
    """df with color and label of its surface; unknown ones get the colour of UNKNOWN and no label."""
    from trackweave.operators.symbols import DEFAULT_COLOR

    dim = surfaces(spark).withColumnRenamed("surface", surface)
    return df.join(F.broadcast(dim), surface, "left").withColumn("color", F.coalesce("color", F.lit(DEFAULT_COLOR)))
