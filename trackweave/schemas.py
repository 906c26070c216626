"""Explicit schemas of the documents. Numbers are doubles: the contract never promises integers.

A geometry's coordinates are a variant, as a line nests them two deep and a multi-line three deep.
Fixed values: all field names, which the documents give.
"""

from __future__ import annotations

POINT = "struct<lat: double, lon: double>"
LOCATION = f"struct<locationType: string, point: {POINT}>"
ELEVATED = "struct<lat: double, lon: double, elevationMeters: double>"
WARNED = "struct<lat: double, lon: double, elevationMeters: double, warning: struct<type: string, properties: struct<length: string, stress: string>>>"

SETTINGS_FIELDS = (
    "bikeType string, averageSpeed double, allowedTransportModes array<string>, stairs string, pavements string, oneways string, traffic string, "
    "surface string, climbs string, bikeSharingProvidersIds array<string>, addRouteGeoJson boolean, optimizeWaypointOrder boolean, desiredLengthMeters double"
)
SETTINGS = "struct<" + ", ".join(x.strip().replace(" ", ": ", 1) for x in SETTINGS_FIELDS.split(",")) + ">"

REQUEST = f"struct<client: string, origin: {LOCATION}, destination: {LOCATION}, waypoints: array<{LOCATION}>, settings: {SETTINGS}, departureDateTime: string, requestType: string>"

LEG_STATS = (
    "distanceMeters", "durationSeconds", "elevationGainMeters", "elevationDropMeters", "bikeConvenience", "bikeFriendlyRoutesPercentage",
    "userSettingsMatch", "physicalEffortKj", "smoothness", "traffic", "slopePercent", "steepSlopesPercentage", "safetyScore",
)
ROUTE_STATS = (*LEG_STATS, "walkConvenience", "walkFriendlyRoutesPercentage", "emissionsGramsCo2")


def _numbers(names: tuple[str, ...]) -> str:
    return "struct<" + ", ".join(f"{n}: double" for n in names) + ">"


INSTRUCTION = "struct<manoeuvre: string, streetName: string, htmlInstruction: string, bicycleRouteName: string>"
STEP = f"struct<start: {WARNED}, end: {ELEVATED}, via: array<{WARNED}>, distanceMeters: double, durationSeconds: double, instruction: {INSTRUCTION}>"
LEG = f"struct<id: double, mode: string, start: {ELEVATED}, end: {ELEVATED}, stats: {_numbers(LEG_STATS)}, steps: array<{STEP}>>"
PROPERTIES = "struct<mode: string, stress: double, slope: double, distance: double, popularity: double, surfaceSmoothness: string, water: double, greenery: double, settingsMatch: boolean>"
FEATURE = f"struct<type: string, geometry: struct<type: string, coordinates: variant>, properties: {PROPERTIES}>"
#: A collection or, with geometry and properties instead of features, one feature.
COLLECTION = f"struct<type: string, features: array<{FEATURE}>, geometry: struct<type: string, coordinates: variant>, properties: {PROPERTIES}>"
#: Six of these are numbers written as text.
EXTRAS = (
    "struct<highwayPercentage: string, greenDistance: string, waterPercentage: string, highwayDistance: string, consumedEnergyWh: double, greenPercentage: string, "
    "scenic: double, routeCreatedBy: string, mappings: array<string>, costModel: string, waterDistance: string>"
)
EXTRA_NUMBERS = ("highwayPercentage", "greenDistance", "waterPercentage", "highwayDistance", "greenPercentage", "waterDistance")
ROUTE = (
    f"struct<id: double, type: string, labels: array<string>, start: {ELEVATED}, end: {ELEVATED}, stats: {_numbers(ROUTE_STATS)}, legs: array<{LEG}>, "
    f"boundingBox: struct<topLeft: {POINT}, bottomRight: {POINT}>, geoJson: {COLLECTION}, dummyMap: {EXTRAS}>"
)
RESPONSE = f"id string, responseType string, status string, creationTimestamp string, url string, region string, request {REQUEST}, routes array<{ROUTE}>"

APP_STATS = "struct<distanceMeters: double, durationSeconds: double, elevationGainMeters: double, elevationDropMeters: double, userSettingsMatch: double, safetyScore: double, bikeFriendlyRoutesPercentage: double>"
APP_ROUTE = f"struct<id: string, geojson: {COLLECTION}, stats: {APP_STATS}, labels: array<string>, routeIndex: bigint, name: string, color: string>"
WAYPOINT = "struct<id: string, lng: double, lat: double>"
TRACK = f"id string, name string, waypoints array<{WAYPOINT}>, route {APP_ROUTE}, createdAt string, isPermanent boolean, color string, isVisible boolean"
PROFILE = f"id string, name string, description string, isDefault boolean, isCustom boolean, {SETTINGS_FIELDS}"
