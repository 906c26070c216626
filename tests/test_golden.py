"""Hand-computed cases of the route operators."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trackweave.functions import checks, geo, keys, text
from trackweave.operators import collections as coll
from trackweave.operators import distance, geometry, ordered, routes, runs, sorting, statistics, symbols
from trackweave.sinks import exports
from trackweave.sources import dimensions, documents


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def segs(spark, rows):
    return spark.createDataFrame(rows, "route_id string, seg_idx int, surface string, distance double, coordinates array<array<double>>")


def test_missing_surfaces_merge_and_first_row_starts_a_run(spark):
    rows = [("r", 0, None, 1.0, None), ("r", 1, None, 2.0, [[1.0, 2.0]]), ("r", 2, "A", 3.0, [[1.0, 2.0], [3.0, 4.0]]), ("r", 3, "A", None, []), ("r", 4, None, 5.0, [[9.0, 9.0]])]
    got = {r.run_id: (r.surface, r.distance, r.n_segments) for r in runs.surface_runs(segs(spark, rows), ["seg_idx"]).collect()}
    assert got == {0: (None, 3.0, 2), 1: ("A", 3.0, 2), 2: (None, 5.0, 1)}
    paths = {r.run_id: r.coordinates for r in runs.run_coordinates(segs(spark, rows), ["seg_idx"]).collect()}
    assert paths == {0: [[1, 2]], 1: [[1, 2], [3, 4]], 2: [[9, 9]]}
    assert runs.surface_runs(segs(spark, []), ["seg_idx"]).collect() == []


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_buckets_change_nothing(spark, width):
    rows = [(i % 3 if i % 11 else None, i, "ABCA"[(i // 5) % 4] if i % 7 else None, float(i % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "route_id bigint, seg_idx int, surface string, distance double").withColumn("part", F.floor(F.col("seg_idx") / width))
    for f in (lambda d, b: runs.numbered(d, ["seg_idx"], b).select("seg_idx", "run_id"), lambda d, b: distance.running_distance(d, ["seg_idx"], b).select("seg_idx", "after"), lambda d, b: ordered.with_previous(d, ["route_id"], ["seg_idx"], F.col("surface"), "p", b).select("seg_idx", "p")):
        assert sorted(map(repr, f(df, None).collect())) == sorted(map(repr, f(df, "part").collect()))


def test_markers(spark):
    m = spark.createDataFrame([("exact", 4000.0, 5000.0), ("several", 0.0, 12000.0), ("start", 5000.0, 6000.0), ("still", 5000.0, 5000.0)], "id string, before double, after double").withColumn("distance", F.expr("after - before"))
    got = sorted((r.id, r.marker, round(r.share, 6)) for r in distance.distance_markers(m).collect())
    assert got == [("exact", 1, 1.0), ("several", 1, round(5 / 12, 6)), ("several", 2, round(10 / 12, 6))]


def test_marker_positions_and_lengths(spark):
    line = [[0.0, 0.0], [0.1, 0.0], [0.1, 0.0]]
    f = segs(spark, [("r", 0, "A", 0.0, line), ("r", 1, "A", 0.0, [[5.0, 0.0], [5.05, 0.0]]), ("r", 2, "A", 0.0, [[1.0, 1.0]])])
    step = 6_371_000 * math.radians(0.1)
    assert math.isclose(distance.route_lengths(f).first().meters, step * 1.5, rel_tol=1e-9)
    got = sorted((r.marker, r.label, r.lon) for r in distance.route_markers(f, bucket="seg_idx").collect())
    assert [(m, label) for m, label, _ in got] == [(1, "5"), (2, "10"), (3, "15")]
    assert math.isclose(got[0][2], 0.1 * 5000 / step) and math.isclose(got[2][2], 5 + 0.1 * (15000 - step) / step)


@pytest.mark.parametrize(
    ("stress", "slope", "want"),
    [(5, 30, ("car", "#e205c4", 0, 0)), (4, 0, ("car", "#ea5fa4", 0, 0)), (3, -30, ("car", "#eab35a", 10, 0)), (2.9, 20, ("chevron_3", "#ea5fa4", 20, 0)), (1, 20.1, ("chevron_4", "#e205c4", 20, 0)), (1, -20.1, ("chevron_4", "#e205c4", 20, 180)),
     (1, 15, ("chevron_2", "#ed8c82", 30, 0)), (1, -10, ("chevron_1", "#eab35a", 30, 180)), (1, 6, ("chevron_1", "#e2d705", 30, 0)), (1, 4, None), (None, -4.5, ("chevron_1", "#e2d705", 30, 180)), (None, None, None)],
)
def test_symbols(spark, stress, slope, want):
    got = one(spark, symbols.symbol(F.lit(stress).cast("double"), F.lit(slope).cast("double")).alias("s")).s
    assert (tuple(got) if got else None) == want


def test_middle_vertex(spark):
    for n, want in ((0, None), (1, 0), (2, 1), (5, 2), (6, 3)):
        c = F.array(*(F.array(F.lit(float(i)), F.lit(0.0)) for i in range(n))).cast("array<array<double>>")
        got = one(spark, geo.mid_vertex(c).alias("m")).m
        assert (got[0] if got else None) == want


def test_display_text(spark):
    value = lambda x: F.lit(x).cast("double")
    cases = [
        (text.distance_text(value(14934)), "14.9km"), (text.distance_text(value(1450)), "1.4km"), (text.distance_text(value(250)), "0.3km"), (text.distance_text(value(0)), "N/A"), (text.distance_text(value(0), False), "0.0km"), (text.distance_text(value(None), False), "N/A"),
        (text.duration_text(value(5205)), "87min"), (text.duration_text(value(0)), "N/A"), (text.gain_text(value(87)), "↗87m"), (text.gain_text(value(0), False), "↗0m"),
        (text.match_text(value(0)), "0%"), (text.match_text(value(55.5)), "55.5%"), (text.match_text(value(None)), "N/A"), (text.js_round(value(-0.5)).cast("string"), "0"), (text.slug(F.lit("a  b\tc")), "a-b-c"), (text.escaped(F.lit("a<&>")), "a&lt;&amp;&gt;"),
        (text.plain_number(value(0.0001)), "0.0001"), (text.plain_number(value(46)), "46"), (text.date_text(F.lit("2026-03-04").cast("timestamp")), "03/04/26"),
    ]
    row = one(spark, *(c.alias(f"c{i}") for i, (c, _) in enumerate(cases)))
    assert list(row)[:9] == [w for _, w in cases][:9] and [x for x, (_, w) in zip(row, cases, strict=True) if not (x == w or (w == "0.0001" and x.startswith("0.0001")))] == []


def test_checks_and_colours(spark):
    row = one(spark, checks.is_hex_color(F.lit("#aBc123")).alias("a"), checks.is_hex_color(F.lit("#abc12")).alias("b"), checks.has_name(F.lit("  ")).alias("c"), checks.is_search_term(F.lit(" abc ")).alias("d"), checks.circular_meters(F.lit(50)).alias("e"), checks.circular_meters(F.lit(9)).alias("f"), keys.color_or_hash(F.lit(""), F.lit("ab")).alias("g"), keys.color_or_hash(F.lit("#1"), F.lit("ab")).alias("h"), keys.route_color(F.lit(9)).alias("i"))
    assert tuple(row) == (True, False, False, True, 50_000.0, None, keys.HASH_COLORS[(97 + 98) % 8], "#1", "#EF4444")


def test_sort_states():
    s = sorting.Sort()
    s = sorting.clicked(s, "name")
    assert s == ("name", "asc")
    s = sorting.clicked(s, "name")
    assert s == ("name", "desc")
    s = sorting.clicked(s, "name")
    assert s == (None, "none") and sorting.clicked(s, "name") == ("name", "asc")


def track(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, createdAt string, isPermanent boolean, ord bigint, isVisible boolean, color string, waypoints array<struct<id:string,lng:double,lat:double>>, route struct<stats:struct<distanceMeters:double,durationSeconds:double,elevationGainMeters:double,userSettingsMatch:double>>")


def test_sort_and_list(spark):
    stats = lambda d: ((d, d, d, d),)
    t = track(spark, [("a", "Zed", "2026-01-02T00:00:00.000Z", True, 0, None, None, [("w", 1.0, 2.0)], stats(5.0)), ("b", "amy", "2026-01-03T00:00:00.000Z", False, 1, True, "", [], stats(None)), ("c", "Bob", "2026-01-01T00:00:00.000Z", True, 2, False, "#123456", None, stats(5.0))])
    order = lambda *s: [r.id for r in sorting.sorted_tracks(t, sorting.Sort(*s)).collect()]
    assert order() == ["b", "a", "c"] and order("name", "asc") == ["b", "c", "a"]
    assert order("distance", "desc") == ["a", "c", "b"] and order("distance", "asc") == ["b", "a", "c"]
    assert order("saved", "desc") == ["a", "c", "b"] and order(None, "none") == ["b", "a", "c"]
    rows = {r.id: r for r in routes.list_rows(t).collect()}
    assert rows["b"].distance == "N/A" and rows["a"].distance == "0.0km" and rows["c"].color == "#123456" and rows["a"].date == "01/02/26"
    assert tuple(coll.counts(t).first()) == (3, 2, 1, 1, 1)


def test_collections(spark):
    t = spark.createDataFrame([("a", "1", 0), ("b", "2", 1)], "id string, v string, ord bigint")
    c = spark.createDataFrame([("b", "3", 0), ("c", "4", 1), ("b", "5", 2)], "id string, v string, ord bigint")
    up = coll.upsert(t, c)
    want = [("a", "1", 0), ("b", "5", 1), ("c", "4", 3)]
    assert sorted(map(tuple, up.collect())) == want
    again = [r[:2] for r in map(tuple, coll.upsert(up, c).collect())]
    assert sorted(again) == [r[:2] for r in want]
    assert sorted(map(tuple, coll.upsert(t.limit(0), c).collect())) == [("b", "5", 0), ("c", "4", 1)]
    assert [r.id for r in coll.delete(t, c).collect()] == ["a"]
    upd = spark.createDataFrame([("b", None), ("x", "9")], "id string, v string")
    assert sorted(map(tuple, coll.update_if_present(t, upd).collect())) == [("a", "1", 0), ("b", None, 1)]
    assert sorted(map(tuple, coll.overlay(t, upd).select("id", "v").collect())) == [("a", "1"), ("b", "2")]


DOC = {
    "id": "resp", "status": "OK", "routes": [
        {"id": 1, "labels": ["FAST", "ALTERNATIVE"], "stats": {"distanceMeters": 14934, "durationSeconds": 5205, "elevationGainMeters": 87, "userSettingsMatch": 0}, "dummyMap": {"highwayPercentage": "12.5", "waterDistance": "n/a"},
         "boundingBox": {"topLeft": {"lat": 50.2, "lon": 14.1}, "bottomRight": {"lat": 50.0, "lon": 14.5}},
         "legs": [{"mode": "BIKE", "stats": {"distanceMeters": 27}, "steps": [{"distanceMeters": 27, "durationSeconds": 6, "start": {"lat": 1, "lon": 2, "warning": {"type": "X", "properties": {"length": "3.5", "stress": "bad"}}}, "via": [{"lat": 1, "lon": 2, "elevationMeters": 5}, {"lat": 1, "lon": 3, "elevationMeters": 9}], "instruction": {"manoeuvre": "LEFT", "streetName": "Main"}}]}],
         "geoJson": {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[14.1, 50.1], [14.2, 50.2]]}, "properties": {"stress": 2, "slope": 0, "distance": 27, "surfaceSmoothness": "PAVED_EXCELLENT"}}]}},
        {"id": 2, "labels": []},
        {"id": 3, "geoJson": {"features": []}, "stats": {}},
    ]}


@pytest.fixture
def responses(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(DOC, indent=1))
    (tmp_path / "bad.json").write_text("{broken")
    return documents.responses(spark, str(tmp_path))


def test_flattening(spark, responses):
    assert responses.count() == 1
    rows = {r.route_idx: r for r in routes.routes_table(responses).collect()}
    assert len(rows) == 3 and rows[0].distanceMeters == 14934 and rows[0].highwayPercentage == 12.5 and rows[0].waterDistance is None and rows[0].top_left_lat == 50.2
    step = routes.steps_table(responses).first()
    assert step.streetName == "Main" and step.warning_length == 3.5 and step.warning_stress is None
    assert routes.via_table(responses).count() == 2 and routes.legs_table(responses).count() == 1
    seg = routes.segments_table(responses).collect()
    assert [(s.route_id, s.surface, s.distance) for s in seg] == [("resp/0", "PAVED_EXCELLENT", 27)]
    assert symbols.route_symbols(routes.segments_table(responses)).count() == 0
    app = {r.routeIndex: r for r in routes.app_routes(responses, F.lit(7)).collect()}
    assert set(app) == {0, 2} and app[0].name == "FAST, ALTERNATIVE" and app[2].name == "Route 3" and app[2].id == "route-7-2" and app[2].color == "#10B981"
    temp = routes.temporary_tracks(routes.app_routes(responses, F.lit(7)), F.array(), F.lit(8), F.lit("2026-01-01").cast("timestamp")).collect()
    assert {t.id for t in temp} == {"temp-8-0", "temp-8-2"} and temp[0].createdAt == "2026-01-01T00:00:00.000Z"


def test_requests(spark):
    p = spark.createDataFrame([("r", 0, 1.0, 2.0), ("r", 1, 3.0, 4.0), ("r", 2, 5.0, 6.0), ("s", 0, 7.0, 8.0)], "route_id string, ord int, lat double, lon double")
    rows = {r.route_id: r for r in geometry.first_last_via(p, ["ord"]).collect()}
    assert tuple(rows["r"].origin) == (1, 2) and tuple(rows["r"].destination) == (5, 6) and [tuple(v) for v in rows["r"].via] == [(3, 4)] and rows["s"].via == []
    circular = {r.route_id: r for r in geometry.first_last_via(p, ["ord"], circular=True).collect()}
    assert circular["r"].destination == circular["r"].origin and len(circular["r"].via) == 2
    over = F.struct(*(F.lit("ROAD_BIKE" if n == "bikeType" else None).cast("string").alias(n) if n == "bikeType" else dimensions.default_settings()[n].alias(n) for n in dimensions.SETTINGS_NAMES))
    got = routes.requests(geometry.first_last_via(p, ["ord"]), F.lit("2026-01-01 10:00:00").cast("timestamp"), over, F.lit(50_000.0)).filter("route_id = 'r'").first().request
    assert got.client == "WEB" and got.origin.locationType == "POINT" and got.settings.bikeType == "ROAD_BIKE" and got.settings.traffic == "AVOID_IF_REASONABLE" and got.settings.desiredLengthMeters == 50_000 and got.departureDateTime == "2026-01-01T10:00:00.000Z"


def test_gpx_and_geojson(spark):
    p = spark.createDataFrame([("r", "A & B", 1, 14.0, 50.5, 0.0), ("r", "A & B", 0, 0.0001, 50.0, 0.0)], "route_id string, name string, i int, lon double, lat double, m double")
    doc = exports.gpx_documents(p, ["i"], F.col("m")).first()
    assert doc.file == "A-&-B.gpx" and "<name>A &amp; B</name>" in doc.document and "Distance: N/A" in doc.document
    assert doc.document.index('lat="50" lon="0.0001') < doc.document.index('lat="50.5" lon="14"')
    f = spark.createDataFrame([("r", 1), ("r", 0)], "route_id string, i int").withColumn("f", exports.feature("Point", F.array(F.lit(1.0)), F.struct("i")))
    assert [x["properties"]["i"] for x in json.loads(exports.collections_of(f, "f", ["i"]).first().document)["features"]] == [0, 1]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "tracks")
    assert documents.tracks(spark, path).count() == 0
    rows = [("a", "A", [], None, "2026-01-01T00:00:00.000Z", True, None, True, 0), ("b", "B", [], None, "2026-01-01T00:00:00.000Z", False, None, True, 1)]
    from trackweave.schemas import TRACK

    t = spark.createDataFrame(rows, f"{TRACK}, ord bigint")
    exports.save_permanent(t, path)
    back = documents.tracks(spark, path).collect()
    assert [(r.id, r.isVisible) for r in back] == [("a", False)]
    exports.clear_saved(t, path)
    assert documents.tracks(spark, path).count() == 0


def test_profiles_and_dimensions(spark):
    rows = {r.id: r for r in dimensions.built_in_profiles(spark).collect()}
    assert rows["gravel-adventure"].isDefault and rows["relaxed-road-trip"].stairs == "STRICTLY_AVOID" and rows["urban-commuter"].averageSpeed == 15
    assert dimensions.surfaces(spark).count() == 9 and dimensions.bike_types(spark).count() == 21


def test_statistics(spark):
    s = spark.createDataFrame([("r", 7.0, 100.0, 5.0, "UNPAVED_BAD"), ("r", -7.0, 100.0, 1.0, "PAVED_BAD"), ("r", 6.0, 200.0, 1.0, "PAVED_GOOD")], "route_id string, slope double, distance double, stress double, surface string")
    assert statistics.steep_share(s).first().pct == 50 and statistics.mean_slope(s).first().slope == 3 and statistics.high_traffic_share(s).first().pct == 25 and statistics.rough_share(s).first().pct == 50
    e = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 4.0, 2.0])], "route_id string, i int, elevation double")
    assert tuple(statistics.climbs(e, ["i"]).first()) == ("r", 3, 2)


def test_streams(spark, tmp_path):
    from trackweave.streaming import live

    kind = "route_id bigint, ts timestamp, surface string, distance double"
    batches = [[(1, 1, "A", 1.0), (1, 2, "A", 2.0)], [(1, 3, "A", 4.0), (1, 4, None, 8.0), (2, 1, "B", 1.0)], [(1, 5, None, 16.0), (1, 6, "A", 32.0)]]
    src, out = str(tmp_path / "in"), "runs_out"
    query = None
    for b in batches:
        spark.createDataFrame([(r, datetime(2026, 1, 1, 0, t), s, d) for r, t, s, d in b], kind).coalesce(1).write.mode("append").parquet(src)
        if query is None:
            query = live.closed_runs(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format("memory").queryName(out).outputMode("append").start()
        query.processAllAvailable()
    query.stop()
    got = sorted((r.route_id, r.run_id, r.surface, r.distance, r.n_segments) for r in spark.table(out).collect())
    assert got == [(1, 0, "A", 7.0, 3), (1, 1, None, 24.0, 2)]
    static = spark.read.schema(kind).parquet(src)
    assert {r.route_id: r.distance for r in live.totals(static).collect()} == {1: 63.0, 2: 1.0}


def test_an_idle_route_closes_its_run(spark, tmp_path):
    import time

    from trackweave.streaming import live

    kind, src = "route_id bigint, ts timestamp, surface string, distance double", str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame([(1, datetime(2026, 1, 1, 0, t), s, d) for t, s, d in rows], kind).coalesce(1).write.mode("append").parquet(src)
    write([(1, "A", 1.0), (2, "B", 2.0)])
    query = live.closed_runs(spark.readStream.schema(kind).parquet(src), idle_ms=1500).writeStream.format("memory").queryName("idle_out").outputMode("append").start()
    rows = lambda: sorted((r.run_id, r.surface, r.distance, r.total) for r in spark.table("idle_out").collect())

    def wait(n):
        until = time.time() + 60
        while len(rows()) < n and time.time() < until:
            time.sleep(0.3)
        return rows()

    try:
        assert wait(2) == [(0, "A", 1.0, 1.0), (1, "B", 2.0, 3.0)]
        write([(3, "B", 4.0)])
        assert wait(3)[2] == (2, "B", 4.0, 7.0)
    finally:
        query.stop()


def test_multi_lines_keep_all_vertices(spark, tmp_path):
    geometry_of = lambda kind, c: {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": {"surfaceSmoothness": "UNKNOWN", "distance": 1}}
    features = [geometry_of("MultiLineString", [[[14.1, 50.1], [14.2, 50.2]], [[14.3, 50.3]]]), geometry_of("LineString", [[14.4, 50.4], [14.5, 50.5]]), geometry_of("Point", [1, 2]), geometry_of("LineString", [])]
    document = {"id": "r", "routes": [{"id": 1, "geoJson": {"type": "FeatureCollection", "features": features}}]}
    (tmp_path / "r.json").write_text(json.dumps(document))
    responses = documents.responses(spark, f"file://{tmp_path}/r.json")
    segments = routes.segments_table(responses)
    line = geometry.flattened(segments).first().coordinates
    assert line == [[14.1, 50.1], [14.2, 50.2], [14.3, 50.3], [14.4, 50.4], [14.5, 50.5]]
    kept = routes.route_rows(responses).select(F.size(routes.line_features(F.col("route.geoJson.features"))).alias("n")).first().n
    assert kept == 2
    gpx = exports.gpx_documents(geometry.vertices(segments).withColumn("name", F.lit("n")), ["seg_idx", "vertex_idx"]).first().document
    assert gpx.count("<trkpt") == 5
    app = json.loads(responses.select(F.to_json("routes")).first()[0])
    assert app[0]["geoJson"]["features"][0]["geometry"]["coordinates"] == features[0]["geometry"]["coordinates"]


def test_collection_or_null(spark):
    rows = spark.createDataFrame([((["f"],),), ((None,),), (None,)], "d struct<features: array<string>>")
    assert [r[0] is not None for r in rows.select(routes.collection_or_null(F.col("d"))).collect()] == [True, False, False]


def test_gaps_between_lines_are_no_road(spark, tmp_path):
    """Two lines of 0.01 degrees on the equator, a degree apart; and a document that is one feature."""
    line = lambda lon: [[lon, 0.0], [lon + 0.01, 0.0]]
    several = {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [line(14.0), line(15.0)]}, "properties": {"surfaceSmoothness": "UNKNOWN"}}
    alone = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": line(3.0)}, "properties": {"surfaceSmoothness": "PAVED_GOOD", "stress": 4}}
    document = {"id": "r", "routes": [{"geoJson": {"type": "FeatureCollection", "features": [several]}}, {"geoJson": alone}, {"geoJson": {"type": "FeatureCollection"}}]}
    (tmp_path / "r.json").write_text(json.dumps(document))
    segments = routes.segments_table(documents.responses(spark, f"file://{tmp_path}/r.json"))
    step = 6_371_000 * math.radians(0.01)
    got = {r.route_id: r.meters for r in distance.route_lengths(segments).collect()}
    assert set(got) == {"r/0", "r/1"} and math.isclose(got["r/0"], 2 * step, rel_tol=1e-9) and math.isclose(got["r/1"], step, rel_tol=1e-9)
    marks = distance.route_markers(segments, interval=1000, bucket="seg_idx").collect()
    assert sorted((r.route_id, r.marker, round(r.lon, 6)) for r in marks) == [("r/0", 1, round(14 + 10 / step, 6)), ("r/0", 2, round(15 + 0.01 * (2000 - step) / step, 6)), ("r/1", 1, round(3 + 10 / step, 6))]
    assert symbols.route_symbols(segments).first().symbol == "car" and geometry.vertices(segments).filter("route_id = 'r/0'").count() == 4


def test_white_space_of_any_kind(spark):
    for space in ("\t", "\u00a0", "\ufeff", "\u2028 \u3000"):
        row = one(spark, checks.has_name(F.lit(space)).alias("a"), checks.is_search_term(F.lit(f"{space}ab{space}")).alias("b"), text.slug(F.lit(f"a{space}b")).alias("c"), text.trimmed(F.lit(f"{space}a{space}b{space}")).alias("d"))
        assert tuple(row) == (False, False, "a-b", f"a{space}b")
    t = spark.createDataFrame([("a", "x", False)], "id string, name string, isPermanent boolean")
    assert coll.promote_in_place(t, "a", "\u00a0New\t").first().name == "New"


def test_code_units(spark):
    for word in ("", "ab", "\u20ac", "a\U0001f600b", "\U0001f1e9\U0001f1ea"):
        units = word.encode("utf-16-be")
        assert one(spark, keys.code_sum(F.lit(word)).alias("s")).s == sum(units[i] * 256 + units[i + 1] for i in range(0, len(units), 2))


def test_fixed_decimals_are_exact(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(1)
    values = [0.25, 1.45, 2.5, -0.04, 0.05, 1e16, 123456789.05, -2.5, 0.0, *(rng.randrange(10**6) / 100 for _ in range(500)), *(rng.uniform(-1e4, 1e4) for _ in range(300))]
    for digits in (0, 1, 2):
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.fixed(F.col("v"), digits).alias("t")).collect()
        assert [r for r in got if r.t != format(Decimal(r.v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP), "f")] == []


def test_layers_of_a_route(spark):
    """A run over two buckets is one line; a route without symbols has an empty collection; documents parse."""
    from trackweave.operators import layers

    v = lambda i: [i / 100, 0.0]
    rows = [("r", i, i // 2, "AAABBA"[i], float(i), 5.0 if i in (1, 4) else 0.0, 0.0, [v(i), v(i + 1)] if i != 3 else None) for i in range(6)] + [("s", 0, 0, None, 1.0, None, None, [[0.0, 0.0]])]
    df = spark.createDataFrame(rows, "route_id string, seg_idx int, part int, surface string, distance double, stress double, slope double, coordinates array<array<double>>")
    chunks = layers.track_layers(df, "part", interval=2000)
    got = {r.route_id: [json.loads(r[n]) for n in layers.LAYERS] for r in layers.documents(chunks).collect()}
    line, symbol, marker = got["r"]
    assert [(f["properties"], len(f["geometry"]["coordinates"])) for f in line["features"]] == [({"surfaceSmoothness": "A", "distance": 3.0}, 6), ({"surfaceSmoothness": "B", "distance": 7.0}, 2), ({"surfaceSmoothness": "A", "distance": 5.0}, 2)]
    assert line["features"][0]["geometry"]["coordinates"] == [v(0), v(1), v(1), v(2), v(2), v(3)]
    assert [f["geometry"]["coordinates"] for f in symbol["features"]] == [v(2), v(5)] and symbol["features"][0]["properties"] == {"symbol": "car", "color": "#e205c4", "rotation": 0, "priority": 0}
    assert [f["properties"]["label"] for f in marker["features"]] == ["2", "4"]
    assert [len(x["features"]) for x in got["s"]] == [1, 0, 0]
    assert chunks.filter("route_id = 'r' AND layer = 'line'").count() == 3
    plan = layers.lines(df, "part")._jdf.queryExecution().executedPlan().toString()
    assert "pieces" in plan and "seg_idx" not in plan
