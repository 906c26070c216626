"""Registered queries of whole tracks: layers, logs, snapshots' contents, joins in order. See catalogue for the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import asof, distance, frames, layers, mutations, nearest
from trackweave.plans.catalogue import INTERVAL, RULES, query
from trackweave.sinks import files
from trackweave.sources.documents import table


def drawn(spark, sf_dir):
    """Events as segments of two vertices, by their ids; stress and slope follow the id too."""
    e = table(spark, sf_dir, "events")
    vertex = lambda k: F.array(F.lit(6) + (k % 997) / 1000, F.lit(46) + (k % 991) / 1000)
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("route_id"), F.struct("ts", "event_id").alias("seg_idx"), F.date_trunc("day", "ts").alias("day"), F.col("value").cast("decimal(12,2)").alias("distance"), F.col("event_type").alias("surface"),
        (i % 7).cast("double").alias("stress"), (i % 61 - 30).cast("double").alias("slope"), F.array(vertex(i), vertex(i + 1)).alias("coordinates"),
    )


def _at(k: str) -> tuple[str, str]:
    return f"(6 + ({k}) % 997 / 1000)", f"(46 + ({k}) % 991 / 1000)"


def _case(i: int) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]!r}" for r in RULES) + " END"


(_LON, _LAT), (_LON2, _LAT2) = _at("event_id"), _at("event_id + 1")
_H = f"pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
DRAWN = f"""seg AS (SELECT user_id AS route_id, ts, event_id, date_trunc('day', ts) AS day, CAST(value AS DECIMAL(12,2)) AS distance, event_type AS surface, event_id % 7 AS stress, event_id % 61 - 30 AS slope,
  {_LON} AS lon1, {_LAT} AS lat1, {_LON2} AS lon2, {_LAT2} AS lat2 FROM events)"""
LINES = f"""{DRAWN},
p AS (SELECT *, lag(surface) OVER w AS prev, row_number() OVER w AS n FROM seg WINDOW w AS (PARTITION BY route_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(CASE WHEN n > 1 AND surface IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM p),
piece AS (SELECT route_id, run_id, day, any_value(surface) AS surface, sum(distance) AS d, string_agg('[' || lon1 || ',' || lat1 || '],[' || lon2 || ',' || lat2 || ']', ',' ORDER BY ts, event_id) AS c FROM r GROUP BY route_id, run_id, day),
marked AS (SELECT *, lag(day) OVER w IS NULL AS begins, lead(day) OVER w IS NULL AS ends, sum(d) OVER (PARTITION BY route_id, run_id) AS total FROM piece WINDOW w AS (PARTITION BY route_id, run_id ORDER BY day)),
line AS (SELECT route_id, day, run_id, ends, CASE WHEN begins THEN CASE WHEN run_id > 0 THEN ',' ELSE '' END || '{layers.OPEN}' ELSE ',' END || c
  || CASE WHEN ends THEN ']}},"properties":{{"surfaceSmoothness":"' || surface || '","distance":' || CAST(total AS DOUBLE) || '}}}}' ELSE '' END AS text FROM marked)"""
LINE_CHUNKS = "SELECT route_id, 'line' AS layer, day AS chunk, count(*) FILTER (ends) AS features, string_agg(text, '' ORDER BY run_id) AS text FROM line GROUP BY route_id, day"


@query(
    f"""WITH {LINES},
sign AS (SELECT *, {_case(1)} AS symbol, {_case(2)} AS color, {_case(3)} AS priority, {_case(4)} AS rotation FROM seg),
m AS (SELECT *, 2 * 6371000.0 * atan2(sqrt({_H}), sqrt(1 - ({_H}))) AS meters FROM seg),
a AS (SELECT *, sum(meters) OVER (PARTITION BY route_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS after FROM m),
k AS (SELECT *, after - meters AS before, unnest(range(CAST(floor((after - meters) / {INTERVAL * 10}) AS BIGINT) + 1, CAST(floor(after / {INTERVAL * 10}) AS BIGINT) + 1)) AS marker FROM a),
point AS (
  SELECT route_id, 'symbol' AS layer, day, row_number() OVER (PARTITION BY route_id ORDER BY ts, event_id) AS n,
    '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon2 || ',' || lat2 || ']}},"properties":{{"symbol":"' || symbol || '","color":"' || color || '","rotation":' || rotation || ',"priority":' || priority || '}}}}' AS text
  FROM sign WHERE symbol IS NOT NULL
  UNION ALL
  SELECT route_id, 'marker', day, marker,
    '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || round(lon1 + (lon2 - lon1) * (marker * {INTERVAL * 10} - before) / meters, 6) || ',' || round(lat1 + (lat2 - lat1) * (marker * {INTERVAL * 10} - before) / meters, 6) || ']}},"properties":{{"label":"' || marker * 5 || '"}}}}'
  FROM k)
{LINE_CHUNKS}
UNION ALL SELECT route_id, layer, day, count(*), CASE WHEN min(n) > 1 THEN ',' ELSE '' END || string_agg(text, ',' ORDER BY n) FROM point GROUP BY route_id, layer, day"""
)
def track_layers(spark, sf_dir):
    """The three collections of every user's events, in chunks of a day."""
    return layers.track_layers(drawn(spark, sf_dir), "day", digits=6)


@query(f"""WITH {LINES} SELECT route_id, '{layers.HEAD}' || string_agg(text, '' ORDER BY day, run_id) || '{layers.FOOT}' AS document FROM line GROUP BY route_id""")
def geojson_collection(spark, sf_dir):
    """The chunks of each user's lines, joined to one document."""
    return layers.documents(layers.lines(drawn(spark, sf_dir), "day")).select("route_id", F.col("line").alias("document"))


#: Kinds of log rows by the last digit of the event's id.
_KIND = {0: "delete", 1: "set", 2: "set", 3: "set", 9: "promote"}


def logged(spark, sf_dir):
    """Events as a log of changes to their users' tracks; promotions make keys from 1000000 on."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.lit("field")
    for digit, name in _KIND.items():
        kind = F.when(i % 10 == digit, name).otherwise(kind)
    saved = i % 10 == 9
    row = F.struct(F.concat(F.when(saved, "saved ").otherwise(F.col("event_type")), i.cast("string")).alias("name"), F.when(~saved, F.col("value")).alias("price"), (saved | (i % 3 == 0)).alias("isPermanent"), (saved | (i % 2 == 0)).alias("isVisible"))
    return e.select(i.alias("seq"), kind.alias("kind"), F.col("user_id").alias("id"), F.when(saved, i + 1_000_000).alias("new_id"), F.get(F.array(*map(F.lit, ("name", "price", "isPermanent", "isVisible"))), (i % 4).cast("int")).alias("field"), row.alias("row"))


_GIVES = "kind = 'set' OR kind = 'field' AND field = '{f}'"
_FIELDS = ("name", "price", "isPermanent", "isVisible")


@query(
    f"""WITH l AS (SELECT event_id AS seq, user_id AS id, CASE event_id % 10 {" ".join(f"WHEN {d} THEN '{k}'" for d, k in _KIND.items())} ELSE 'field' END AS kind, event_id + 1000000 AS new_id,
  ['name', 'price', 'isPermanent', 'isVisible'][event_id % 4 + 1] AS field, CASE WHEN event_id % 10 = 9 THEN 'saved ' ELSE event_type END || event_id AS name, value AS price, event_id % 10 = 9 OR event_id % 3 = 0 AS isPermanent, event_id % 10 = 9 OR event_id % 2 = 0 AS isVisible FROM events),
s AS (SELECT *, last_value(CASE WHEN {_GIVES.format(f='price')} THEN price END IGNORE NULLS) OVER w AS had_price, last_value(CASE WHEN {_GIVES.format(f='isPermanent')} THEN isPermanent END IGNORE NULLS) OVER w AS had_permanent
  FROM l WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
a AS (SELECT seq, id, 0 AS step, kind AS says, false AS asks FROM l WHERE kind IN ('set', 'delete') UNION ALL SELECT seq, id, 0, NULL, true FROM s WHERE kind = 'promote' UNION ALL SELECT seq, id, 1, 'delete', false FROM s WHERE kind = 'promote' AND had_permanent IS NOT TRUE),
h AS (SELECT seq, asks, last_value(says IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq, step ROWS UNBOUNDED PRECEDING) AS life FROM a),
o AS (SELECT s.* FROM s JOIN h USING (seq) WHERE h.asks AND h.life = 'set' AND s.kind = 'promote'),
f AS (SELECT seq, id, kind, field, name, price, isPermanent, isVisible FROM l WHERE kind <> 'promote'
  UNION ALL SELECT seq, new_id, 'set', NULL, name, had_price, true, true FROM o
  UNION ALL SELECT seq, id, 'delete', NULL, NULL, NULL, NULL, NULL FROM o WHERE NOT had_permanent),
p AS (SELECT *, lag(kind) OVER (PARTITION BY id ORDER BY seq) AS prev FROM f WHERE kind IN ('set', 'delete')),
t AS (SELECT id, max(seq) FILTER (kind = 'set' AND prev IS DISTINCT FROM 'set') AS ord FROM p GROUP BY id HAVING max_by(kind, seq) = 'set'),
v AS (SELECT id, {", ".join(f"arg_max({f}, seq) FILTER ({_GIVES.format(f=f)}) AS {f}" for f in _FIELDS)} FROM f GROUP BY id)
SELECT id, name, price, isPermanent, isVisible, ord FROM t JOIN v USING (id)"""
)
def tracks_log(spark, sf_dir):
    """The collection after all changes, those of a user spread over buckets of 512."""
    return mutations.fold(logged(spark, sf_dir), width=512)


@query(
    """SELECT e.user_id, e.ts, e.event_id, r.event_id AS error_id, r.value AS error_value
FROM (SELECT * FROM events WHERE event_type <> 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r ON e.user_id = r.user_id AND e.ts >= r.ts"""
)
def last_error(spark, sf_dir):
    """Every other event with the last error of its user at or before it."""
    e, error = table(spark, sf_dir, "events"), F.col("event_type") == "error"
    right = e.filter(error).select("user_id", "ts", F.col("event_id").alias("error_id"), F.col("value").alias("error_value"))
    return asof.asof(e.filter(~error).select("user_id", "ts", "event_id"), right, ["user_id"], "ts", lambda t: F.date_trunc("day", t), ("error_id",))


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS start, epoch_us(ts) + CAST(value * 3600 AS BIGINT) * 1000000 AS over FROM events)
SELECT e.event_id, count(i.event_id) AS n FROM e LEFT JOIN e i ON i.user_id = e.user_id AND e.start >= i.start AND e.start < i.over GROUP BY e.event_id"""
)
def under_way(spark, sf_dir):
    """For each event, those of its user that are then under way, if an event takes as many hours as its value."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", t.alias("start"), (t + F.rint(F.col("value") * 3600).cast("bigint") * 1_000_000).alias("over"))
    rows = asof.within(e.select("user_id", "event_id", F.col("start").alias("moment")), e.filter("event_id IS NOT NULL").select("user_id", "start", "over"), ["user_id"], "moment", "start", "over", lambda m: F.floor(m / 86_400_000_000))
    # rows of one id, or without one, are one row of the result
    each = rows.select("event_id", F.lit(1).alias("n")).unionByName(e.select("event_id", F.lit(0).alias("n")))
    return each.groupBy("event_id").agg(F.sum("n").alias("n"))


@query(
    """WITH m AS (SELECT user_id AS route_id, event_id, event_id % 61 - 30 AS slope, CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 100 AS BIGINT) AS place FROM events)
SELECT route_id, event_id, round(CAST(sum(slope) OVER w AS DOUBLE) / count(*) OVER w, 9) AS slope, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY route_id ORDER BY place RANGE BETWEEN 50000 PRECEDING AND CURRENT ROW)"""
)
def slope_of_last_500(spark, sf_dir):
    """Mean slope of the last 500 m before the end of each segment."""
    s = drawn(spark, sf_dir).withColumns({"event_id": F.col("seg_idx.event_id"), "slope": F.col("slope").cast("bigint")})
    rows = distance.running_distance(s, ["seg_idx"], "day").withColumn("place", (F.col("after") * 100).cast("bigint"))
    out = frames.over_distance(rows.select("route_id", "event_id", "place", "slope"), ["route_id"], "place", 50_000, {"total": F.sum("slope"), "n": F.count("*")})
    return out.select("route_id", "event_id", F.round(F.col("total").cast("double") / F.col("n"), 9).alias("slope"), "n")


@query()
def slope_quantiles(spark, sf_dir):
    """Sketched quantiles of the distance of segments: of each user's surface, each user, and all."""
    sketches = frames.quantile_sketches(drawn(spark, sf_dir), ["route_id", "surface"], F.col("distance").cast("double"), "day")
    return sketches.select("route_id", "surface", F.kll_sketch_get_n_double("sketch").alias("n"), *(frames.quantile("sketch", q).alias(f"q{int(100 * q)}") for q in (0.1, 0.5, 0.9)))


def _plain(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


_CHUNK = f"'      <trkpt lat=\"' || {_plain('lat1')} || '\" lon=\"' || {_plain('lon1')} || '\"></trkpt>'"


@query(f"""WITH {DRAWN} SELECT route_id, day, string_agg({_CHUNK}, chr(10) ORDER BY ts, event_id) || chr(10) AS text FROM seg GROUP BY route_id, day""")
def gpx_chunks(spark, sf_dir):
    """The points of each user's document, in chunks of a day, as they go to its file."""
    p = drawn(spark, sf_dir).select("route_id", "seg_idx", "day", F.col("coordinates")[0][0].alias("lon"), F.col("coordinates")[0][1].alias("lat"), F.concat(F.lit("User "), F.col("route_id").cast("string")).alias("name"))
    return files.gpx_chunks(p, ["seg_idx"], "day").filter("chunk.part = 1").select("route_id", F.col("chunk.bucket").alias("day"), "text")


@query("""WITH n AS (SELECT c_custkey AS route_id, row_number() OVER (PARTITION BY c_nationkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS k, c_nationkey FROM customer)
SELECT 'Nation-' || c_nationkey || CASE WHEN n > 1 THEN ' (' || (n - 1) || ')' ELSE '' END || '.gpx' AS file FROM n""")
def file_names(spark, sf_dir):
    """Files of tracks of which many have one name."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route_id"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("name"))
    return files.file_names(t, ".gpx").select("file")


_SPREAD = "({id} * {a} % 36000) / 100 - 180 AS lon{n}, ({id} * {b} % 17000) / 100 - 85 AS lat{n}"


@query(
    f"""WITH q AS (SELECT s_suppkey, {_SPREAD.format(id="s_suppkey", a=7127, b=3571, n=1)} FROM supplier), p AS (SELECT c_custkey, {_SPREAD.format(id="c_custkey", a=7919, b=4801, n=2)} FROM customer),
d AS (SELECT s_suppkey, c_custkey, round(2 * 6371000.0 * atan2(sqrt({_H}), sqrt(1 - ({_H}))), 3) AS meters FROM q, p)
SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY meters, c_custkey) AS rank, c_custkey, meters FROM d QUALIFY rank <= 5"""
)
def nearest_places(spark, sf_dir):
    """The five nearest customers of every supplier, both spread over the globe by their keys."""
    spread = lambda t, k, a, b: table(spark, sf_dir, t).select(k, ((F.col(k) * a % 36000) / 100 - 180).alias("lon"), ((F.col(k) * b % 17000) / 100 - 85).alias("lat"))
    return nearest.nearest(spread("supplier", "s_suppkey", 7127, 3571), spread("customer", "c_custkey", 7919, 4801), 5, "s_suppkey", "c_custkey")
