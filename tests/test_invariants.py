"""Properties that hold for any route."""

import random

from pyspark.sql import functions as F

from trackweave.operators import collections as coll
from trackweave.operators import distance, geometry, runs, sorting


def segments(spark, seed):
    rng = random.Random(seed)
    rows = [(r, i, rng.choice(["A", "B", "C", None]), rng.randrange(1, 4000), i // 8) for r in range(12) for i in range(rng.randrange(1, 60))]
    return rows, spark.createDataFrame(rows, "route_id bigint, seg_idx int, surface string, distance bigint, part int")


def test_runs_and_markers(spark):
    for seed in (1, 2):
        rows, df = segments(spark, seed)
        got = runs.surface_runs(df, ["seg_idx"], "part").collect()
        for route in {r[0] for r in rows}:
            own = sorted((g for g in got if g.route_id == route), key=lambda g: g.run_id)
            assert [g.run_id for g in own] == list(range(len(own)))
            assert all(a.surface != b.surface for a, b in zip(own, own[1:], strict=False))
            total = sum(r[3] for r in rows if r[0] == route)
            assert sum(g.distance for g in own) == total and sum(g.n_segments for g in own) == sum(r[0] == route for r in rows)
        marks = distance.distance_markers(distance.running_distance(df, ["seg_idx"], "part")).collect()
        assert all(0 < m.share <= 1 for m in marks)
        for route in {r[0] for r in rows}:
            assert sorted(m.marker for m in marks if m.route_id == route) == list(range(1, sum(r[3] for r in rows if r[0] == route) // 5000 + 1))


def test_boxes_hold_every_vertex(spark):
    rng = random.Random(3)
    pts = [(rng.randrange(5), rng.uniform(-10, 10), rng.uniform(-10, 10)) for _ in range(200)]
    boxes = {b.route_id: b for b in geometry.bounding_boxes(spark.createDataFrame(pts, "route_id int, lon double, lat double")).collect()}
    assert all(boxes[r].min_lon <= x <= boxes[r].max_lon and boxes[r].min_lat <= y <= boxes[r].max_lat for r, x, y in pts)


def test_sort_directions_agree_up_to_ties(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(60)], "ord int, k int")
    keys = {"k": F.col("k"), "date": F.col("ord")}
    place = lambda d: {r.ord: r.pos for r in sorting.positions(df, sorting.ordering(keys, sorting.Sort("k", d))).collect()}
    up, down = place("asc"), place("desc")
    assert sorted(up.values()) == list(range(1, 61))
    for i in range(60):
        for j in range(60):
            if (i * 7) % 5 != (j * 7) % 5:
                assert (up[i] < up[j]) == (down[i] > down[j])
            elif i < j:
                assert up[i] < up[j] and down[i] < down[j]
    assert sorting.positions(df.limit(0), [F.col("k")]).collect() == []


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(i, f"v{i}", i) for i in range(20)], "id int, v string, ord bigint")
    c = spark.createDataFrame([(i, f"w{i}", i) for i in range(10, 30)], "id int, v string, ord bigint")
    once = coll.upsert(t, c)
    twice = coll.upsert(once, c)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
