"""Nearest places against plain Python over all pairs."""

import contextlib
import io
import math
import random

import pytest

from trackweave.operators.nearest import nearest


def meters(a, b):
    up = math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    across = math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    h = up + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * across
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def brute(queries, places, k):
    out = []
    for q, *at in queries:
        if None not in at:
            own = sorted((round(meters(at, p[1:]), 3), p[0]) for p in places if None not in p)[:k]
            out += [(q, n + 1, p, m) for n, (m, p) in enumerate(own)]
    return sorted(out)


def frames(spark, queries, places):
    return spark.createDataFrame(queries, "q int, lon double, lat double"), spark.createDataFrame(places, "p int, lon double, lat double")


def check(spark, queries, places, k):
    q, p = frames(spark, queries, places)
    got = sorted((r.q, r.rank, r.p, r.meters) for r in nearest(q, p, k, "q", "p").collect())
    want = brute(queries, places, k)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 0.002 for g, w in zip(got, want, strict=True))


def scattered(rng, n, first=0):
    return [(first + i, round(rng.uniform(-180, 180), 4), round(math.degrees(math.asin(rng.uniform(-1, 1))), 4)) for i in range(n)]


@pytest.mark.parametrize("k", [1, 4])
def test_whole_sphere(spark, k):
    rng = random.Random(k)
    poles = [(1000, 0.0, 90.0), (1001, 90.0, 89.9), (1002, 180.0, 10.0), (1003, -179.99, 10.0), (1004, 12.0, -90.0)]
    queries = [*scattered(rng, 60), (61, 179.999, 10.0), (62, -90.0, 89.95), (63, 77.0, -89.99), (64, 0.0, 0.0)]
    check(spark, queries, scattered(rng, 400) + poles, k)


def test_clusters_spots_and_ties(spark):
    rng = random.Random(9)
    town = [(500 + i, 14 + rng.gauss(0, 0.01), 50 + rng.gauss(0, 0.01)) for i in range(300)]
    spot = [(2000 - i, 14.0, 50.0) for i in range(50)]
    near = [(3000 + i, 14.0 + i * 1e-5, 50.0) for i in range(20)]
    queries = [(1, 14.0, 50.0), (1, 14.0, 50.0), (2, 14.0, 50.0), (3, 14.02, 50.01), (4, 15.5, 49.0), (5, -100.0, 20.0), (6, None, 1.0), (7, 13.99999, 50.0)]
    check(spark, queries, [*town, *spot, *near, (4000, None, 3.0), (4001, 3.0, None)], 7)


def test_few_places(spark):
    queries = scattered(random.Random(1), 5)
    check(spark, queries, [(1, 10.0, 10.0), (2, -170.0, -10.0)], 5)
    check(spark, queries, [], 5)
    check(spark, [], [(1, 10.0, 10.0)], 5)


def test_plan(spark):
    q, p = frames(spark, scattered(random.Random(2), 20), scattered(random.Random(3), 50))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        nearest(q, p, 3, "q", "p").explain("formatted")
    plan = out.getvalue()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan and "EvalPython" not in plan
