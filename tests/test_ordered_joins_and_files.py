"""Joins in order, frames, sketches and files against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from trackweave.operators import asof, frames
from trackweave.sinks import files
from trackweave.sources import gpx


def test_asof_and_intervals(spark):
    rng = random.Random(2)
    left = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(400), i) for i in range(300)]
    right = [(rng.choice([1, 2, None]), rng.randrange(400), i) for i in range(60)]
    until = {i: t + rng.randrange(1, 30) for _, t, i in right}
    df, other = spark.createDataFrame(left, "k int, t int, a int"), spark.createDataFrame([(*r, until[r[2]]) for r in right], "k int, t int, b int, until int")
    for width in (7, 1000):
        cut = lambda t, w=width: F.floor(t / w)
        want = {}
        for k, t, a in left:
            own = sorted((x[1], x[2]) for x in right if x[0] == k and x[1] <= t)
            want[a] = own[-1][1] if own else None
        assert {r.a: r.b for r in asof.asof(df, other, ["k"], "t", cut, ("b",)).collect()} == want
        force = {a: b if b is not None and t < until[b] else None for (_, t, a), b in ((x, want[x[2]]) for x in left)}
        assert {r.a: r.b for r in asof.in_force(df, other, ["k"], "t", "until", cut, ("b",)).collect()} == force
        pairs = sorted((a, b) for k, t, a in left for j, s, b in right if k == j and k is not None and s <= t < until[b])
        got = asof.within(df, other.withColumnRenamed("t", "s"), ["k"], "t", "s", "until", cut)
        assert sorted((r.a, r.b) for r in got.collect()) == pairs


def test_frames_over_distance(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(3000), rng.randrange(100), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, at int, v int, i int")
    for width in (None, 100, 5000):
        got = {r.i: r.s for r in frames.over_distance(df, ["g"], "at", 100, {"s": F.sum("v")}, width).collect()}
        assert got == {i: sum(y[2] for y in rows if y[0] == g and at - 100 <= y[1] <= at) for g, at, _, i in rows}


def test_quantiles_are_near(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"r{i % 5}", i % 2, i // 500, rng.expovariate(1)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "r string, s int, part int, v double")
    got = frames.quantile_sketches(df, ["r", "s"], F.col("v"), "part").select("r", "s", frames.quantile("sketch", 0.5).alias("m"), frames.quantile("sketch", 0.95).alias("h")).collect()
    assert len(got) == 6 * 2 + 6 + 1
    for row in got:
        own = sorted(v for r, s, _, v in rows if row.r in (None, r) and row.s in (None, s))
        for q, v in ((0.5, row.m), (0.95, row.h)):
            assert abs(bisect.bisect(own, v) / len(own) - q) < 0.02


def points(spark, bad=False):
    rows = [(f"r{i}", ["A  B", "A\tB", "a/b <&>", None][i % 4], j, j // 10, 14 + j / 100 + i, 50 + j / 1000) for i in range(8) for j in range(25)]
    df = spark.createDataFrame(rows, "route_id string, name string, i int, part int, lon double, lat double")
    return df.withColumn("lat", F.when(F.col("i") == 24, F.raise_error(F.lit("lost"))).otherwise(F.col("lat"))) if bad else df


def test_gpx_files_come_back(spark, tmp_path):
    path = tmp_path / "out"
    path.mkdir()
    files.write_gpx(points(spark), str(path), ["i"], "part")
    names = sorted(p.name for p in path.iterdir())
    assert names == sorted([f"{n}{k}.gpx" for n, ks in (("A-B", ("", " (1)", " (2)", " (3)")), ("a_b-<&>", ("", " (1)")), ("track", ("", " (1)"))) for k in ks])
    back = gpx.points(spark, str(path)).collect()
    assert sorted((round(p.lon, 6), round(p.lat, 6)) for p in back) == sorted((round(r.lon, 6), round(r.lat, 6)) for r in points(spark).collect())
    for name in {p.file for p in back}:
        own = [p for p in back if p.file == name]
        assert [round((p.lat - 50) * 1000) for p in sorted(own, key=lambda p: p.vertex_idx)] == list(range(25))
    assert {p.name for p in back if "%3C" in p.file or "<" in p.file} == {"a/b <&>"}
    files.write_gpx(points(spark).filter("route_id = 'r2'"), str(path), ["i"], "part", mode="overwrite")
    assert [p.name for p in path.iterdir()] == ["a_b-<&>.gpx"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = tmp_path / "out"
    path.mkdir()
    with pytest.raises(Exception, match="lost"):
        files.write_gpx(points(spark, bad=True), str(path), ["i"], "part")
    assert list(path.iterdir()) == []
    writer = files._Writer(str(path), False)

    def rows():
        yield {"file": "a.gpx", "chunk": 0, "text": "x"}
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(rows())
    writer.abort([None])
    assert list(path.iterdir()) == []
