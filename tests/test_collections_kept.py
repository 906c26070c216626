"""Logs, snapshots and streams of collections against one row after the other."""

import random

import pytest

from trackweave import snapshots
from trackweave.operators import collections as coll
from trackweave.operators import mutations
from trackweave.sinks import exports
from trackweave.sources import documents

ROW = "name string, price double, isPermanent boolean, isVisible boolean"
LOG = "seq bigint, kind string, id string, new_id string, field string, row struct<name: string, price: double, isPermanent: boolean, isVisible: boolean>"
NAMES = ("name", "price", "isPermanent", "isVisible")


def random_log(seed, n=150, keys=8):
    rng, out, made = random.Random(seed), [], []
    for seq in range(n):
        key = rng.choice([f"k{rng.randrange(keys)}", *made[-3:]])
        kind = rng.choice(["set", "set", "delete", "field", "field", "promote"])
        row = (f"n{seq}", rng.choice([None, float(seq)]), rng.random() < 0.4, rng.random() < 0.5)
        new = field = None
        if kind == "promote":
            new, row = f"p{seq}", (f"saved {seq}", None, True, True)
            made.append(new)
        elif kind == "field":
            field = rng.choice(NAMES)
        elif kind == "delete":
            row = None
        out.append((seq, kind, key, new, field, row))
    return out


def applied(log):
    """The log on a Python dict, which keeps the order in which keys came."""
    rows, place = {}, {}
    for seq, kind, key, new, field, row in log:
        if kind == "set":
            if key not in rows:
                place[key] = seq
            rows[key] = row
        elif key not in rows:
            continue
        elif kind == "delete":
            del rows[key]
        elif kind == "field":
            i = NAMES.index(field)
            rows[key] = (*rows[key][:i], row[i], *rows[key][i + 1 :])
        else:
            old = rows[key]
            rows[new], place[new] = tuple(o if r is None else r for o, r in zip(old, row, strict=True)), seq
            if not old[2]:
                del rows[key]
    return sorted((place[k], k, *v) for k, v in rows.items())


def folded(df):
    return sorted((r.ord, r.id, r.name, r.price, r.isPermanent, r.isVisible) for r in df.collect())


def test_fold(spark):
    for seed, width in ((1, 1 << 16), (2, 7)):
        log = random_log(seed)
        want = applied(log)
        assert folded(mutations.fold(spark.createDataFrame(log, LOG), width=width)) == want and any(r[1][0] == "p" for r in want)
    assert mutations.fold(spark.createDataFrame([], LOG)).collect() == []


def test_fold_over_a_table(spark):
    table = spark.createDataFrame([("a", "A", 1.0, True, True, 0), ("b", "B", 2.0, False, True, 5)], f"id string, {ROW}, ord bigint")
    log = [(0, "set", "b", None, None, ("B2", 3.0, False, True)), (1, "delete", "a", None, None, None), (2, "set", "a", None, None, ("A2", None, True, None)), (3, "promote", "b", "c", None, ("C", None, True, True))]
    got = folded(mutations.fold(mutations.with_table(table, spark.createDataFrame(log, LOG))))
    assert got == [(2, "a", "A2", None, True, None), (3, "c", "C", 3.0, True, True)]


def test_a_hot_key_spreads(spark):
    log = [(i, "field", "hot", None, "price", (None, float(i), None, None)) if i else (0, "set", "hot", None, None, ("h", 0.0, True, True)) for i in range(3000)]
    df = mutations.fold(spark.createDataFrame(log, LOG), width=100)
    assert folded(df) == [(0, "hot", "h", 2999.0, True, True)]


def tracks_of(spark, names):
    from trackweave.schemas import TRACK

    return spark.createDataFrame([(n, n.upper(), [], None, "2026-01-01T00:00:00.000Z", True, None, True, i) for i, n in enumerate(names)], f"{TRACK}, ord bigint")


def test_saved_where_it_was_loaded(spark, tmp_path):
    path = f"file://{tmp_path}/tracks"
    assert exports.save_permanent(tracks_of(spark, "ab"), path, read=0) == 1
    loaded = documents.tracks(spark, path)
    renamed = coll.set_field(loaded, loaded.id == "a", "name", loaded.id)
    assert exports.save_permanent(renamed, path, read=1) == 2
    assert sorted((r.ord, r.name) for r in documents.tracks(spark, path).collect()) == [(0, "a"), (1, "B")]
    # what was opened before stays, and so does the version by its number
    assert sorted(r.name for r in loaded.collect()) == ["A", "B"] and sorted(r.name for r in documents.tracks(spark, path, 1).collect()) == ["A", "B"]
    with pytest.raises(snapshots.Conflict):
        exports.save_permanent(renamed, path, read=1)
    exports.clear_saved(renamed, path)
    assert documents.tracks(spark, path).count() == 0 and snapshots.versions(spark, path) == [1, 2, 3]
    assert snapshots.vacuum(spark, path) == 2 and snapshots.versions(spark, path) == [3]
    with pytest.raises(ValueError):
        documents.tracks(spark, path, 1)


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path):
    from pyspark.sql import functions as F

    path = f"file://{tmp_path}/tracks"
    exports.save_all(tracks_of(spark, "ab"), path)
    broken = documents.tracks(spark, path).withColumn("name", F.when(F.col("id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        exports.save_all(broken, path)
    # one that dies between its files and its rename
    broken.limit(0).write.json(f"{path}/data-abandoned")
    assert snapshots.versions(spark, path) == [1] and documents.tracks(spark, path).count() == 2
    # another writer took the number
    first = snapshots.versions
    snapshots.versions = lambda *_: []
    try:
        with pytest.raises(snapshots.Conflict):
            exports.save_all(tracks_of(spark, "c"), path)
    finally:
        snapshots.versions = first
    assert documents.tracks(spark, path).count() == 2 and snapshots.vacuum(spark, path) == 2 + 1


def test_saved_arrays_keep_their_order(spark, tmp_path):
    import json

    line = {"type": "LineString", "coordinates": [[1.5, 2.0], [3.0, 4.0]]}
    rows = [{"id": f"t{i}", "name": f"N{i}", "isPermanent": True, "isVisible": True, "route": {"geojson": {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": line, "properties": {"stress": 1}}]}}} for i in (3, 1, 2)]
    (tmp_path / "saved.json").write_text(json.dumps(rows) + "\n{broken\n")
    back = documents.tracks(spark, f"file://{tmp_path}/saved.json").orderBy("ord").collect()
    assert [(r.id, r.ord, r.isVisible) for r in back] == [("t3", 0, False), ("t1", 1, False), ("t2", 2, False)]
    assert json.loads(back[0].route.geojson.features[0].geometry.coordinates.toJson()) == line["coordinates"]
    profiles = [{"id": "x", "name": "P", "isCustom": True, "averageSpeed": 20}]
    (tmp_path / "profiles.json").write_text(json.dumps(profiles))
    got = documents.profiles(spark, f"file://{tmp_path}/profiles.json").first()
    assert (got.id, got.averageSpeed, got.ord) == ("x", 20.0, 0)
    exports.save_all(documents.profiles(spark, f"file://{tmp_path}/profiles.json"), f"file://{tmp_path}/p")
    assert documents.profiles(spark, f"file://{tmp_path}/p").count() == 1 and documents.profiles(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "profiles.json").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.profiles(spark, f"file://{tmp_path}/profiles.json").collect()


def test_stream_of_snapshots(spark, tmp_path):
    """Snapshots after each batch, over a restart from the checkpoint, equal the fold of the log so far."""
    from trackweave.streaming import collection

    spark.conf.set(*collection.PROVIDER)
    kind = f"collection string, seq bigint, kind string, id string, new_id string, field string, {ROW}"
    src, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    logs = {"one": random_log(5, 90, 4), "two": random_log(6, 60, 3)}
    flat = [(c, s, k, i, n, f, *(r or (None,) * 4)) for c, log in logs.items() for s, k, i, n, f, r in log]
    try:
        for number, (a, b) in enumerate(((0, 30), (30, 60), (60, 90))):
            part = [r for r in flat if a <= r[1] < b]
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(src)
            stream = collection.snapshots(spark.readStream.schema(kind).parquet(src), ROW)
            query = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i}")).option("checkpointLocation", mark).outputMode("update").start()
            query.processAllAvailable()
            query.stop()
            got = spark.read.parquet(f"{out}/{number}").collect()
            for name in {r[0] for r in part}:
                want = applied([r for r in logs[name] if r[0] < b])
                rows = sorted((r.place, r.id, r.name, r.price, r.isPermanent, r.isVisible) for r in got if r.collection == name and r.id)
                assert rows == [(i, *r[1:]) for i, r in enumerate(want)]
    finally:
        spark.conf.unset(collection.PROVIDER[0])
