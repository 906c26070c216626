"""Runs, running distance and snapshots over streams of segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUN = "route_id bigint, run_id bigint, surface string, distance double, n_segments bigint, total double"
STATE = "run_id bigint, surface string, distance double, n_segments bigint, total double"


def closed_runs(segments: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Runs of a stream of segments(route_id, ts, surface, distance), each when the next one begins.

    idle_ms: a route that has had no segment for so long has its open run closed too; what comes later is another run.

    Segments of a route have to come in the order of their times from batch to batch; within a
    batch they are sorted. State is one open run a route, so it is small however long a route is.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            run, surface, distance, n, total = state.get
            state.update((run, surface, 0.0, 0, total))
            yield pd.DataFrame([(key[0], run, surface, distance, n, total)] if n else [], columns=[x.split()[0] for x in RUN.split(", ")])
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        run, surface, distance, n, total = state.get if state.exists else (-1, None, 0.0, 0, 0.0)
        surfaces = rows["surface"].where(rows["surface"].notna(), None)
        change = surfaces.ne(surfaces.shift()) & ~(surfaces.isna() & surfaces.shift().isna())
        first = surfaces.iloc[0]
        change.iloc[0] = n == 0 or first != surface
        island = change.cumsum()
        grouped = rows.assign(island=island, surface=surfaces).groupby("island", sort=True)
        out = []
        for i, part in grouped:
            if i > 0:
                if n:
                    out.append((key[0], run, surface, distance, n, total))
                run, surface, distance, n = run + 1, part["surface"].iloc[0], 0.0, 0
            d = float(part["distance"].sum())
            distance, n, total = distance + d, n + len(part), total + d
        state.update((int(run), surface, distance, int(n), total))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in RUN.split(", ")])

    return segments.groupBy("route_id").applyInPandasWithState(step, RUN, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def totals(segments: DataFrame) -> DataFrame:
    """(route_id, distance, n_segments) so far; with output mode complete every change gives a full snapshot."""
    return segments.groupBy("route_id").agg(F.sum("distance").alias("distance"), F.count("*").alias("n_segments"))


def windowed_distance(segments: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(route_id, start, distance) of each time window, late segments up to the watermark included."""
    rows = segments.withWatermark("ts", late).groupBy("route_id", F.window("ts", width).alias("w")).agg(F.sum("distance").alias("distance"))
    return rows.select("route_id", F.col("w.start").alias("start"), "distance")


def latest_name(events: DataFrame) -> DataFrame:
    """(route_id, name): the name of the last event of each route."""
    return events.groupBy("route_id").agg(F.max_by("name", "ts").alias("name"))
