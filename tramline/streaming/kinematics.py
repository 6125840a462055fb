"""Extension: point features on a stream. The batch definition is operators.kinematics.

``ordered_kinematics`` has all of it: points wait until the watermark has passed them and go
on in the order of time, however they came, so its rows are those of the batch. ``stream_kinematics`` answers at once and has no bearings:
a point that comes after a later one of its track, in another batch, has a negative step of
time, as the order of arrival is kept. Its state is the last point of each track and its running sums, one row, so it doesn't grow
with the length of a track; tracks without points for an hour of event time are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tramline.functions.scalar import EARTH_RADIUS
from tramline.operators.kinematics import LEAST_STEP

OUTPUT = "track_id string, seq long, ts timestamp, time_diff double, distance double, speed double, acceleration double, total_distance double, total_time double"
STATE = "lat double, lon double, at double, speed double, total_distance double, total_time double"


def _update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    points = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
    if not len(points):
        return
    lat0, lon0, at0, speed0, far0, long0 = state.get if state.exists else [0.0] * 6
    last = (round(at0 * 1e6), lat0, lon0, speed0, 0.0, far0, long0, 0) if state.exists else None
    at = points["ts"].to_numpy("datetime64[us]").astype("int64")
    out, end = moved_on(at, points["lat"].to_numpy(float), points["lon"].to_numpy(float), last)
    state.update((end[1], end[2], end[0] / 1e6, end[3], end[5], end[6]))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), end[0] // 1000) + 3_600_000)
    told = pd.DataFrame({"track_id": key[0], "seq": points["seq"].to_numpy(), "ts": points["ts"].to_numpy(), **out})
    yield told[[c.split()[0] for c in OUTPUT.split(", ")]]


def stream_kinematics(points: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Features of a stream of points (track_id, seq, ts, lat, lon) in the order in which batches bring them."""
    return points.withWatermark("ts", late).groupBy("track_id").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_speed(features: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean speed and points of each window of event time; built in."""
    return features.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.avg("speed").alias("mean_speed"), F.count(F.lit(1)).alias("n"))


ORDERED = (
    "track_id string, seq long, ts timestamp, lat double, lon double, step long, time_diff double, distance double, speed double, acceleration double, "
    "bearing double, bearing_change double, total_distance double, total_time double"
)
_LAST = "at long, lat double, lon double, speed double, bearing double, total_distance double, total_time double, step long"
_HELD = "at long, seq long, lat double, lon double"


def moved_on(at: np.ndarray, lat: np.ndarray, lon: np.ndarray, last: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
    """Features of points in the order of time (``at`` in microseconds) that follow ``last``, and what follows them."""
    at0, lat0, lon0, speed0, bearing0, far, long, step = last or (int(at[0]), float(lat[0]), float(lon[0]), 0.0, 0.0, 0.0, 0.0, 0)
    before = lambda first, values: np.concatenate(([first], values[:-1]))
    gap = (at - before(at0, at)) / 1e6
    p1, p2, turn = np.radians(before(lat0, lat)), np.radians(lat), np.radians(lon - before(lon0, lon))
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(turn / 2) ** 2
    distance = 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
    course = np.degrees(np.arctan2(np.sin(turn) * np.cos(p2), np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(turn))) % 360.0
    span = np.where(gap == 0, LEAST_STEP, gap)
    speed = distance / span
    push, change = (speed - before(speed0, speed)) / span, np.abs(course - before(bearing0, course))
    if last is None:
        # The first point of a track has zeros.
        distance[0] = speed[0] = push[0] = course[0] = change[0] = 0.0
        push[1:2], change[1:2] = speed[1:2] / span[1:2], course[1:2]
    change = np.where(change > 180, 360 - change, change)
    out = {
        "step": step + 1 + np.arange(len(at)), "time_diff": gap, "distance": distance, "speed": speed, "acceleration": push, "bearing": course, "bearing_change": change,
        "total_distance": far + np.cumsum(distance), "total_time": long + np.cumsum(gap)}
    end = (int(at[-1]), float(lat[-1]), float(lon[-1]), *(float(out[c][-1]) for c in ("speed", "bearing", "total_distance", "total_time")), int(out["step"][-1]))
    return out, end


class Ordered(StatefulProcessor):
    """State of a track: its last point that was told, and the points that wait for the watermark."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle, self.last, self.held = handle, handle.getValueState("last", _LAST), handle.getListState("held", _HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, new = self.last.get() if self.last.exists() else None, []
        for pdf in rows:
            # To the microsecond, whatever unit the batch has.
            at = pdf["ts"].to_numpy("datetime64[us]").astype("int64")
            there = pdf[["lat", "lon"]].notna().all(axis=1).to_numpy() & pdf["ts"].notna().to_numpy()
            # Later than the watermark allows: what follows was told already.
            there &= at > last[0] if last else True
            new += [(int(a), int(q), float(y), float(x)) for a, q, y, x, ok in zip(at, pdf["seq"], pdf["lat"], pdf["lon"], there) if ok]
        if new:
            self.held.appendList(new)
        yield from self._told(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._told(key, timerValues)

    def _told(self, key, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.held.get())
        ready = [r for r in held if r[0] <= mark * 1000]
        last = tuple(self.last.get()) if self.last.exists() else None
        if ready:
            at, seq, lat, lon = (np.array(c) for c in zip(*ready))
            out, last = moved_on(at, lat.astype(float), lon.astype(float), last)
            self.last.update(last)
            held = held[len(ready) :]
            self.held.put(held) if held else self.held.clear()
            yield pd.DataFrame({"track_id": key[0], "seq": seq, "ts": pd.to_datetime(at, unit="us"), "lat": lat, "lon": lon, **out})
        if held:
            self.handle.registerTimer(-(-held[0][0] // 1000))
        elif last is not None:
            silent = -(-last[0] // 1000) + self.idle_ms
            if silent <= mark:
                self.last.clear()
            else:
                self.handle.registerTimer(silent)

    def close(self) -> None:
        pass


def ordered_kinematics(points: DataFrame, late: str = "10 minutes", idle_hours: float = 24.0) -> DataFrame:
    """The features of operators.kinematics for a stream of points (track_id, seq, ts, lat, lon), in the order of time.

    A point is told once the watermark, ``late`` behind the latest point of all tracks, has passed it; one that
    comes later than that is left out, as is one without time or place. State is one row for each track and its
    points of the last ``late``; a track that is silent for ``idle_hours`` of event time is forgotten and begins anew. Needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    stamped = points.select("track_id", "seq", "ts", "lat", "lon").withWatermark("ts", late)
    return stamped.groupBy("track_id").transformWithStateInPandas(Ordered(int(idle_hours * 3_600_000)), ORDERED, "Append", "EventTime")
