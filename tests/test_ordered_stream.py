"""Ordered features of a shuffled stream against those of the batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.operators.kinematics import kinematics
from tramline.streaming.kinematics import moved_on, ordered_kinematics

SCHEMA = "track_id string, seq long, ts timestamp, lat double, lon double"
COLUMNS = ["track_id", "seq", "step", "time_diff", "distance", "speed", "acceleration", "bearing", "bearing_change", "total_distance", "total_time"]


def walks(seed, tracks=6, n=60):
    draw, rows = random.Random(seed), []
    for k in range(tracks):
        t, y, x = 1_700_000_000.0 + 40 * k, 39.9, 116.4
        for i in range(n):
            t, y, x = t + draw.choice([0, 0.25, 1, 20, 45]), y + draw.uniform(-1e-4, 2e-4), x + draw.uniform(-1e-4, 2e-4)
            rows.append((f"t{k}", i, t, y, x))
    return rows


def frame(spark, rows):
    made = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "t double"))
    return made.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long"))).select("track_id", "seq", "ts", "lat", "lon")


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], rel=1e-6, abs=1e-3), (x, y)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, held)


def streamed(spark, tmp_path, parts, **how):
    folder = f"{tmp_path}/in"
    for k, rows in enumerate(parts):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/part={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    name = f"ordered_{random.randrange(10**9)}"
    run = ordered_kinematics(stream, **how).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert run.exception() is None
    return spark.table(name)


def test_shuffled_stream_is_the_batch(rocks, tmp_path):
    spark, draw = rocks, random.Random(4)
    rows = walks(1)
    # Each point comes up to five minutes late.
    arrived = sorted(rows, key=lambda r: r[2] + draw.uniform(0, 290))
    parts = [arrived[k : k + 90] for k in range(0, len(arrived), 90)]
    # A point of another track far ahead lets the watermark pass all others, and one more batch tells them.
    ahead = [[("z", 0, 1_700_050_000.0, 1.0, 1.0)], [("z", 1, 1_700_050_001.0, 1.0, 1.0)]]
    got = [r for r in rows_of(streamed(spark, tmp_path, [*parts, *ahead], late="5 minutes")) if r[0] != "z"]
    close(got, rows_of(kinematics(frame(spark, rows))))


def test_too_late_and_silent_tracks(rocks, tmp_path):
    spark, at = rocks, 1_700_000_000.0
    parts = [
        [("a", 0, at, 10.0, 10.0), ("a", 1, at + 10, 10.001, 10.0), ("b", 0, at + 100, 5.0, 5.0)], [("a", 2, at + 20, 10.002, 10.0), ("b", 1, at + 500, 5.0, 5.0)], [("b", 2, at + 600, 5.0, 5.0)],
        # By now the watermark is past the first points: this one is too late.
        [("a", 9, at + 5, 50.0, 50.0), ("a", 3, at + 590, 10.003, 10.0)], [("z", 0, at + 9_000, 0.0, 0.0)], [("z", 1, at + 9_001, 0.0, 0.0)], [("a", 4, at + 9_100, 20.0, 20.0), ("z", 2, at + 19_000, 0.0, 0.0)], [("z", 3, at + 19_001, 0.0, 0.0)],
    ]
    got = {(r.track_id, r.seq): r for r in streamed(spark, tmp_path, parts, late="1 minute", idle_hours=1.0).collect()}
    assert ("a", 9) not in got and got["a", 3].step == 4 and got["a", 3].time_diff == 570
    # After more than an hour without a point the track begins anew.
    assert got["a", 4].step == 1 and got["a", 4].distance == 0


def test_parts_of_a_track_go_on():
    draw = np.random.default_rng(2)
    at, lat, lon = np.cumsum(draw.integers(0, 5, 50)) * 250_000, 10 + np.cumsum(draw.normal(0, 1e-4, 50)), 20 + np.cumsum(draw.normal(0, 1e-4, 50))
    whole, end = moved_on(at, lat, lon, None)
    for cut in (1, 2, 3, 25, 49):
        one, last = moved_on(at[:cut], lat[:cut], lon[:cut], None)
        two, again = moved_on(at[cut:], lat[cut:], lon[cut:], last)
        assert all(np.allclose(np.concatenate((one[c], two[c])), whole[c]) for c in whole) and np.allclose(again, end)
