"""Long tracks and segments are cut into chunks; the rows are those of an uncut one."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import cleaning, kinematics, segments

POINT = "track_id string, seq long, ts timestamp, lat double, lon double, user_id string"


def track(seed, n, name="a", step=25):
    draw, t, y, x, out = random.Random(seed), 1_700_000_000.0, 39.9, 116.4, []
    for k in range(n):
        t += draw.choice([0, 0.5, 1, step, 4 * step])
        y, x = y + draw.uniform(-1e-4, 2e-4), x + draw.uniform(-1e-4, 2e-4)
        out.append((name, k, None if k < 2 and seed % 2 else t, None if draw.random() < 0.02 else y, x, "u"))
    return out


@pytest.fixture(scope="module")
def points(spark):
    rows = track(1, 700) + track(2, 300, "b", 900) + track(3, 1, "c") + track(4, 40, None)
    frame = spark.createDataFrame(rows, POINT.replace("ts timestamp", "t double"))
    return frame.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t").repartition(3).cache()


def rows_of(df, *keys):
    return sorted(([None if v is None else round(v, 6) if isinstance(v, float) else v for v in r] for r in df.collect()), key=lambda r: repr(r[: len(keys) or 2]))


def reference(rows):
    """One track after the other, point by point."""
    import math

    def metres(lat1, lon1, lat2, lon2):
        p1, p2 = math.radians(lat1), math.radians(lat2)
        a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, a)))

    out = []
    for name in {r[0] for r in rows}:
        last, far, long = None, 0.0, 0.0
        for step, (_, seq, t, y, x, _) in enumerate(sorted((r for r in rows if r[0] == name), key=lambda r: (r[2] is not None, r[2] or 0, r[1])), 1):
            gap = moved = speed = push = turn = course = 0.0
            if last is not None:
                t0, y0, x0, speed0, course0 = last
                gap = t - t0 if t is not None and t0 is not None else 0.0
                if y0 is not None:
                    moved = None if y is None else metres(y0, x0, y, x)
                    if y is not None:
                        a, b, d = math.radians(y0), math.radians(y), math.radians(x - x0)
                        course = (math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d))) + 360) % 360
                    else:
                        course = None
                span = gap or 1e-6
                speed = None if moved is None else moved / span
                push = 0.0 if speed is None or speed0 is None else (speed - speed0) / span
                turn = 0.0 if course is None or course0 is None else min(abs(course - course0), 360 - abs(course - course0))
            far, long = far + (moved or 0.0), long + gap
            out.append([name, seq, step, gap, moved, speed, push, course, turn, far, long])
            last = t, y, x, speed, course
    return out


@pytest.mark.parametrize("chunk", [30, 3_600, 10**9])
def test_kinematics_of_any_chunk(spark, points, chunk):
    columns = ["track_id", "seq", "step", "time_diff", "distance", "speed", "acceleration", "bearing", "bearing_change", "total_distance", "total_time"]
    got = rows_of(kinematics.kinematics(points, chunk=chunk).select(*columns))
    rows = track(1, 700) + track(2, 300, "b", 900) + track(3, 1, "c") + track(4, 40, None)
    want = sorted(reference(rows), key=lambda r: repr(r[:2]))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        none = lambda r: [-1e9 if v is None else v for v in r[3:]]
        assert a[:3] == b[:3] and none(a) == pytest.approx(none(b), rel=1e-4, abs=1e-4), (a, b)


def test_one_track_is_many_tasks(spark):
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 400_000
        one = spark.range(n).select(F.lit("t").alias("track_id"), F.col("id").alias("seq"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 5).alias("ts"), (F.col("id") * 1e-6).alias("lat"), (F.col("id") * 1e-6).alias("lon"))
        got = kinematics.kinematics(one).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("step").alias("step"), F.max("total_time").alias("time")).collect()
        assert sum(r.n for r in got) == n and max(r.n for r in got) < 0.6 * n and max(r.step for r in got) == n and max(r.time for r in got) == 5.0 * (n - 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)


def motion(spark, seed, flagged):
    draw, rows = random.Random(seed), []
    for s, size in enumerate([1, 2, 5, 6, 7, 8, 40, 300, 700]):
        for k in range(1, size + 1):
            speed = draw.choice([0.0, 3.0, 12.0, 14.0, 20.0]) if k % 50 > 20 else 12.0 + draw.random()
            rows.append((f"s{s}", "Bus", k, 90.0 if draw.random() < flagged else speed, draw.uniform(-2, 2), 170.0 if draw.random() < flagged else draw.uniform(0, 60), speed, 1.0, 2.0 * k, 3.0 * k, 39.9 + k * 1e-4, 116.4))
    return spark.createDataFrame(rows, "segment_id string, label string, step long, speed double, acceleration double, bearing_change double, distance double, time_diff double, total_distance double, total_time double, lat double, lon double").repartition(3)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_statistics_of_any_chunk(spark, chunk):
    frame = motion(spark, 5, 0.02)
    a, b = (sorted(segments.statistics(frame, chunk=c).collect()) for c in (chunk, None))
    assert [r.segment_id for r in a] == [r.segment_id for r in b]
    for x, y in zip(a, b):
        assert x.asDict() == {k: v if isinstance(v, str) else pytest.approx(v, rel=1e-9) for k, v in y.asDict().items()}


@pytest.mark.parametrize("chunk, flagged", [(8, 0.0), (8, 0.05), (50, 0.3)])
def test_repairs_of_any_chunk(spark, chunk, flagged):
    frame, keys = cleaning.flag_outliers(motion(spark, 6, flagged)), ["segment_id"]
    for make in (
        lambda c: cleaning.repair(frame, keys, chunk=c), lambda c: cleaning.smooth_bearing(frame, keys, 150.0, chunk=c),
        lambda c: cleaning.clean(frame, keys, "strict", chunk=c), lambda c: cleaning.clean(frame, keys, "gentle", chunk=c)):
        whole = lambda df: sorted(tuple(r) for r in df.collect())
        assert whole(make(chunk)) == whole(make(None))


def test_long_segments_are_cut(spark):
    pieces = cleaning._pieces(cleaning.flag_outliers(motion(spark, 6, 0.05)), ["segment_id"], "step", ~F.col("is_outlier"), 50)
    sizes = [r["count"] for r in pieces.where("segment_id = 's8' and not _halo").groupBy("_piece").count().collect()]
    assert sum(sizes) == 700 and len(sizes) > 10 and max(sizes) < 150
