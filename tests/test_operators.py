"""Operators against hand-made values and plain NumPy."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline import schemas
from tramline.functions import scalar
from tramline.operators import cleaning, kinematics, learning, resample, segments, spatial, weather

T0 = dt.datetime(2024, 1, 1)


def points(spark, rows):
    """rows: track, seq, seconds, lat, lon."""
    made = [(t, s, T0 + dt.timedelta(seconds=x), float(lat), float(lon)) for t, s, x, lat, lon in rows]
    return spark.createDataFrame(made, "track_id string, seq long, ts timestamp, lat double, lon double")


def test_kinematics_by_hand(spark):
    rows = [("a", 1, 0, 39.9, 116.3), ("a", 2, 10, 39.901, 116.3), ("a", 3, 10, 39.901, 116.301), ("b", 9, 5, 10, 10)]
    out = {(r.track_id, r.seq): r for r in kinematics.kinematics(points(spark, rows)).collect()}
    first, second, third = (out["a", k] for k in (1, 2, 3))
    assert (first.distance, first.speed, first.acceleration, first.bearing, first.time_diff) == (0, 0, 0, 0, 0)
    assert second.distance == pytest.approx(111.1949, abs=1e-3) and second.speed == pytest.approx(11.11949, abs=1e-4) and second.bearing == pytest.approx(0)
    assert third.time_diff == 0 and third.speed == pytest.approx(third.distance / 1e-6)  # a step of no time
    assert third.bearing_change == pytest.approx(third.bearing) and third.total_time == 10
    assert out["b", 9].total_distance == 0


def test_valid_and_long(spark):
    p = points(spark, [("a", 1, 0, 95, 1), ("a", 2, 1, 1, 1), ("b", 1, 0, 2, 2), ("b", 2, 3, 2, 181)])
    assert {(r.track_id, r.seq) for r in kinematics.valid_points(p).collect()} == {("a", 2), ("b", 1)}
    assert kinematics.long_tracks(p, 3).count() == 0 and kinematics.long_tracks(p, 2).count() == 4


def test_haversine_is_symmetric_and_zero_on_itself(spark):
    df = spark.createDataFrame([(39.9, 116.3, -12.0, 4.0)], "a double, b double, c double, d double")
    there, back, same = df.select(scalar.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")), scalar.haversine(F.col("c"), F.col("d"), F.col("a"), F.col("b")), scalar.haversine(F.col("a"), F.col("b"), F.col("a"), F.col("b"))).first()
    assert there == pytest.approx(back) and same == 0


def test_label_join_bounds_and_overlap(spark):
    p = points(spark, [("t", k, 60 * k, 39 + k / 1000, 116) for k in range(30)]).withColumn("user_id", F.lit("u"))
    at = lambda m: T0 + dt.timedelta(minutes=m)
    labels = spark.createDataFrame([("u", at(2), at(12), " Taxi "), ("u", at(5), at(20), "boat"), ("u", at(0), at(3), "walk"), ("v", at(0), at(29), "bus")], "user_id string, start_ts timestamp, end_ts timestamp, raw_mode string")
    out = segments.label_join(p, labels).groupBy("label").agg(F.count(F.lit(1)), F.min("seq"), F.max("seq")).collect()
    assert {tuple(r) for r in out} == {("Car & taxi", 11, 2, 12), ("Boat", 16, 5, 20)}


def numpy_stats(v, a, b, d, t, td, tt, lat, lon):
    eps, n = 1e-8, len(v)
    v, a_abs = np.clip(v, 0, None), np.abs(a)
    dist, time = td[-1] if td[-1] > 0 else d.sum(), tt[-1] if tt[-1] > 0 else t.sum()
    straight = np.hypot((lat[-1] - lat[0]) * 111300, (lon[-1] - lon[0]) * 111300 * np.cos(np.radians(lat[0])))
    h = np.histogram(v, bins=10, range=(0, v.max() + eps))[0]
    p = h / (h.sum() + eps)
    best = run = 0
    for x in v:
        run = run + 1 if x > 10 else 0
        best = max(best, run)
    return [
        v.mean(), v.std(), v.max(), v.std() / (v.mean() + eps), a_abs.mean(), a_abs.std(), a_abs.max(), b.mean(), b.std(), (v < 0.5).mean(), (v > 15).mean(),
        min(straight / (dist + eps), 1), dist, time, dist / (time + eps), -(p[p > 0] * np.log(p[p > 0] + eps)).sum(), (np.diff(np.sign(a)) != 0).sum() / (n - 1), best / n]


def test_statistics_against_numpy(spark):
    draw, rows, want = np.random.default_rng(4), [], {}
    for k, n in enumerate((10, 50, 137)):
        v, a, b, d, t = draw.gamma(2, 6, n), draw.normal(0, 2, n), draw.uniform(0, 180, n), draw.uniform(0, 90, n), draw.integers(1, 30, n).astype(float)
        lat, lon = 39 + np.cumsum(draw.normal(0, 1e-3, n)), 116 + np.cumsum(draw.normal(0, 1e-3, n))
        td, tt = np.cumsum(d), np.cumsum(t)
        rows += [(f"s{k}", i, *map(float, x)) for i, x in enumerate(zip(lat, lon, v, a, b, d, t, td, tt))]
        want[f"s{k}"] = numpy_stats(v, a, b, d, t, td, tt, lat, lon)
    names = "lat lon speed acceleration bearing_change distance time_diff total_distance total_time".split()
    frame = spark.createDataFrame(rows, "segment_id string, step int, " + ", ".join(f"{c} double" for c in names))
    for r in segments.statistics(frame).collect():
        assert [r[c] for c in schemas.STATS] == pytest.approx(want[r.segment_id], rel=1e-6, abs=1e-9)


def test_one_point_segment(spark):
    names = "lat lon speed acceleration bearing_change distance time_diff total_distance total_time".split()
    frame = spark.createDataFrame([("s", 0, *([0.0] * 9))], "segment_id string, step int, " + ", ".join(f"{c} double" for c in names))
    row = segments.statistics(frame).first()
    assert {c: row[c] for c in schemas.STATS if row[c]} == {"stop_ratio": 1.0}


def test_repair_reads_what_was_repaired():
    values, marks = np.array([1.0, 2.0, 100.0, 200.0, 3.0, 4.0]), np.array([0, 0, 1, 1, 0, 0], bool)
    # The first becomes median(1, 2, 200, 3) = 2.5, the second then median(2, 2.5, 3, 4) = 2.75.
    assert cleaning.repair_column(values, marks).tolist() == [1, 2, 2.5, 2.75, 3, 4]
    assert cleaning.repair_column(np.array([7.0]), np.array([True])).tolist() == [7]
    assert np.isnan(cleaning.repair_column(np.array([np.nan, 5.0, 1.0]), np.array([0, 1, 0], bool))[1])
    assert cleaning.settle_bearing(np.array([0.0, 170.0, 160.0, 10.0, 170.0]), 150).tolist() == pytest.approx([0, 110, 280 / 3, 10, 170])


def segment(spark, n, label="Walk", speed=1.0):
    rows = [("s", label, k, k, T0 + dt.timedelta(seconds=k), 39.0, 116.0, speed + k % 3, 0.1, 5.0, 1.0, 1.0, float(k), float(k)) for k in range(n)]
    return spark.createDataFrame(rows, "segment_id string, label string, step int, seq long, ts timestamp, lat double, lon double, speed double, acceleration double, bearing_change double, distance double, time_diff double, total_distance double, total_time double")


def test_outliers_and_verdicts(spark):
    flagged = cleaning.flag_outliers(segment(spark, 12)).orderBy("step").collect()
    assert [r.is_outlier for r in flagged[:3]] == [False, False, False]  # 3 m/s is no more than 1.2 times 2.5
    fast = cleaning.verdicts(segment(spark, 12, speed=9.0), ["segment_id"]).first()
    assert fast.discard_reason == "too_many_outliers" and fast.n_outliers == 12
    assert cleaning.verdicts(segment(spark, 9), ["segment_id"]).first().discard_reason == "too_short"
    assert cleaning.verdicts(segment(spark, 12, "Boat"), ["segment_id"]).first().discard_reason == "other_label"
    assert schemas.preset("nonsense") == schemas.PRESETS["balanced"]
    rates = cleaning.funnel(segment(spark, 12).limit(0), ["segment_id"]).first()
    assert (rates.segments, rates.retention_rate, rates.outlier_rate) == (0, 0, 0)
    nan = segment(spark, 3).withColumn("speed", F.lit(float("nan")))
    assert all(r.is_outlier for r in cleaning.flag_outliers(nan).collect())


def test_smoothing_against_numpy(spark):
    draw = np.random.default_rng(1)
    values = draw.normal(5, 2, 40)
    frame = spark.createDataFrame([("s", k, float(v), 0.0) for k, v in enumerate(values)], "segment_id string, step int, speed double, acceleration double")
    for window, (weights, total) in cleaning.SMOOTHING.items():
        half = window // 2
        x = np.arange(-half, half + 1)
        fitted = np.linalg.pinv(np.vander(x, 3))[-1]  # the value at 0 of the best parabola
        assert np.array(weights) / total == pytest.approx(fitted)
        wide = np.concatenate(([values[0]] * half, values, [values[-1]] * half))
        want = [float(fitted @ wide[k : k + window]) for k in range(len(values))]
        got = [r.speed for r in cleaning.smooth(frame, ["segment_id"], window).orderBy("step").collect()]
        assert got == pytest.approx(want)
    short = frame.where("step < 4")
    assert [r.speed for r in cleaning.smooth(short, ["segment_id"], 5).orderBy("step").collect()] == pytest.approx(values[:4])


def test_clean_keeps_what_is_fine(spark):
    calm = segment(spark, 20).withColumn("speed", F.lit(1.0))
    assert [r.speed for r in cleaning.clean(calm, ["segment_id"]).collect()] == pytest.approx([1.0] * 20)
    assert cleaning.clean(segment(spark, 20, speed=9.0), ["segment_id"]).count() == 0


def test_gap_fill_is_opt_in(spark):
    p = points(spark, [("a", 1, 0, 0, 0), ("a", 2, 40, 4, 8), ("a", 3, 45, 5, 5), ("a", 4, 500, 6, 6)])
    out = [(r.lat, r.lon, r.filled) for r in cleaning.fill_gaps(p, ["track_id"]).orderBy("ts").collect()]
    assert out == [(0, 0, False), (1, 2, True), (2, 4, True), (3, 6, True), (4, 8, False), (5, 5, False), (6, 6, False)]


@pytest.mark.parametrize("n", [2, 49, 50, 51, 137])
def test_resample_against_numpy(spark, n):
    frame = spark.createDataFrame([("s", k, float(k * k), T0 + dt.timedelta(seconds=k)) for k in range(n)], "segment_id string, step int, v double, ts timestamp")
    got = [r.v for r in resample.resample(frame, ["segment_id"], ["v"]).orderBy("slot").collect()]
    values, places = np.arange(n) ** 2.0, np.linspace(0, n - 1, 50)
    want = values[places.astype(int)] if n > 50 else np.interp(places, np.arange(n), values)
    assert got == pytest.approx(want)
    padded = [r.v for r in resample.pad(frame, ["segment_id"], ["v"]).orderBy("slot").collect()]
    assert padded == pytest.approx(want if n > 50 else np.concatenate((values, np.zeros(50 - n))))
    times = [r.ts for r in resample.resample_times(frame, ["segment_id"]).orderBy("slot").collect()]
    assert len(times) == 50 and times[-1] == T0 + dt.timedelta(seconds=n - 1)


def test_spatial_against_brute_force(spark):
    draw = np.random.default_rng(2)
    p = draw.uniform(0, 0.02, (60, 2)) + (39.9, 116.4)
    t = draw.uniform(0, 0.02, (80, 2)) + (39.9, 116.4)
    pts = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(p)], "seq long, lat double, lon double")
    roads = spark.createDataFrame([(k, float(a), float(b), "primary") for k, (a, b) in enumerate(t)], "node_id long, lat double, lon double, road_type string")
    d = np.hypot(p[:, None, 0] - t[None, :, 0], p[:, None, 1] - t[None, :, 1]) * scalar.DEGREE
    for radius in (50.0, 300.0):
        for salts in (1, 3):
            got = {(r.seq, r.node_id) for r in spatial.within(pts, roads, "seq", radius, salts=salts).collect()}
            assert got == {tuple(map(int, x)) for x in np.argwhere(d <= radius)}
    near = {r.seq: r.node_id for r in spatial.nearest(pts, roads, "seq", "node_id", 150.0).collect()}
    assert near == {k: int(d[k].argmin()) for k in range(60) if d[k].min() < 150}
    density = {r.seq: r.road_density for r in spatial.road_density(pts, roads, "seq").collect()}
    assert density == pytest.approx({k: min((d[k] <= 100).sum() / 50, 1) for k in range(60)})


def test_poi_on_the_point_and_none(spark):
    pts = spark.createDataFrame([(1, 39.9, 116.4), (2, 50.0, 10.0)], "seq long, lat double, lon double")
    pois = spark.createDataFrame([(7, 39.9, 116.4, "bus_stop"), (8, 39.9001, 116.4, "taxi")], "poi_id long, lat double, lon double, poi_type string")
    rows = {r.seq: (r.has_bus_stop, r.has_parking, r.poi_distance) for r in spatial.poi_features(pts, pois, "seq").collect()}
    assert rows == {1: (1, 0, 0.0), 2: (0, 0, 0.0)}
    roads = spark.createDataFrame([(1, 39.9002, 116.4, "primary")], "node_id long, lat double, lon double, road_type string")
    vector = spatial.spatial_vector(pts, roads, pois, "seq").collect()
    assert {r.seq: r.road_bus for r in vector} == {1: 1.0, 2: 0.0}
    assert all(sum(r[f"road_{c}"] for c in schemas.ROAD_CLASS_ORDER) == 1 for r in vector)


def test_nearest_segment_against_brute_force(spark):
    draw = np.random.default_rng(3)
    p = draw.uniform(0, 0.05, (40, 2))
    e = np.hstack([q := draw.uniform(0, 0.05, (25, 2)), q + draw.normal(0, 0.004, (25, 2))])
    pts = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(p)], "seq long, lat double, lon double")
    edges = spark.createDataFrame([(k, "primary", *map(float, x)) for k, x in enumerate(e)], "road_id long, road_type string, lat1 double, lon1 double, lat2 double, lon2 double")

    def distance(x, s):
        a, b = s[:2], s[2:]
        at = np.clip(((x - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)
        return np.hypot(*(x - a - at * (b - a)))

    want = {k: int(np.argmin([distance(x, s) for s in e])) for k, x in enumerate(p)}
    got = {r.seq: r.road_id for r in spatial.nearest_segment(pts, edges, "seq", 300.0).collect()}
    assert got == want


def test_weather_gaps_and_nearest(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    known = spark.createDataFrame([(day(2), 2.0), (day(11), 11.0), (day(14), None)], "date date, temp double")
    daily = weather.calendar(known)
    values = [r.temp for r in weather.interpolate(daily, "temp", 13.5).orderBy("date").collect()]
    assert values == pytest.approx([2, 3, 4, 5, 6, 7, 8, 9, 13.5, 11, 11, 11, 11])  # the eighth day of a gap is left to the default
    dates = spark.createDataFrame([(day(k),) for k in (2, 4, 6, 7, 20, 30)], "date date")
    near = {r.date: r.weather_date for r in weather.nearest_day(dates, known).collect()}
    assert near == {day(2): day(2), day(4): day(2), day(6): day(2), day(7): day(11), day(20): day(14), day(30): None}


def test_split_and_weights(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("label"))
    out = learning.split(df, "k").groupBy("label", "split").count().collect()
    sizes = {(r.label, r.split): r["count"] for r in out}
    assert abs(sizes["a", "train"] / 1000 - 0.7) < 0.05 and abs(sizes["b", "test"] / 3000 - 0.2) < 0.04
    for mode in ("inverse", "sqrt_inverse", "effective"):
        w = {r.label: r.weight for r in learning.class_weights(df, mode).collect()}
        assert sum(w.values()) == pytest.approx(2) and w["a"] > w["b"]


def test_report_marginals(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    frame = spark.createDataFrame(rows, "true_label string, pred_label string")
    r = {x.label: x for x in learning.report(frame).collect()}
    assert r["a"].support == 4 and r["c"].recall == 0 and r["c"].precision == 0
    assert r["accuracy"].f1 == pytest.approx(5 / 7) == pytest.approx(r["weighted avg"].recall)


def test_trained_classifier_on_held_out_segments(spark):
    draw = np.random.default_rng(8)
    rows = []
    for k in range(300):
        label, pace = [("Walk", 1.2), ("Bike", 5.0), ("Train", 30.0)][k % 3]
        rows.append((f"s{k}", label, *(float(draw.normal(pace, pace / 6)) for _ in schemas.STATS)))
    frame = spark.createDataFrame(rows, "segment_id string, label string, " + ", ".join(f"{c} double" for c in schemas.STATS))
    model = learning.train_classifier(frame.where("segment_id < 's2'"), depth=4, trees=8)
    held = model.transform(frame.where("segment_id >= 's2'"))
    assert held.where("label = pred_label").count() / held.count() > 0.95


def test_streamed_kinematics_equal_batch(spark, tmp_path):
    from tramline.streaming.kinematics import stream_kinematics

    rows = [(t, k, 20 * k, 39 + k / 500, 116 + (k % 5) / 300) for t in ("a", "b") for k in range(12)]
    all_points = points(spark, rows)
    all_points.where("seq < 6").coalesce(1).write.parquet(f"{tmp_path}/in/x1")
    stream = spark.readStream.schema(all_points.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    name = "streamed_features"
    run = stream_kinematics(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").start()
    try:
        run.processAllAvailable()
        all_points.where("seq >= 6").coalesce(1).write.parquet(f"{tmp_path}/in/x2")
        run.processAllAvailable()
    finally:
        run.stop()
    columns = ["track_id", "seq", "distance", "speed", "acceleration", "total_distance", "total_time"]
    got = [tuple(r) for r in spark.table(name).select(*columns).orderBy("track_id", "seq").collect()]
    want = [tuple(r) for r in kinematics.kinematics(all_points).select(*columns).orderBy("track_id", "seq").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [x for g in got for x in g[2:]] == pytest.approx([x for w in want for x in w[2:]], rel=1e-9, abs=1e-6)


def test_repairs_of_many_segments_over_many_batches(spark):
    draw = np.random.default_rng(12)
    rows, want = [], {}
    for k in range(60):
        n = int(draw.integers(1, 40))
        v, marks = draw.normal(5, 2, n), draw.random(n) < 0.3
        rows += [(f"s{k:02d}", "Walk", i, float(v[i]), float(v[i]), float(90 + 10 * v[i]), bool(marks[i])) for i in range(n)]
        want[f"s{k:02d}"] = (cleaning.repair_column(v, marks), cleaning.settle_bearing(90 + 10 * v, 120))
    frame = spark.createDataFrame(rows, "segment_id string, label string, step int, speed double, acceleration double, bearing_change double, is_outlier boolean").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        repaired = cleaning.repair(frame, ["segment_id"]).orderBy("segment_id", "step").collect()
        settled = cleaning.smooth_bearing(frame, ["segment_id"], 150.0).orderBy("segment_id", "step").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for name, (speed, change) in want.items():
        assert [r.speed for r in repaired if r.segment_id == name] == pytest.approx(speed)
        assert [r.bearing_change for r in settled if r.segment_id == name] == pytest.approx(change)


def test_nearest_any_line_has_all_pieces_and_no_threshold(spark, sf_dir):
    from tramline.plans import fixtures, queries

    pts = fixtures.points(spark, sf_dir).select("seq", "lat", "lon").toPandas()
    lines = queries.all_road_lines(spark, sf_dir).select("lat1", "lon1", "lat2", "lon2").toPandas().to_numpy()
    a, d = lines[:, :2], lines[:, 2:] - lines[:, :2]
    want = {}
    for seq, x in zip(pts.seq, pts[["lat", "lon"]].to_numpy()):
        at = np.clip(((x - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        want[seq] = np.hypot(*(x - a - at[:, None] * d).T).min() * 111300
    got = {r.seq: r.distance for r in queries.QUERIES["geo19_nearest_line"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and max(want.values()) > 300
    assert all(abs(got[k] - want[k]) < 0.01 for k in want)


def segments_of(spark, draw, n=12):
    """Random segments of 5 to 40 points, with jumps and bends that cleaning has to mend."""
    rows = []
    for g in range(n):
        label = draw.choice(["Walk", "Bike", "Bus", "Airplane"])
        for k in range(draw.randint(5, 40)):
            speed = draw.choice((1.0, 1.5, 2.0, 40.0 if draw.random() < 0.1 else 0.5))
            rows.append((f"s{g}", k, label, speed, draw.uniform(-1, 1) * (9 if draw.random() < 0.05 else 1), draw.uniform(0, 179)))
    return spark.createDataFrame(rows, "segment_id string, step int, label string, speed double, acceleration double, bearing_change double")


def test_clean_equals_its_steps(spark):

    frame = segments_of(spark, random.Random(2))
    for mode in ("strict", "balanced", "gentle"):
        p = schemas.preset(mode)
        kept = frame.join(cleaning.verdicts(frame, ["segment_id"], mode).where("discard_reason is null"), "segment_id", "left_semi")
        want = cleaning.smooth(cleaning.repair(cleaning.flag_outliers(kept), ["segment_id"]), ["segment_id"], p.window)
        want = cleaning.smooth_bearing(want, ["segment_id"], p.max_bearing_change) if p.window else want
        told = lambda df: sorted((r.segment_id, r.step, round(r.speed, 9), round(r.acceleration, 9), round(r.bearing_change, 9)) for r in df.collect())
        assert told(cleaning.clean(frame, ["segment_id"], mode)) == told(want)


def test_segments_over_many_batches():
    import pandas as pd


    rows = pd.DataFrame({"k": list("aabbbbbbbccdeeee"), "v": range(16)})
    for size in (1, 2, 3, 5, 16):
        seen = []

        def change(pdf, slices):
            seen.extend((pdf["k"][s].tolist(), pdf["v"][s].tolist()) for s in slices)
            return pdf

        out = pd.concat(list(cleaning._whole_segments(["k"], change)(rows.iloc[k : k + size] for k in range(0, 16, size))))
        assert out["v"].tolist() == list(range(16))
        assert [(set(k), v) for k, v in seen] == [({k}, g["v"].tolist()) for k, g in rows.groupby("k")]


def test_spatial_vector_equals_its_parts(spark):

    draw = random.Random(5)
    at = lambda: (39.9 + draw.uniform(-0.004, 0.004), 116.4 + draw.uniform(-0.004, 0.004))
    points = spark.createDataFrame([(k, *at()) for k in range(60)], "seq long, lat double, lon double")
    roads = spark.createDataFrame([(k, *at(), draw.choice(["primary", "footway", "rail"])) for k in range(25)], "node_id long, lat double, lon double, road_type string")
    pois = spark.createDataFrame([(k, *at(), draw.choice(["bus_stop", "station", "parking", "taxi"])) for k in range(12)], "poi_id long, lat double, lon double, poi_type string")
    classes = {r.seq: r.road_class for r in spatial.road_features(points, roads, pois, "seq").collect()}
    near = {r.seq: r for r in spatial.poi_features(points, pois, "seq").collect()}
    dense = {r.seq: r.road_density for r in spatial.road_density(points, roads, "seq").collect()}
    for salts in (1, 3):
        for r in spatial.spatial_vector(points, roads, pois, "seq", salts).collect():
            assert [c for c in schemas.ROAD_CLASS_ORDER if r[f"road_{c}"] == 1] == [classes[r.seq]]
            assert (r.has_bus_stop, r.has_station, r.has_parking, r.poi_distance) == (near[r.seq].has_bus_stop, near[r.seq].has_station, near[r.seq].has_parking, near[r.seq].poi_distance)
            assert r.road_density == dense[r.seq]


def test_time_warp_against_numpy(spark):
    import hashlib



    frame = segments_of(spark, random.Random(3), 6)
    rows = sorted(map(tuple, frame.select("segment_id", "step", "speed").collect()))
    got = {(r.segment_id, r.step): r.speed for r in learning.augment(frame, "time_warp", ["segment_id"]).collect()}
    for g in {r[0] for r in rows}:
        values = np.array([v for s, _, v in rows if s == g])
        n = len(values)
        factor = 0.8 + 0.4 * (int(hashlib.md5(f"{g}|warp|42".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        m = max(int(n * factor), 10)
        drawn = np.interp(np.linspace(0, n - 1, m), np.arange(n), values)
        want = np.interp(np.linspace(0, m - 1, n), np.arange(m), drawn)
        assert np.allclose([got[g, k] for k in range(n)], want)


def test_salted_look_ups_are_the_plain_ones(spark, sf_dir):
    from tramline.plans import fixtures

    points, roads, pois = (f(spark, sf_dir) for f in (fixtures.points, fixtures.roads, fixtures.pois))
    points = points.limit(300)
    whole = lambda df: sorted(tuple(r) for r in df.collect())
    for make in (
        lambda k: spatial.nearest(points, roads, "seq", "node_id", 150.0, salts=k), lambda k: spatial.road_features(points, roads, pois, "seq", salts=k),
        lambda k: spatial.poi_features(points, pois, "seq", salts=k), lambda k: spatial.road_density(points, roads, "seq", salts=k)):
        assert whole(make(5)) == whole(make(1))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_within_a_radius_put_no_piece_into_cells(spark, sf_dir):
    from tramline.plans import queries

    assert "_cy" not in _plan(queries.QUERIES["geo19_line_within_300m"](spark, sf_dir))


def test_targets_repeated_for_cells_are_not_broadcast(spark, sf_dir):
    from tramline.plans import queries

    assert "BroadcastHashJoin" not in _plan(queries.QUERIES["geo12_road_density"](spark, sf_dir))


def _pairs(monkeypatch):
    """Numbers of targets that ``within`` gets."""
    seen, plain = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda points, targets, *a, **k: seen.append(targets.count()) or plain(points, targets, *a, **k))
    return seen


def _copied(spark, n):
    """One point, n roads at one place and another, n bus stops."""
    points = spark.createDataFrame([(1, 39.9, 116.4)], "seq long, lat double, lon double")
    roads = spark.createDataFrame([(k, 39.9002, 116.4, "primary") for k in range(n, 0, -1)] + [(0, 39.9, 116.4009, "rail")], "node_id long, lat double, lon double, road_type string")
    return points, roads, spark.createDataFrame([(k, 39.9001, 116.4, "bus_stop") for k in range(n)], "poi_id long, lat double, lon double, poi_type string")


def test_density_counts_all_roads_of_a_place(spark, monkeypatch):
    points, roads, _ = _copied(spark, 30)
    seen = _pairs(monkeypatch)
    assert [r.road_density for r in spatial.road_density(points, roads, "seq").collect()] == [30 / 50] and seen == [2]


def test_nearest_of_roads_at_one_place_is_the_least(spark, monkeypatch):
    points, roads, _ = _copied(spark, 30)
    seen = _pairs(monkeypatch)
    assert [(r.node_id, r.road_type) for r in spatial.nearest(points, roads, "seq", "node_id", 150.0).collect()] == [(1, "primary")] and seen == [2]


def test_road_features_of_stops_at_one_place(spark, monkeypatch):
    seen = _pairs(monkeypatch)
    assert [tuple(r) for r in spatial.road_features(*_copied(spark, 30), "seq").collect()] == [(1, "car", True, "bus")] and seen == [2, 1]


def test_vector_of_copies_at_one_place(spark, monkeypatch):
    seen = _pairs(monkeypatch)
    (row,) = spatial.spatial_vector(*_copied(spark, 30), "seq").collect()
    assert (row.road_bus, row.has_bus_stop) == (1.0, 1.0) and row.road_density == 30 / 50 and seen == [3]
