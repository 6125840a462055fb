"""Cutting tracks by label intervals, and the statistics of a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.scalar import normal_mode
from tramline.operators.kinematics import chunk_of, whole_rows

EPS = 1e-8
DAY = 86400
#: Points of a segment that one task orders.
CHUNK = 1 << 16


def label_join(points: DataFrame, labels: DataFrame, user: str = "user_id", least_points: int = 10) -> DataFrame:
    """Points inside the label intervals of their user, both ends included.

    labels: user, start_ts, end_ts, raw_mode. A point in overlapping intervals counts in
    each. The join is by user and day: an interval is repeated for each day that it
    touches, so a user of many years is no single group, and the condition on the bounds
    filters what is left. Segments of fewer points are left out.
    """
    days = labels.select(
        F.col(user), "start_ts", "end_ts", normal_mode(F.col("raw_mode")).alias("label"),
        F.explode(F.sequence(F.floor(F.unix_seconds("start_ts") / DAY), F.floor(F.unix_seconds("end_ts") / DAY))).alias("_day"),
    ).where(F.col("start_ts") <= F.col("end_ts"))
    dated = points.withColumn("_day", F.floor(F.unix_seconds("ts") / DAY))
    inside = dated.join(days, [user, "_day"]).where(F.col("ts").between(F.col("start_ts"), F.col("end_ts"))).drop("_day")
    keyed = inside.withColumn("segment_id", segment_id(F.col(user), F.col("track_id"), F.col("start_ts"), F.col("end_ts")))
    size = F.count(F.lit(1)).over(Window.partitionBy("segment_id"))
    return keyed.withColumn("length", size).where(F.col("length") >= least_points)


def segment_id(user, track, start, end):
    return F.concat_ws("_", user, track, F.date_format(start, "yyyyMMddHHmmss"), F.date_format(end, "yyyyMMddHHmmss"))


def length_summary(segments: DataFrame) -> DataFrame:
    """Count, share and lengths of the segments of each label. segments: label, length."""
    return segments.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.avg("length").alias("mean_length"), F.percentile("length", F.lit(0.5)).alias("median_length"),
    ).withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))))


def _flips_and_runs(first: Column, last: Column) -> Column:
    """struct<flips, run>: sign changes over the cuts, and the longest fast run that a cut touches, of the ends of chunks in order.

    first, last: array<struct<c, fast, sign>>, the first and last points of all chunks, of which ``last`` also
    knows the chunk's size. A run goes on over a chunk that is fast as a whole.
    """
    ends = F.zip_with(F.array_sort(first), F.array_sort(last), lambda a, b: F.struct(a["fast"].alias("head"), a["sign"].alias("from"), b["fast"].alias("tail"), b["sign"].alias("to"), b["n"].alias("n")))
    start = F.struct(F.lit(0).cast("long").alias("flips"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("open"), F.lit(None).cast("double").alias("to"))

    def step(x: Column, e: Column) -> Column:
        grown = x["open"] + e["head"]
        return F.struct(
            (x["flips"] + F.coalesce((x["to"] != e["from"]).cast("long"), F.lit(0))).alias("flips"), F.greatest(x["run"], grown).alias("run"),
            F.when(e["head"] == e["n"], grown).otherwise(e["tail"]).alias("open"), e["to"].alias("to"))

    return F.aggregate(ends, start, step)


def statistics(points: DataFrame, keys: list[str] | None = None, order: str = "step", chunk: int | None = None) -> DataFrame:
    """The 18 statistics of each segment.

    points: keys, an order column, speed, acceleration, bearing_change, distance, time_diff,
    total_distance, total_time, lat, lon. A segment is as long as its label interval, and one exchange by the keys
    serves the windows and the aggregation. Where an interval may hold more points than a task should, give ``chunk``
    (CHUNK, say): segments are cut after so many places of the order column, sums are added up from
    partial ones, and runs and changes of sign go on over the cuts by the ends of the chunks.
    """
    keys = keys or ["segment_id"]
    sign = F.signum("acceleration")
    plain = points.select(
        F.struct(*keys).alias("_k"), chunk_of(order, chunk).alias("_c"), F.col(order).alias("_o"), "lat", "lon", "total_distance", "total_time",
        F.greatest("speed", F.lit(0.0)).alias("_v"), F.abs("acceleration").alias("_a"), F.abs("bearing_change").alias("_b"), F.greatest("distance", F.lit(0.0)).alias("_d"),
        F.greatest("time_diff", F.lit(0.0)).alias("_t"), sign.alias("_sign"))
    by = Window.partitionBy("_k", "_c")
    w = by.orderBy("_o")
    chunk_top = F.max("_v").over(by)
    base = plain.select("*", (F.col("_sign") != F.lag("_sign").over(w)).cast("int").alias("_flip"), F.row_number().over(w).alias("_r"), chunk_top.alias("_top"), F.count(F.lit(1)).over(by).alias("_n"))
    fast = Window.partitionBy("_k", "_c", F.col("_v") > 10).orderBy("_o")
    runs = base.withColumn("_run", F.when(F.col("_v") > 10, F.col("_r") - F.row_number().over(fast)))
    run_length = F.count(F.lit(1)).over(Window.partitionBy("_k", "_c", "_run"))
    runs = runs.withColumn("_fast", F.when(F.col("_run").isNotNull(), run_length).otherwise(0))
    # The top speed of a whole segment, where it has several chunks, comes from one row for each of them.
    tops = plain.groupBy("_k", "_c").agg(F.max("_v").alias("_top"), whole_rows(plain)).where("_whole is not null")
    whole = Window.partitionBy("_k")
    tops = tops.select("_k", "_c", F.max("_top").over(whole).alias("_higher"), F.count(F.lit(1)).over(whole).alias("_chunks")).where("_chunks > 1").drop("_chunks")
    runs = runs.withColumn("_higher", F.lit(None).cast("double")) if chunk is None else runs.join(tops, ["_k", "_c"], "left")
    bin_ = F.least(F.floor(F.col("_v") / (F.coalesce("_higher", "_top") + EPS) * 10), F.lit(9)).cast("int")
    binned = runs.withColumn("_bin", bin_).withColumn("_r", F.struct("_c", "_r"))
    end = F.struct(F.col("_c").alias("c"), F.col("_fast").alias("fast"), F.col("_sign").alias("sign"), F.col("_n").alias("n"))
    cut_ends = [F.collect_list(F.when(F.col("_higher").isNotNull() & (F.col("_r._r") == at), end)).alias(name) for at, name in ((F.lit(1), "_firsts"), (F.col("_n"), "_lasts"))]
    n = F.count(F.lit(1))
    histogram = [F.sum((F.col("_bin") == k).cast("long")).alias(f"_h{k}") for k in range(10)]
    agg = binned.groupBy("_k").agg(
        n.alias("n_points"), F.avg("_v").alias("speed_mean"), F.stddev_pop("_v").alias("speed_std"), F.max("_v").alias("speed_max"),
        F.avg("_a").alias("accel_mean"), F.stddev_pop("_a").alias("accel_std"), F.max("_a").alias("accel_max"),
        F.avg("_b").alias("bearing_mean"), F.stddev_pop("_b").alias("bearing_std"),
        F.avg((F.col("_v") < 0.5).cast("double")).alias("stop_ratio"), F.avg((F.col("_v") > 15).cast("double")).alias("high_speed_ratio"),
        F.min_by("lat", "_r").alias("_lat0"), F.min_by("lon", "_r").alias("_lon0"), F.max_by("lat", "_r").alias("_lat1"), F.max_by("lon", "_r").alias("_lon1"),
        F.max_by("total_distance", "_r").alias("_dist"), F.max_by("total_time", "_r").alias("_time"), F.sum("_d").alias("_sum_d"), F.sum("_t").alias("_sum_t"),
        F.sum("_flip").alias("_flips"), F.max("_fast").alias("_fast"), *histogram, *cut_ends,
    )
    cuts = _flips_and_runs(F.col("_firsts"), F.col("_lasts"))
    agg = agg.withColumn("_cuts", cuts).select("_k.*", "*").withColumns({"_flips": F.coalesce("_flips", F.lit(0)) + F.col("_cuts.flips"), "_fast": F.greatest("_fast", "_cuts.run")})
    distance = F.when(F.col("_dist") > 0, F.col("_dist")).otherwise(F.col("_sum_d"))
    time = F.when(F.col("_time") > 0, F.col("_time")).otherwise(F.col("_sum_t"))
    straight = F.sqrt(
        F.pow((F.col("_lat1") - F.col("_lat0")) * 111300.0, 2.0) + F.pow((F.col("_lon1") - F.col("_lon0")) * 111300.0 * F.cos(F.radians("_lat0")), 2.0))
    entropy = sum((F.when(F.col(f"_h{k}") > 0, -(F.col(f"_h{k}") / (F.col("n_points") + EPS)) * F.log(F.col(f"_h{k}") / (F.col("n_points") + EPS) + EPS)).otherwise(0.0) for k in range(10)), F.lit(0.0))
    out = agg.withColumn("total_distance", distance).withColumn("total_time", time)
    values = {
        "speed_cv": F.col("speed_std") / (F.col("speed_mean") + EPS),
        "linearity": F.when(F.col("total_distance") <= EPS, 0.0).otherwise(F.least(straight / (F.col("total_distance") + EPS), F.lit(1.0))),
        "avg_segment_speed": F.col("total_distance") / (F.col("total_time") + EPS),
        "speed_entropy": F.when(F.col("speed_max") <= EPS, 0.0).otherwise(entropy),
        "accel_sign_changes": F.when(F.col("n_points") < 2, 0.0).otherwise(F.coalesce(F.col("_flips"), F.lit(0)) / F.greatest(F.col("n_points") - 1, F.lit(1))),
        "max_sustained_speed": F.col("_fast") / F.col("n_points"),
    }
    from tramline.schemas import STATS

    finite = [F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v).alias(s) for s in STATS for v in [values.get(s, F.col(s))]]
    return out.select(*keys, "n_points", *finite)
