"""Point features of tracks, by window functions over chunks of each track in time order.

A track may hold a third of all points, so it is no window: it is cut into chunks of
CHUNK seconds, and windows stay inside them. What goes on over a cut (the last point, its
speed and bearing, sums so far) is one row for each chunk; windows over these rows carry
it on, and a join on track and chunk, for which the points stay where they are, hands it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.scalar import bearing, haversine, turned

LEAST_STEP = 1e-6
#: Seconds of a track that one task orders.
CHUNK = 86_400
_FIRST = -(1 << 62)


def valid_points(points: DataFrame) -> DataFrame:
    return points.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def long_tracks(points: DataFrame, least: int, track: str = "track_id") -> DataFrame:
    """Points of tracks with so many of them; counted by aggregation, so a track may be of any length."""
    key = F.struct(track).alias("_k")
    long = points.groupBy(key).count().where(F.col("count") >= least).select("_k")
    return points.withColumn("_k", key).join(long, "_k", "left_semi").drop("_k")


def whole_rows(df: DataFrame) -> Column:
    """An aggregate that reads all columns: with it, what is summed up and what is joined need the same exchange, which Spark then makes once."""
    return F.bit_xor(F.xxhash64(*df.columns)).alias("_whole")


def chunk_of(order: str, chunk: int | None) -> Column:
    """Number of the chunk of a place; rows without a place come first."""
    return F.lit(0).cast("long") if chunk is None else F.coalesce(F.floor(F.col(order) / chunk).cast("long"), F.lit(_FIRST))


def _moved(lat0: Column, lon0: Column, time0: Column, lat: Column, lon: Column, time: Column) -> dict[str, Column]:
    known = lat0.isNotNull()
    gap = F.coalesce((time - time0) / 1e6, F.lit(0.0))
    distance = F.when(known, haversine(lat0, lon0, lat, lon)).otherwise(0.0)
    return {"time_diff": gap, "distance": distance, "bearing": F.when(known, bearing(lat0, lon0, lat, lon)).otherwise(0.0), "speed": distance / _span(gap)}


def _span(gap: Column) -> Column:
    return F.when(gap == 0, LEAST_STEP).otherwise(gap)


def _named(values: dict[str, Column], prefix: str) -> list[Column]:
    return [v.alias(prefix + k) for k, v in values.items()]


def kinematics(points: DataFrame, track: str = "track_id", chunk: int = CHUNK) -> DataFrame:
    """Adds step, time_diff, distance, speed, acceleration, bearing, bearing_change, total_distance, total_time.

    The first point of a track has zeros. A step of no time counts as LEAST_STEP seconds in
    divisions. Points of one time follow each other by seq. A task holds at most the points of
    ``chunk`` seconds of a track; the results don't depend on it but for the last places of sums.
    """
    at = F.unix_micros("ts")
    base = points.select("*", F.struct(track).alias("_k"), F.coalesce(F.floor(F.unix_seconds("ts") / chunk), F.lit(_FIRST)).alias("_c"))
    w = Window.partitionBy("_k", "_c").orderBy("ts", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = base.select("*", F.row_number().over(w).alias("_r"), F.lag(at).over(w).alias("_at"), F.lag("lat").over(w).alias("_lat"), F.lag("lon").over(w).alias("_lon"))
    moves = steps.select(*base.columns, "_r", *_named(_moved(F.col("_lat"), F.col("_lon"), F.col("_at"), F.col("lat"), F.col("lon"), at), "_"))
    inside = moves.select(
        "*", F.lag("_speed").over(w).alias("_speed0"), F.lag("_bearing").over(w).alias("_bearing0"), F.sum("_distance").over(so_far).alias("_far"), F.sum("_time_diff").over(so_far).alias("_long"))

    # One row for each chunk; the first chunk of a track needs nothing from before.
    point = F.struct("lat", "lon", at.alias("at"))
    ends = inside.groupBy("_k", "_c").agg(
        F.min_by(point, "_r").alias("first"), F.max_by(point, "_r").alias("last"), F.max("_r").alias("n"), F.coalesce(F.sum("_distance"), F.lit(0.0)).alias("far"), F.sum("_time_diff").alias("long"),
        F.max_by(F.struct("_speed", "_bearing"), "_r").alias("end"), whole_rows(base)).where("_whole is not null")
    v = Window.partitionBy("_k").orderBy("_c")
    before = v.rowsBetween(Window.unboundedPreceding, -1)
    edge = _moved(*(F.col(f"last0.{c}") for c in ("lat", "lon", "at")), *(F.col(f"first.{c}") for c in ("lat", "lon", "at")))
    linked = ends.withColumn("last0", F.lag("last").over(v)).select("*", *_named(edge, "edge_"))
    tail = lambda c: F.lag(F.when(F.col("n") > 1, F.col(f"end._{c}")).otherwise(F.col(f"edge_{c}"))).over(v).alias(f"tail_{c}")
    added = F.coalesce("edge_distance", F.lit(0.0))
    carried = linked.select(
        "_k", "_c", *(f"edge_{c}" for c in edge), tail("speed"), tail("bearing"), F.col("last0").isNotNull().alias("later"), F.sum("n").over(before).alias("steps"),
        (F.sum(F.col("far") + added).over(before) + added).alias("far"), (F.sum(F.col("long") + F.col("edge_time_diff")).over(before) + F.col("edge_time_diff")).alias("long")).where("later")

    joined = inside.join(carried, ["_k", "_c"], "left")
    first, second, later = F.col("_r") == 1, F.col("_r") == 2, F.col("later").isNotNull()
    own = {c: F.when(first & later, F.col(f"edge_{c}")).otherwise(F.col(f"_{c}")) for c in edge}
    last = {c: F.when(first, F.col(f"tail_{c}")).when(second & later, F.col(f"edge_{c}")).otherwise(F.col(f"_{c}0")) for c in ("speed", "bearing")}
    none = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        *points.columns, (none("steps") + F.col("_r")).cast("long").alias("step"), own["time_diff"].alias("time_diff"), own["distance"].alias("distance"), own["speed"].alias("speed"),
        F.coalesce((own["speed"] - last["speed"]) / _span(own["time_diff"]), F.lit(0.0)).alias("acceleration"), own["bearing"].alias("bearing"),
        F.coalesce(turned(own["bearing"], last["bearing"]), F.lit(0.0)).alias("bearing_change"), (none("far") + F.col("_far")).alias("total_distance"), (none("long") + F.col("_long")).alias("total_time"))


def trip_summary(features: DataFrame, track: str = "track_id") -> DataFrame:
    """Distance, duration, average and largest speed of each track."""
    return features.groupBy(track).agg(
        F.sum("distance").alias("distance"), F.sum("time_diff").alias("duration"),
        (F.sum("distance") / (F.sum("time_diff") + 1e-6)).alias("avg_speed"), F.max("speed").alias("max_speed"), F.count(F.lit(1)).alias("n_points"),
    )


def time_features(features: DataFrame, track: str = "track_id") -> DataFrame:
    """The twelve stand-in features where there is no road index: position, motion and cyclic time."""
    hour, day = F.hour("ts") / 24.0, F.weekday("ts") / 6.0
    top = F.max("speed").over(Window.partitionBy(track))
    two_pi = 6.283185307179586
    return features.select(
        track, "seq", F.col("lat").alias("f0"), F.col("lon").alias("f1"), F.col("speed").alias("f2"), F.col("acceleration").alias("f3"),
        hour.alias("f4"), day.alias("f5"), F.sin(two_pi * hour).alias("f6"), F.cos(two_pi * hour).alias("f7"), F.sin(two_pi * day).alias("f8"),
        F.cos(two_pi * day).alias("f9"), (F.col("speed") / (top + 1e-6)).alias("f10"), F.least(F.lit(1.0), F.col("speed") / 15.0).alias("f11"),
    )
