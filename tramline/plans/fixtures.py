"""Tracks, labels, roads, POIs, weather and predictions derived from the driver's tables.

There is no GPS data at hand. These tables stand in for it: random walks from ``events``,
road nodes from ``part``, POIs from ``supplier``, weather days from ``orders``. oracles.py has the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.operators import kinematics, learning, segments


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_id") % 997 == 0, 1).otherwise(30 + F.col("event_id") % 61)
    drift = lambda prime: F.sum(((F.col("event_id") * prime) % 2001 - 1000) * (1 + F.col("user_id") % 40)).over(w)
    walked = table(spark, sf_dir, "events").select(
        "event_id", "user_id", (1704067200 + (F.col("user_id") % 60) * 86400 + ((F.col("user_id") * 7) % 24) * 3600 + F.sum(step).over(w)).alias("t"),
        (39900000 + drift(7919)).alias("lat6"), (116400000 + drift(104729)).alias("lon6"))
    return walked.select(
        "user_id", F.col("user_id").cast("string").alias("track_id"), F.col("event_id").alias("seq"), F.timestamp_seconds("t").alias("ts"),
        (F.col("lat6") / 1000000.0).alias("lat"), (F.col("lon6") / 1000000.0).alias("lon"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.kinematics(points(spark, sf_dir))


def mode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = points(spark, sf_dir).select("user_id", F.unix_seconds("ts").alias("t")).withColumn("k", F.floor((F.col("t") - 1704067200) / 1800.0))
    first = slots.groupBy("user_id", "k").agg(F.min("t").alias("t0"))
    names = ["walk", "bike", "bus", "taxi", "subway", "railway", "airplane", "boat"]
    mode = F.element_at(F.array(*map(F.lit, names)), ((F.col("user_id") * 3 + F.col("k")) % 8 + 1).cast("int"))
    return first.select("user_id", F.timestamp_seconds("t0").alias("start_ts"), F.timestamp_seconds(F.col("t0") + 1199).alias("end_ts"), mode.alias("raw_mode"))


def segment_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.label_join(features(spark, sf_dir), mode_labels(spark, sf_dir))


def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.statistics(segment_points(spark, sf_dir), ["segment_id", "label"])


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.when(F.col("p_partkey") % 2 == 0, 100000.0).otherwise(20000.0)
    names = ["footway", "cycleway", "primary", "secondary", "rail", "subway", "residential", "service"]
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("node_id"), (39.9 + ((F.col("p_partkey") * 7919) % 4001 - 2000) / spread).alias("lat"),
        (116.4 + ((F.col("p_partkey") * 104729) % 4001 - 2000) / spread).alias("lon"), F.element_at(F.array(*map(F.lit, names)), F.col("p_size") % 8 + 1).alias("road_type"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["bus_stop", "station", "parking", "taxi", "subway_entrance"]
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("poi_id"), (39.9 + ((F.col("s_suppkey") * 7907) % 4001 - 2000) / 20000.0).alias("lat"),
        (116.4 + ((F.col("s_suppkey") * 10007) % 4001 - 2000) / 20000.0).alias("lon"), F.element_at(F.array(*map(F.lit, names)), F.col("s_nationkey") % 5 + 1).alias("poi_type"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day for each date of ``orders``, moved to begin with 2024; its numbers come from that day's orders. Days 20 to 36 and every ninth are missing, as are some numbers."""
    i = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    days = table(spark, sf_dir, "orders").groupBy(i.alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("k"), F.sum("o_orderkey").alias("s")).where(~F.col("i").between(20, 36) & (F.col("i") % 9 != 4))
    return days.select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")).alias("date"), (F.col("k") % 45 - 10).cast("double").alias("temp"),
        F.when((F.col("n") + F.col("k")) % 5 != 0, (F.col("s") % 24) / 2.0).alias("prcp"), (4 + F.col("k") % 20).cast("double").alias("wspd"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each segment: its label, the rule classifier's, and a made-up confidence."""
    seen = segment_points(spark, sf_dir).groupBy("segment_id", "user_id", "label", "start_ts").agg(
        F.avg("speed").alias("avg_speed"), F.max("speed").alias("max_speed"), F.avg((F.col("speed") < 0.5).cast("double")).alias("stop_ratio"), F.count(F.lit(1)).alias("length"))
    guess = learning.rule_mode(F.col("avg_speed"), F.col("max_speed"), F.col("stop_ratio"), True)
    from tramline.functions.scalar import mapped
    from tramline.schemas import API_MODES

    return seen.select(
        "segment_id", "user_id", "start_ts", "length", F.col("label").alias("true_label"), mapped(guess, {v: k for k, v in API_MODES.items()}).alias("pred_label"),
        (0.5 + F.pmod(F.col("user_id") * 31 + F.unix_seconds("start_ts") * 17, F.lit(500)) / 1000.0).alias("confidence"))
