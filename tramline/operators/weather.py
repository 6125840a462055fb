"""Daily weather: derived flags, calendar gaps, and the nearest day of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.schemas import WEATHER_DEFAULTS

FEATURES = ("temp", "tmin", "tmax", "prcp", "wspd", "is_rainy", "is_heavy_rain", "is_snowy", "is_cold", "is_hot")


def fill_defaults(weather: DataFrame) -> DataFrame:
    """Adds missing columns and fills nulls and NaN by the default of each column."""
    have = set(weather.columns)
    return weather.select("date", *(
        F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(v)).alias(c) if c in have else F.lit(v).alias(c) for c, v in WEATHER_DEFAULTS.items()))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def with_flags(weather: DataFrame) -> DataFrame:
    return weather.withColumns({
        "is_rainy": _flag(F.col("prcp") > 0.5), "is_heavy_rain": _flag(F.col("prcp") > 10), "is_snowy": _flag((F.col("prcp") > 0.5) & (F.col("temp") < 2)),
        "is_cold": _flag(F.col("temp") < 0), "is_hot": _flag(F.col("temp") > 30)})


def nearest_day(dates: DataFrame, weather: DataFrame, days: int = 7) -> DataFrame:
    """(date, weather_date, columns of weather) of the nearest day up to so many days off, the earlier of two; null if there is none.

    dates: one row for each distinct date. Each weather day is repeated for the dates it may
    serve, so the join is by equal dates.
    """
    values = [c for c in weather.columns if c != "date"]
    reach = weather.select(F.col("date").alias("weather_date"), *values, F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("date"))
    gap = F.abs(F.date_diff("date", "weather_date"))
    best = dates.join(reach, "date").groupBy("date").agg(F.min(F.struct(gap.alias("gap"), "weather_date", *values)).alias("_b")).select("date", "_b.*").drop("gap")
    return dates.join(best, "date", "left")


def point_weather(points: DataFrame, weather: DataFrame, key: str, days: int = 7) -> DataFrame:
    """The ten weather features of each point's day; zeros where no day is near. Only distinct dates are looked up."""
    dated = points.select(key, F.to_date("ts").alias("date"))
    found = nearest_day(dated.select("date").distinct(), with_flags(fill_defaults(weather)), days)
    return dated.join(found, "date").select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES))


def calendar(weather: DataFrame) -> DataFrame:
    """One row for each day from the first to the last."""
    ends = weather.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("date")).join(weather, "date", "left")


def interpolate(daily: DataFrame, column: str, default: float, limit: int = 7) -> DataFrame:
    """Gaps on the line between their ends, the first ``limit`` days of each; after the last value it stays so long; then the default.

    daily: one row for each day of one station, a few thousand for decades: one window.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    day = F.when(F.col(column).isNotNull(), F.col("date"))
    known = daily.select(
        "*", F.last(column, True).over(before).alias("_v0"), F.last(day, True).over(before).alias("_d0"),
        F.first(column, True).over(after).alias("_v1"), F.first(day, True).over(after).alias("_d1"))
    away = F.date_diff("date", "_d0")
    line = F.coalesce(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * away / F.nullif(F.date_diff("_d1", "_d0"), F.lit(0)), F.col("_v0"))
    value = F.coalesce(F.col(column), F.when(away <= limit, line), F.lit(default))
    return known.withColumn(column, value).drop("_v0", "_d0", "_v1", "_d1")


def missing_rates(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Share of missing values by column."""
    rates = daily.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return rates.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_rate")) for c in columns))).alias("r")).select("r.*")


def station_features(daily: DataFrame) -> DataFrame:
    """Main temperature, flags, scaled temperature, month and season (0 winter) of station data."""
    have = set(daily.columns)
    mean = (F.col("tmin") + F.col("tmax")) / 2 if {"tmin", "tmax"} <= have else F.lit(None).cast("double")
    temp = F.coalesce("tavg", mean) if "tavg" in have else mean
    month = F.month("date")
    out = daily.withColumn("temp", temp)
    snow = F.col("snwd") > 0 if "snwd" in have else F.lit(False)
    return out.withColumns({
        "is_rainy": _flag(F.col("prcp") > 0.5), "is_heavy_rain": _flag(F.col("prcp") > 10), "is_snowy": _flag(snow), "is_cold": _flag(F.col("temp") < 0),
        "is_hot": _flag(F.col("temp") > 30), "is_windy": _flag(F.col("wspd") > 6), "temp_norm": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("temp") + 20) / 60.0)),
        "month": month, "season": F.floor(F.pmod(month, F.lit(12)) / 3).cast("int")})


def climate_summary(weather: DataFrame) -> DataFrame:
    return with_flags(weather).agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.avg("temp").alias("mean_temp"),
        F.sum("is_rainy").alias("rainy_days"), F.sum("is_snowy").alias("snowy_days"), F.sum("is_cold").alias("cold_days"), F.sum("is_hot").alias("hot_days"))


def stand_in(points: DataFrame, key: str) -> DataFrame:
    """Made-up weather by the clock, for want of data; not comparable with real features."""
    h = F.hour("ts")
    t = h + F.minute("ts") / 60.0
    pi = 3.141592653589793
    day = (h >= 6) & (h < 18)
    return points.select(
        key, day.cast("double").alias("w0"), F.when(day, 18.0 + 7.0 * F.sin((t - 6) * pi / 12)).otherwise(12.0 + 5.0 * F.sin((t - 18) * pi / 12)).alias("w1"),
        (0.4 + 0.4 * F.sin(t * pi / 12)).alias("w2"), (1013.25 + 4.0 * F.sin(t * pi / 6)).alias("w3"), (3.0 + 4.0 * F.sin(t * pi / 8)).alias("w4"),
        (0.2 + 0.5 * F.sin(t * pi / 10)).alias("w5"), F.lit(0.0).alias("w6"), (h.isin(7, 8, 17, 18)).cast("double").alias("w7"),
        F.sin(2 * pi * t / 24).alias("w8"), F.cos(2 * pi * t / 24).alias("w9"))


def rain_by_day(points: DataFrame, weather: DataFrame) -> DataFrame:
    """Adds is_rainy of the point's very day, 0 where it is unknown."""
    rain = weather.select("date", _flag(F.col("prcp") > 0).cast("int").alias("is_rainy"))
    return points.withColumn("date", F.to_date("ts")).join(rain, "date", "left").withColumn("is_rainy", F.coalesce("is_rainy", F.lit(0)))
