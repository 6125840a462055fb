"""Segments at a fixed number of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.schemas import SEGMENT_LENGTH


def _numbered(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    by = Window.partitionBy(*keys)
    return points.withColumns({"_r": F.row_number().over(by.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(by)})


def _slots(numbered: DataFrame, keys: list[str], length: int) -> DataFrame:
    """The slots of each segment and the place in it that each one reads."""
    sizes = numbered.groupBy(*keys).agg(F.max("_n").alias("_n"))
    slots = sizes.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    place = F.when(F.col("slot") == length - 1, F.col("_n") - 1.0).otherwise(F.col("slot") * ((F.col("_n") - 1) / float(length - 1)))
    return slots.withColumn("_place", place)


def resample(points: DataFrame, keys: list[str], columns: list[str], length: int = SEGMENT_LENGTH, order: str = "step") -> DataFrame:
    """keys, slot, columns: picks places at even distances of longer segments, draws lines between the points of shorter ones."""
    numbered = _numbered(points, keys, order)
    slots = _slots(numbered, keys, length)
    low = F.floor("_place").cast("int")
    wanted = slots.select(*keys, "slot", "_place", low.alias("_r"), (F.col("_n") > length).alias("_picks"))
    here = numbered.select(*keys, "_r", *columns)
    w = Window.partitionBy(*keys).orderBy("_r")
    ahead = here.select(*keys, "_r", *columns, *(F.lead(c).over(w).alias(f"_{c}") for c in columns))
    joined = wanted.join(ahead, [*keys, "_r"])
    share = F.when(F.col("_picks"), 0.0).otherwise(F.col("_place") - F.col("_r"))
    return joined.select(*keys, "slot", *((F.col(c) + share * (F.coalesce(F.col(f"_{c}"), F.col(c)) - F.col(c))).alias(c) for c in columns))


def resample_times(points: DataFrame, keys: list[str], length: int = SEGMENT_LENGTH, order: str = "step") -> DataFrame:
    """keys, slot, ts: the picked times of longer segments; of shorter ones all, then the last again."""
    numbered = _numbered(points, keys, order)
    slots = _slots(numbered, keys, length)
    wanted = slots.select(*keys, "slot", F.when(F.col("_n") > length, F.floor("_place").cast("int")).otherwise(F.least(F.col("slot"), F.col("_n") - 1)).alias("_r"))
    return wanted.join(numbered.select(*keys, "_r", "ts"), [*keys, "_r"]).select(*keys, "slot", "ts")


def pad(points: DataFrame, keys: list[str], columns: list[str], length: int = SEGMENT_LENGTH, order: str = "step") -> DataFrame:
    """keys, slot, columns: the picked places of longer segments; shorter ones end in zeros."""
    numbered = _numbered(points, keys, order)
    slots = _slots(numbered, keys, length)
    wanted = slots.select(*keys, "slot", F.when(F.col("_n") > length, F.floor("_place").cast("int")).otherwise(F.col("slot")).alias("_r"))
    return wanted.join(numbered.select(*keys, "_r", *columns), [*keys, "_r"], "left").select(*keys, "slot", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))


def fit_length(points: DataFrame, keys: list[str], columns: list[str], length: int = 100, order: str = "step", seed: int = 42) -> DataFrame:
    """keys, slot, columns: segments of over twice the length by even picks, of over the length a stretch from a place that a hash
    of the segment draws, shorter ones with zeros at their end."""
    numbered = _numbered(points, keys, order)
    slots = _slots(numbered, keys, length)
    spot = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    start = F.pmod(spot, F.col("_n") - length + 1)
    row = F.when(F.col("_n") > 2 * length, F.floor("_place")).when(F.col("_n") > length, start + F.col("slot")).otherwise(F.col("slot")).cast("int")
    wanted = slots.select(*keys, "slot", row.alias("_r"))
    return wanted.join(numbered.select(*keys, "_r", *columns), [*keys, "_r"], "left").select(*keys, "slot", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))


def model_input(statistics: DataFrame, keys: list[str], series: DataFrame | None = None) -> DataFrame:
    """Statistics of each segment alone, or with its resampled rows (keys, slot, columns) as an array in the order of the slots."""
    if series is None:
        return statistics
    columns = [c for c in series.columns if c not in keys]
    rows = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", *(c for c in columns if c != "slot")))).alias("series"))
    return statistics.join(rows, keys, "left")


def reconcile(slots: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Slots with the columns of another series of the same keys and slots; zeros where that ends early or has no such segment, nothing beyond the slots."""
    return slots.join(other.select(*keys, "slot", *columns), [*keys, "slot"], "left").na.fill(0.0, columns)
