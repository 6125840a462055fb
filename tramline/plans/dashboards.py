"""Dashboard questions over predictions, points and history, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline import schemas
from tramline.functions.scalar import carbon_kg, green


def shares(df: DataFrame, by: str, of: str = "label", values: tuple[str, ...] = schemas.MODES) -> DataFrame:
    """by, and the percentage of each value in it, two decimals, 0 where there is none."""
    counts = df.groupBy(by).pivot(of, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return counts.select(by, *(F.coalesce(F.round(F.try_divide(F.col(f"`{v}`") * 100.0, total), 2), F.lit(0.0)).alias(v) for v in values))


def distribution(df: DataFrame, of: str = "label", by: list[str] | None = None) -> DataFrame:
    """Count and percentage of each value, in each group if given."""
    by = by or []
    counts = df.groupBy(*by, of).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 2))


def hourly_share(points: DataFrame, value: str, of: str = "label", ts: str = "ts") -> DataFrame:
    """Percentage of the value in each of the 24 hours, 0 where there is no point."""
    seen = points.groupBy(F.hour(ts).alias("hour")).agg(F.avg((F.col(of) == value).cast("double")).alias("_s"))
    hours = points.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(seen, "hour", "left").select("hour", F.round(F.coalesce(F.col("_s") * 100.0, F.lit(0.0)), 2).alias("share"))


def top_errors(predictions: DataFrame, k: int = 5) -> DataFrame:
    """Classes with most misclassified segments; ties by name."""
    wrong = predictions.where("true_label != pred_label").groupBy("true_label").agg(F.count(F.lit(1)).alias("n_errors"))
    return wrong.orderBy(F.desc("n_errors"), "true_label").limit(k)


def five_numbers(predictions: DataFrame, by: str = "pred_label", value: str = "confidence") -> DataFrame:
    marks = (("minimum", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("maximum", 1.0))
    return predictions.groupBy(by).agg(*(F.percentile(value, F.lit(p)).alias(n) for n, p in marks))


def pivoted_confusion(predictions: DataFrame, labels: tuple[str, ...] = schemas.MODES) -> DataFrame:
    return predictions.groupBy("true_label").pivot("pred_label", list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def carbon(predictions: DataFrame, km: float = 2.0, per_km: float = 0.08, per_tree: float = 18.0) -> DataFrame:
    """Carbon that rightly recognised green segments save, and what trees that makes."""
    right = predictions.agg(F.count(F.when((F.col("true_label") == F.col("pred_label")) & green(F.col("true_label"), True), 1)).alias("n_green"))
    return right.select("n_green", (F.col("n_green") * km * per_km).alias("carbon_kg"), (F.col("n_green") * km * per_km / per_tree).alias("trees"))


def green_summary(predictions: DataFrame, transit: bool = True) -> DataFrame:
    return predictions.agg(
        F.count(F.lit(1)).alias("n"), F.sum(green(F.col("pred_label"), transit).cast("long")).alias("n_green"),
        F.avg(green(F.col("pred_label"), transit).cast("double")).alias("green_share"), F.avg("confidence").alias("mean_confidence"))


def dataset_stats(segments: DataFrame) -> DataFrame:
    return segments.agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("user_id").alias("users"), F.countDistinct("true_label").alias("modes"), F.avg("length").alias("mean_length"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    hit = F.col("true_label") == F.col("pred_label")
    return predictions.agg(
        F.count(F.lit(1)).alias("total"), F.sum(hit.cast("long")).alias("correct"), F.sum((~hit).cast("long")).alias("wrong"), F.avg(hit.cast("double")).alias("accuracy"))


def user_history(history: DataFrame, user: int) -> DataFrame:
    return history.where(F.col("user_id") == user).orderBy(F.desc("created_at"), "trajectory_id")


def page(history: DataFrame, number: int, size: int) -> DataFrame:
    """One page of rows, newest first; pages count from 1."""
    return history.orderBy(F.desc("created_at"), "trajectory_id").offset((number - 1) * size).limit(size)


def user_profile(history: DataFrame) -> DataFrame:
    """Trips, slow and green shares, level and saved carbon of each user; distances are metres."""
    slow = F.col("mode").isin("Walk", "Bike")
    return history.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("trips"), F.avg(slow.cast("double")).alias("slow_share"), F.avg(green(F.col("mode"), True).cast("double")).alias("green_share"),
        (F.floor(F.count(F.lit(1)) / 10) + 1).alias("level"), F.sum(carbon_kg(F.col("mode"), F.col("distance") / 1000.0)).alias("carbon_kg"))


def trip_carbon(history: DataFrame, car: float = 0.24, per_kg: float = 0.05) -> DataFrame:
    """Carbon and trees of each trip: against a car, for green modes only, never below 0."""
    from tramline.functions.scalar import mapped

    factor = mapped(F.col("mode"), {"Walk": 0.0, "Bike": 0.0, "Bus": 0.06, "Subway": 0.04}, F.lit(car))
    saved = F.greatest(F.lit(0.0), (car - factor) * F.col("distance") / 1000.0)
    kg = F.when(green(F.col("mode"), True), saved).otherwise(0.0)
    return history.select("trajectory_id", "mode", kg.alias("carbon_kg"), (kg * per_kg).alias("trees"))


def compare_regions(regions: DataFrame, margin: float = 0.05) -> DataFrame:
    """Each region's ratio against the mean of all regions. regions: region, ratio."""
    mean = F.avg("ratio").over(Window.partitionBy(F.lit(0)))
    gap = F.col("ratio") - mean
    return regions.select("region", "ratio", mean.alias("mean_ratio"), F.when(gap > margin, "higher").when(gap < -margin, "lower").otherwise("equal").alias("verdict"))


def top_regions(regions: DataFrame, k: int = 5) -> DataFrame:
    return regions.orderBy(F.desc("ratio"), "region").limit(k)


def reshape_report(reports: DataFrame) -> DataFrame:
    """Rows (label, precision, recall, f1) to one row of three maps; accuracy and averages are left out."""
    rows = reports.where(~F.col("label").isin("accuracy", "macro avg", "weighted avg"))
    made = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.coalesce(c, F.lit(0.0)))))).alias(c)
    return rows.agg(made("precision"), made("recall"), made("f1"))


def experiment_trend(reports: DataFrame) -> DataFrame:
    """experiment, accuracy, macro_f1 of rows (experiment, label, f1)."""
    pick = lambda name: F.max(F.when(F.col("label") == name, F.col("f1")))
    return reports.groupBy("experiment").agg(pick("accuracy").alias("accuracy"), pick("macro avg").alias("macro_f1"))


def gain_shares(trend: DataFrame) -> DataFrame:
    """What share of the whole gain of macro F1 each experiment adds to the one before; null where there is no gain."""
    w = Window.partitionBy(F.lit(0)).orderBy("experiment")
    gains = trend.withColumn("gain", F.col("macro_f1") - F.lag("macro_f1").over(w)).where("gain is not null")
    total = F.sum("gain").over(Window.partitionBy(F.lit(0)))
    return gains.select("experiment", "gain", F.when(total > 0, F.col("gain") / total).alias("share"))


def recall_series(reports: DataFrame, labels: tuple[str, ...] = ("Bike", "Bus")) -> DataFrame:
    return reports.where(F.col("label").isin(*labels)).select("experiment", "label", "recall")


def ramp(ratio):
    """Red, green, blue of a green ratio."""
    return F.struct(F.floor(255 * (1 - ratio)).alias("red"), F.floor(255 * ratio + 100 * (1 - ratio)).alias("green"), F.floor(50 * (1 - ratio)).alias("blue"))


def map_scale(regions: DataFrame, value: str = "ratio", at: float = 0.8) -> DataFrame:
    """The value at floor(at * n) of the sorted positive ones. Regions are few."""
    w = Window.partitionBy(F.lit(0))
    ranked = regions.where(F.col(value) > 0).select(F.row_number().over(w.orderBy(value)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"), F.col(value).alias("scale"))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") * at) + 1).select("scale")


def with_status(experiments: DataFrame, status: str) -> DataFrame:
    """Experiments of one status, such as completed or not_trained."""
    return experiments.where(F.col("status") == status)


def mode_list(segments: DataFrame) -> DataFrame:
    """Each known mode, its name in the interface, and how many labelled segments there are of it."""
    counts = segments.select("segment_id", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n_segments"))
    modes = segments.sparkSession.createDataFrame(list(schemas.API_MODES.items()), "label string, api string")
    return modes.join(counts, "label", "left").select("label", "api", F.coalesce("n_segments", F.lit(0)).alias("n_segments"))
