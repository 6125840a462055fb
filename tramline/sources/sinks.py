"""Writers: stages, predictions, reports, maps, history and model parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, mode: str) -> None:
    """One partition folder for each cleaning mode; writing one leaves the others."""
    writer = df.withColumn("cleaning_mode", F.lit(mode)).write.mode("overwrite").partitionBy("cleaning_mode")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    marked = predictions.withColumn("correct", F.col("true_label") == F.col("pred_label"))
    marked.write.mode("overwrite").option("header", True).csv(f"{path}/predictions")
    marked.where("not correct").write.mode("overwrite").option("header", True).csv(f"{path}/errors")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_heatmaps(green: DataFrame, intensity: DataFrame, path: str) -> None:
    """Two maps of different schemas under two names."""
    write_json(green.select("lat", F.col("lon").alias("lng"), F.col("n").alias("count"), "green_ratio"), f"{path}/green")
    write_json(intensity.select("cell_y", "cell_x", "value"), f"{path}/intensity")


def append_history(trips: DataFrame, path: str) -> None:
    """Adds trips; points become JSON text."""
    packed = trips.withColumn("points", F.to_json("points")) if dict(trips.dtypes).get("points", "string") != "string" else trips
    packed.write.mode("append").parquet(path)


def write_model(model, scaling: DataFrame, path: str) -> None:
    """A fitted Spark ML pipeline and the scaling of its columns."""
    model.write().overwrite().save(f"{path}/model")
    scaling.write.mode("overwrite").json(f"{path}/scaling")
