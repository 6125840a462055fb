"""Readers of weather, predictions, evaluation reports, history and materialised stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.schemas import PREDICTIONS


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose first column is the date; other columns become doubles."""
    raw = spark.read.option("header", True).csv(path)
    first, *rest = raw.columns
    return raw.select(F.to_date(first).alias("date"), *(F.col(c).try_cast("double").alias(c) for c in rest))


def read_found_weather(spark: SparkSession, path: str) -> DataFrame:
    """date, prcp of a CSV with other names: the first column with date or time in its name, the first with prcp or precip (else 0)."""
    raw = spark.read.option("header", True).csv(path)
    named = lambda *parts: next((c for c in raw.columns if any(p in c.lower() for p in parts)), None)
    date, rain = named("date", "time"), named("prcp", "precip")
    if date is None:
        raise ValueError("no date column")
    return raw.select(F.to_date(F.to_timestamp(date)).alias("date"), (F.col(rain).try_cast("double") if rain else F.lit(0.0)).alias("prcp"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).option("header", True).csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """label, precision, recall, f1, support of an evaluation report, with or without a byte order mark.

    The scalar accuracy stands in precision, recall and f1 of its row.
    """
    text = spark.read.text(path, wholetext=True).select(F.ltrim(F.regexp_replace("value", "^﻿", "")).alias("v"))
    rows = text.select(F.explode(F.from_json("v", "map<string,string>")).alias("label", "body"))
    parsed = F.from_json("body", "precision double, recall double, `f1-score` double, support double")
    scalar = F.col("body").try_cast("double")
    return rows.select("label", parsed.alias("p"), scalar.alias("s")).select(
        "label", F.coalesce("p.precision", "s").alias("precision"), F.coalesce("p.recall", "s").alias("recall"), F.coalesce("p.`f1-score`", "s").alias("f1"), F.col("p.support").cast("long").alias("support"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Saved trips; points is JSON text and becomes an array of positions."""
    return spark.read.parquet(path).withColumn("points", F.from_json("points", "array<struct<lat: double, lon: double, timestamp: string>>"))


def read_stage(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    stage = spark.read.parquet(path)
    return stage if mode is None else stage.where(F.col("cleaning_mode") == mode)


def read_typed_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, blank lines skipped, types from the values; with a schema the file is read once only."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A managed table, such as users or their history."""
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[object, object] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database; with a column and its bounds it is read in that many parts at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column is not None and bounds is not None:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()
