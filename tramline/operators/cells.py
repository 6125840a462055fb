"""A store of the spatial vectors of grid cells, which later runs read instead of roads and POIs.

A cell's vector is that of its first point, the one of the least key among those that came
when the cell was not known. Each run adds a version with the cells it had to compute and one row of what it found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.scalar import DEGREE
from tramline.operators import spatial

SIDE = 0.001
#: Metres within which roads and POIs count for a vector.
REACH = 300.0


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return found


def placed(points: DataFrame, key: str, side: float = SIDE) -> DataFrame:
    """(key, lat, lon, cell_y, cell_x): half-even rounding, as ``spatial.cell_shared``."""
    cell = lambda c: F.rint(F.col(c) / side).cast("long")
    return points.select(F.col(key).alias("key"), "lat", "lon", cell("lat").alias("cell_y"), cell("lon").alias("cell_x"))


def stored_cells(spark: SparkSession, path: str) -> DataFrame | None:
    """(cell_y, cell_x, key, vector) of all versions; where two runs at one time both had a cell, the least key's."""
    rows = _table(spark, f"{path}/cells")
    return None if rows is None else rows.groupBy("cell_y", "cell_x").agg(F.min(F.struct("key", "version")).alias("at"), F.min_by("vector", F.struct("key", "version")).alias("vector")).select("cell_y", "cell_x", "at.key", "vector")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(version, cells, hits, misses, hit_rate): new cells, and points in cells that were known or not, of each run."""
    found = _table(spark, f"{path}/runs")
    shape = "version long, cells long, hits long, misses long"
    rows = spark.createDataFrame([], shape) if found is None else found
    return rows.select("version", "cells", "hits", "misses", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")), F.lit(0.0)).alias("hit_rate"))


def clear(spark: SparkSession, path: str) -> None:
    """Empties the store; the numbers of versions begin anew."""
    for name in ("cells", "runs"):
        found = _table(spark, f"{path}/{name}")
        if found is not None:
            spark.createDataFrame([], found.schema).write.mode("overwrite").parquet(f"{path}/{name}")


def _near(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """Targets in the blocks of REACH metres around the given first points; the rest is never joined."""
    side = REACH / DEGREE
    block = lambda df: (F.floor(df["lat"] / side), F.floor(df["lon"] / side))
    y, x = block(cells)
    around = F.explode(F.array(*(F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
    blocks = cells.select(around.alias("b")).select("b.*").distinct().select(F.col("y").alias("_by"), F.col("x").alias("_bx"))
    y, x = block(targets)
    return targets.withColumns({"_by": y, "_bx": x}).join(blocks, ["_by", "_bx"], "left_semi").drop("_by", "_bx")


def cached_vectors(points: DataFrame, roads: DataFrame, pois: DataFrame, key: str, path: str, side: float = SIDE) -> DataFrame:
    """(key, the twelve spatial features) of each point, as of its cell; new cells are computed and stored.

    Points without coordinates have no cell and no row. A run whose cells are all known reads neither
    roads nor POIs. The result reads the store's versions up to this run, so later ones don't change it.
    """
    spark = points.sparkSession
    where = placed(points, key, side).where("cell_y is not null and cell_x is not null")
    known = stored_cells(spark, path)
    first = where.groupBy("cell_y", "cell_x").agg(F.min(F.struct("key", "lat", "lon")).alias("p"), F.count(F.lit(1)).alias("n"))
    if known is not None:
        first = first.join(known.select("cell_y", "cell_x", F.lit(True).alias("hit")), ["cell_y", "cell_x"], "left")
    else:
        first = first.withColumn("hit", F.lit(None).cast("boolean"))
    last = _table(spark, f"{path}/runs")
    version = (0 if last is None else last.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]) + 1
    asked = f"{path}/asked/{version}"
    # Written, so that what is new is the same for the vectors and for the counts.
    first.select("cell_y", "cell_x", "p.key", "p.lat", "p.lon", "n", F.col("hit").isNotNull().alias("hit")).write.mode("overwrite").parquet(asked)
    first = spark.read.parquet(asked)
    missing = first.where("not hit")
    told = first.agg(
        F.count(F.when(~F.col("hit"), 1)).alias("cells"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(~F.col("hit"), F.col("n"))), F.lit(0)).alias("misses")).first()
    if told.cells:
        vectors = spatial.spatial_vector(missing.select("key", "lat", "lon"), _near(roads, missing), _near(pois, missing), "key")
        names = [c for c in vectors.columns if c != "key"]
        new = missing.select("cell_y", "cell_x", "key").join(vectors.select("key", F.struct(*names).alias("vector")), "key")
        new.select("cell_y", "cell_x", "key", "vector", F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{path}/cells")
    spark.createDataFrame([(version, told.cells, told.hits, told.misses)], "version long, cells long, hits long, misses long").coalesce(1).write.mode("append").parquet(f"{path}/runs")
    cells = stored_cells(spark, path)
    if cells is None:
        return where.limit(0).select(F.col("key").alias(key))
    return where.join(cells.select("cell_y", "cell_x", "vector"), ["cell_y", "cell_x"]).select(F.col("key").alias(key), "vector.*")
