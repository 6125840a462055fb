"""Readers of raw GPS tracks, uploads and label files. All lazy; malformed input gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_LINES = 6


class UnknownFormat(ValueError):
    """The file's extension is none of plt, csv, json."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line: lines keep their place in the file, which Spark's text reader alone doesn't give."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def _identity(df: DataFrame) -> DataFrame:
    """user_id and track_id from paths like .../<user>/Trajectory/<track>.plt."""
    return df.withColumns({"user_id": F.regexp_extract("file", r"/(\d+)/(?:[^/]+/)?[^/]+$", 1), "track_id": F.regexp_extract("file", r"([^/]+)\.\w+$", 1)})


def read_plt(spark: SparkSession, path: str) -> DataFrame:
    """user_id, track_id, seq, ts, lat, lon of track files: 6 header lines, then 6 or 7 comma-separated columns.

    A file whose first row has another number of columns is empty, as is an empty file.
    """
    rows = _identity(_lines(spark, path).where((F.col("pos") >= HEADER_LINES) & (F.trim("line") != ""))).withColumn("part", F.split("line", ","))
    first = rows.groupBy("file").agg(F.min_by(F.size("part"), "pos").alias("width")).where(F.col("width").isin(6, 7))
    rows = rows.join(first, "file").where(F.size("part") == F.col("width"))
    at = lambda k: F.try_element_at("part", F.lit(k))
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.trim(at(-2)), F.trim(at(-1))), F.lit("yyyy-MM-dd HH:mm:ss"))
    return rows.select("user_id", "track_id", F.col("pos").cast("long").alias("seq"), stamp.alias("ts"), at(1).try_cast("double").alias("lat"), at(2).try_cast("double").alias("lon")).where("ts is not null")


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, user_id, track_id, n_rows, n_points, problem, example): what ``read_plt`` makes of each file, and why some or all rows of it are missing.

    problem is null where every row is a point; else ``no rows`` (empty, or a header alone), ``columns`` (the first row has
    not 6 or 7, so the whole file is left out) or ``rows`` (some rows have another number of columns, or no time or place
    that can be read). example is the first line that was left out. One row for each file, however wrong.
    """
    lines = _identity(_lines(spark, path)).withColumn("part", F.split("line", ","))
    row = (F.col("pos") >= HEADER_LINES) & (F.trim("line") != "")
    at = lambda k: F.try_element_at("part", F.lit(k))
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.trim(at(-2)), F.trim(at(-1))), F.lit("yyyy-MM-dd HH:mm:ss"))
    read = stamp.isNotNull() & at(1).try_cast("double").isNotNull() & at(2).try_cast("double").isNotNull()
    first = lines.groupBy("file").agg(F.min_by(F.when(row, F.size("part")), F.when(row, F.col("pos"))).alias("width"))
    marked = lines.join(first, "file").withColumns({"row": row, "point": row & F.col("width").isin(6, 7) & (F.size("part") == F.col("width")) & read})
    files = marked.groupBy("file", "user_id", "track_id", "width").agg(
        F.count(F.when(F.col("row"), 1)).alias("n_rows"), F.count(F.when(F.col("point"), 1)).alias("n_points"),
        F.min_by(F.when(F.col("row") & ~F.col("point"), F.col("line")), F.when(F.col("row") & ~F.col("point"), F.col("pos"))).alias("example"))
    # The reader passes over empty files; Spark's listing of the folder has them.
    listed = _identity(spark.createDataFrame([(f,) for f in spark.read.text(path, wholetext=True).inputFiles()], "file string"))
    files = listed.join(files.drop("user_id", "track_id"), "file", "left").na.fill(0, ["n_rows", "n_points"])
    problem = F.when(F.col("n_rows") == 0, "no rows").when(~F.col("width").isin(6, 7), "columns").when(F.col("n_points") < F.col("n_rows"), "rows")
    return files.select("file", "user_id", "track_id", "n_rows", "n_points", problem.alias("problem"), "example")


def read_plt_upload(spark: SparkSession, path: str) -> DataFrame:
    """track_id, seq, ts, lat, lon of an uploaded track file: at least 7 lines; rows of 6 or more parts; date and time last. Rows that don't parse are left out."""
    rows = _identity(_lines(spark, path)).withColumn("part", F.split("line", ","))
    long_enough = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n >= 7").select("file")
    at = lambda k: F.try_element_at("part", F.lit(k))
    body = rows.join(long_enough, "file").where((F.col("pos") >= HEADER_LINES) & (F.size("part") >= 6))
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.trim(at(-2)), F.trim(at(-1))))
    parsed = body.select("track_id", F.col("pos").cast("long").alias("seq"), stamp.alias("ts"), F.trim(at(1)).try_cast("double").alias("lat"), F.trim(at(2)).try_cast("double").alias("lon"))
    return parsed.where("ts is not null and lat is not null and lon is not null")


def read_csv_upload(spark: SparkSession, path: str) -> DataFrame:
    return _upload(spark.read.option("header", True).csv(path))


def read_json_upload(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects."""
    return _upload(spark.read.option("multiLine", True).option("primitivesAsString", True).json(path))


def _upload(raw: DataFrame) -> DataFrame:
    missing = {"latitude", "longitude", "timestamp"} - set(raw.columns)
    if missing:
        raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
    numbered = raw.withColumn("seq", F.monotonically_increasing_id())
    return numbered.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1).alias("track_id"), "seq", F.try_to_timestamp("timestamp").alias("ts"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"))


def read_upload(spark: SparkSession, path: str, least_points: int = 10) -> DataFrame:
    """Reader by extension; raises unless at least ``least_points`` rows parse."""
    readers = {"plt": read_plt_upload, "csv": read_csv_upload, "json": read_json_upload}
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in readers:
        raise UnknownFormat(kind)
    points = readers[kind](spark, path)
    if points.where("ts is not null").limit(least_points).count() < least_points:
        raise ValueError(f"fewer than {least_points} points")
    return points


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """user_id, start_ts, end_ts, raw_mode of tab-separated label files .../<user>/labels.txt."""
    schema = "start string, end string, raw_mode string"
    raw = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path).withColumn("file", F.input_file_name())
    stamp = lambda c: F.try_to_timestamp(c, F.lit("yyyy/MM/dd HH:mm:ss"))
    return raw.select(F.regexp_extract("file", r"/(\d+)/[^/]+$", 1).alias("user_id"), stamp("start").alias("start_ts"), stamp("end").alias("end_ts"), "raw_mode").where("start_ts is not null and end_ts is not null")


def first_users(points: DataFrame, n: int) -> DataFrame:
    """Points of the first n users by name."""
    users = points.select("user_id").distinct().orderBy("user_id").limit(n)
    return points.join(users, "user_id", "left_semi")
