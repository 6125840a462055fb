"""The store of cells against vectors computed anew."""

import pytest
from pyspark.sql import functions as F

from tramline.operators import cells, spatial
from tramline.plans import fixtures


def rows_of(df, key="seq"):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(key, *sorted(c for c in df.columns if c != key)).collect())


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return [f(spark, sf_dir) for f in (fixtures.points, fixtures.roads, fixtures.pois)]


def never(df):
    """A table that must not be read."""
    return df.where(F.raise_error(F.lit("was read")).cast("boolean"))


def test_first_run_is_the_plain_sharing(spark, tables, tmp_path):
    points, roads, pois = tables
    want = spatial.cell_shared(spatial.spatial_vector(points, roads, pois, "seq"), points, "seq")
    assert rows_of(cells.cached_vectors(points, roads, pois, "seq", f"{tmp_path}/s")) == rows_of(want)


def test_known_cells_read_no_road(spark, tables, tmp_path):
    points, roads, pois = tables
    path = f"{tmp_path}/s"
    one = rows_of(cells.cached_vectors(points, roads, pois, "seq", path))
    n = points.count()
    assert rows_of(cells.cached_vectors(points, never(roads), never(pois), "seq", path)) == one
    told = [tuple(r) for r in cells.runs(spark, path).orderBy("version").collect()]
    size = cells.stored_cells(spark, path).count()
    assert told == [(1, size, 0, n, 0.0), (2, 0, n, 0, 1.0)]


def test_later_points_keep_the_first_vector_and_add_cells(spark, tables, tmp_path):
    points, roads, pois = tables
    path = f"{tmp_path}/s"
    late = points.where("seq % 2 = 1")
    cells.cached_vectors(late, roads, pois, "seq", path)
    # Only roads near the new cells are asked for; the others would raise.
    new = cells.placed(points, "seq").join(cells.stored_cells(spark, path).select("cell_y", "cell_x"), ["cell_y", "cell_x"], "left_anti")
    far = roads.join(new.select("lat", "lon").distinct().withColumnsRenamed({"lat": "y", "lon": "x"}), (F.abs(F.col("lat") - F.col("y")) < 0.009) & (F.abs(F.col("lon") - F.col("x")) < 0.009), "left_anti").count()
    assert far > 0
    got = {r[0]: r for r in rows_of(cells.cached_vectors(points, roads, pois, "seq", path))}
    fresh = {r[0]: r for r in rows_of(spatial.spatial_vector(points, roads, pois, "seq"))}
    first = {}
    where = sorted(cells.placed(points, "seq").select("key", "cell_y", "cell_x").collect(), key=lambda r: (r.key % 2 == 0, r.key))
    for r in where:
        first.setdefault((r.cell_y, r.cell_x), r.key)
    assert got == {r.key: (r.key, *fresh[first[r.cell_y, r.cell_x]][1:]) for r in where}
    told = cells.runs(spark, path).orderBy("version").collect()
    assert told[1].hits + told[1].misses == len(where) and 0 < told[1].hit_rate < 1


def test_equal_cells_of_two_versions_and_clearing(spark, tables, tmp_path):
    points, roads, pois = tables
    path = f"{tmp_path}/s"
    few = points.limit(40)
    cells.cached_vectors(few, roads, pois, "seq", path)
    size = cells.stored_cells(spark, path).count()
    # As two runs at one time would leave it.
    double = spark.read.parquet(f"{path}/cells").withColumns({"key": F.col("key") + 1_000_000, "version": F.col("version") + 1})
    double.write.mode("append").parquet(f"{path}/cells")
    assert cells.stored_cells(spark, path).count() == size and cells.stored_cells(spark, path).where("key >= 1000000").count() == 0
    cells.clear(spark, path)
    assert cells.stored_cells(spark, path).count() == 0 and cells.runs(spark, path).count() == 0
    odd = few.withColumn("lat", F.when(F.col("seq") % 2 == 0, F.col("lat")))
    assert cells.cached_vectors(odd, roads, pois, "seq", path).count() == odd.where("lat is not null").count()
    assert cells.cached_vectors(few.limit(0), roads, pois, "seq", f"{tmp_path}/none").count() == 0


def test_new_cells_ask_for_places_not_copies(spark, tmp_path, monkeypatch):
    seen, within = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda points, targets, *a, **k: seen.append(targets.count()) or within(points, targets, *a, **k))
    points = spark.createDataFrame([(1, 39.9, 116.4)], "seq long, lat double, lon double")
    roads = spark.createDataFrame([(k, 39.9002, 116.4, "primary") for k in range(20)], "node_id long, lat double, lon double, road_type string")
    pois = spark.createDataFrame([(k, 39.9001, 116.4, "bus_stop") for k in range(20)], "poi_id long, lat double, lon double, poi_type string")
    (row,) = cells.cached_vectors(points, roads, pois, "seq", str(tmp_path)).collect()
    assert (row.road_bus, row.road_density) == (1.0, 20 / 50) and seen == [2]
