"""Nearest and radius look-ups by grid cells, and grids for maps.

Distances are planar, in degrees times 111300 metres. A look-up with radius r puts both
sides into square cells of side r and joins each point with the targets of its 3 by 3
cells: an equi-join on the cell and a filter on the distance, never all pairs. Targets at one
place are one row wherever the answer doesn't tell them apart, so pairs grow with the places around a point. Hot cells
are split by adaptive skew handling; the points' side may be salted with ``salts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline import schemas
from tramline.functions.scalar import DEGREE, haversine, mapped, planar
from tramline.operators.nearest import nearest_line


def _cells(df: DataFrame, side: float) -> DataFrame:
    return df.withColumns({"_cy": F.floor(F.col("lat") / side), "_cx": F.floor(F.col("lon") / side)})


def within(points: DataFrame, targets: DataFrame, key: str, radius: float, strict: bool = False, salts: int = 1) -> DataFrame:
    """(key, columns of targets but lat and lon, target_lat, target_lon, distance) of all targets within the radius.

    points: key, lat, lon. targets: lat, lon and more. The targets' side is repeated for the
    nine cells (it is the smaller one), the points' side stays as it is.
    """
    side = radius / DEGREE
    around = F.explode(F.array(*(F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y in (-1, 0, 1) for x in (-1, 0, 1))))
    spread = _cells(targets, side).withColumn("_o", around).withColumns({"_cy": F.col("_cy") + F.col("_o.dy"), "_cx": F.col("_cx") + F.col("_o.dx")}).drop("_o")
    spread = spread.withColumnRenamed("lat", "target_lat").withColumnRenamed("lon", "target_lon")
    placed = _cells(points.select(key, "lat", "lon"), side)
    on = ["_cy", "_cx"]
    if salts > 1:
        spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        placed = placed.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
        on.append("_salt")
    # Spark takes the repeated targets to be as small as their table: without the hint it would send them all through the driver.
    found = placed.join(spread.hint("merge"), on).withColumn("distance", planar(F.col("lat"), F.col("lon"), F.col("target_lat"), F.col("target_lon")))
    return found.where(F.col("distance") < radius if strict else F.col("distance") <= radius).drop("_cy", "_cx", "_salt", "lat", "lon")


def _least(targets: DataFrame, *columns: str) -> DataFrame:
    """(lat, lon, _least): of the targets at one place the one with the least columns."""
    return targets.groupBy("lat", "lon").agg(F.min(F.struct(*columns)).alias("_least"))


def nearest(points: DataFrame, targets: DataFrame, key: str, target_key: str, radius: float, strict: bool = True, salts: int = 1) -> DataFrame:
    """The nearest target of each point that has one within the radius; ties by the lesser target key."""
    kept = [target_key, *(c for c in targets.columns if c not in (target_key, "lat", "lon"))]
    found = within(points, _least(targets, *kept), key, radius, strict, salts)
    best = F.min(F.struct("distance", *(F.col(f"_least.{c}") for c in kept)))
    return found.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def road_class(road_type: Column) -> Column:
    return mapped(road_type, schemas.ROAD_CLASSES, F.lit("unknown"))


def road_features(points: DataFrame, roads: DataFrame, pois: DataFrame, key: str, salts: int = 1) -> DataFrame:
    """Road class of each point: nearest road node under 150 m; a bus stop within 50 m turns car into bus."""
    near = nearest(points, roads, key, "node_id", 150.0, salts=salts).select(key, road_class(F.col("road_type")).alias("near_class"))
    stops = within(points, pois.where("poi_type = 'bus_stop'").select("lat", "lon").distinct(), key, 50.0, salts=salts).select(key).distinct().withColumn("at_stop", F.lit(True))
    joined = points.select(key).join(near, key, "left").join(stops, key, "left")
    plain = F.coalesce("near_class", F.lit("unknown"))
    return joined.select(key, plain.alias("near_class"), F.coalesce("at_stop", F.lit(False)).alias("at_stop"),
                         F.when((plain == "car") & F.col("at_stop"), "bus").otherwise(plain).alias("road_class"))


def poi_features(points: DataFrame, pois: DataFrame, key: str, salts: int = 1) -> DataFrame:
    """Whether there is a bus stop, a station, parking within 300 m, and the nearest distance over 200, 0 where none."""
    found = within(points, pois.select("lat", "lon", "poi_type").distinct(), key, 300.0, salts=salts).groupBy(key).agg(
        *(F.max((F.col("poi_type") == t).cast("int")).alias(f"has_{t}") for t in ("bus_stop", "station", "parking")), (F.min("distance") / 200.0).alias("poi_distance"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("has_bus_stop", "has_station", "has_parking")]
    return points.select(key).join(found, key, "left").select(key, *filled, F.coalesce("poi_distance", F.lit(0.0)).alias("poi_distance"))


def road_density(points: DataFrame, roads: DataFrame, key: str, salts: int = 1) -> DataFrame:
    """Road nodes within 100 m over 50, at most 1."""
    places = roads.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("_k"))
    found = within(points, places, key, 100.0, salts=salts).groupBy(key).agg(F.sum("_k").alias("_n"))
    return points.select(key).join(found, key, "left").select(key, F.least(F.coalesce(F.col("_n") / 50.0, F.lit(0.0)), F.lit(1.0)).alias("road_density"))


def spatial_vector(points: DataFrame, roads: DataFrame, pois: DataFrame, key: str, salts: int = 1) -> DataFrame:
    """The twelve spatial features: class one-hot, three flags, nearest distance, density.

    Those of ``road_features``, ``poi_features`` and ``road_density``, from one grid join with
    roads and POIs together and one aggregation.
    """
    node = roads.schema["node_id"].dataType
    places = roads.groupBy("lat", "lon").agg(F.min(F.struct("node_id", "road_type")).alias("_least"), F.count(F.lit(1)).alias("_k"))
    targets = places.select("lat", "lon", F.lit(None).cast("string").alias("poi_type"), F.lit(True).alias("is_road"), "_least.node_id", "_least.road_type", "_k").union(
        pois.select("lat", "lon", "poi_type").distinct().select("lat", "lon", "poi_type", F.lit(False), F.lit(None).cast(node), F.lit(None).cast("string"), F.lit(None).cast("long")))
    road, poi = F.col("is_road"), ~F.col("is_road")
    # A road farther away counts for nothing.
    found = within(points, targets, key, 300.0, salts=salts).where(poi | (F.col("distance") < 150.0)).groupBy(key).agg(
        F.min(F.when(road & (F.col("distance") < 150.0), F.struct("distance", "node_id", "road_type"))).alias("_near"),
        F.max(poi & (F.col("poi_type") == "bus_stop") & (F.col("distance") <= 50.0)).alias("_stop"),
        *(F.max((poi & (F.col("poi_type") == t)).cast("double")).alias(f"has_{t}") for t in ("bus_stop", "station", "parking")),
        (F.min(F.when(poi, F.col("distance"))) / 200.0).alias("poi_distance"), F.sum(F.when(road & (F.col("distance") <= 100.0), F.col("_k"))).alias("_roads"))
    joined = points.select(key).join(found, key, "left")
    plain = F.coalesce(F.when(F.col("_near").isNotNull(), road_class(F.col("_near.road_type"))), F.lit("unknown"))
    kind = F.when((plain == "car") & F.coalesce("_stop", F.lit(False)), "bus").otherwise(plain)
    hot = [(kind == c).cast("double").alias(f"road_{c}") for c in schemas.ROAD_CLASS_ORDER]
    flags = [F.coalesce(f"has_{t}", F.lit(0.0)).alias(f"has_{t}") for t in ("bus_stop", "station", "parking")]
    return joined.select(key, *hot, *flags, F.coalesce("poi_distance", F.lit(0.0)).alias("poi_distance"), F.least(F.coalesce(F.col("_roads") / 50.0, F.lit(0.0)), F.lit(1.0)).alias("road_density"))


def cell_shared(vectors: DataFrame, points: DataFrame, key: str, side: float = 0.001) -> DataFrame:
    """Each point with the vector of the first point (least key) of its cell."""
    placed = points.select(key, F.rint(F.col("lat") / side).cast("long").alias("cell_y"), F.rint(F.col("lon") / side).cast("long").alias("cell_x"))
    features = [c for c in vectors.columns if c != key]
    first = vectors.join(placed, key).groupBy("cell_y", "cell_x").agg(F.min_by(F.struct(*features), key).alias("_v"))
    return placed.join(first, ["cell_y", "cell_x"]).select(key, "_v.*")


def poi_links(pois: DataFrame, roads: DataFrame) -> DataFrame:
    """The nearest road node within 100 m of each POI, by great-circle distance, as edges in both directions."""
    found = within(pois.select("poi_id", "lat", "lon"), _least(roads, "node_id").select("lat", "lon", "_least.node_id"), "poi_id", 100.0)
    at = pois.select("poi_id", "lat", "lon")
    far = found.join(at, "poi_id").withColumn("metres", haversine(F.col("lat"), F.col("lon"), F.col("target_lat"), F.col("target_lon")))
    best = far.groupBy("poi_id").agg(F.min(F.struct("metres", "node_id")).alias("_b")).select("poi_id", "_b.*")
    there = best.select(F.concat(F.lit("poi_"), "poi_id").alias("src"), F.concat(F.lit("road_"), "node_id").alias("dst"), F.lit("nearby_road").alias("kind"), "metres")
    back = best.select(F.concat(F.lit("road_"), "node_id").alias("src"), F.concat(F.lit("poi_"), "poi_id").alias("dst"), F.lit("has_poi").alias("kind"), "metres")
    return there.union(back)


def road_edges(nodes: DataFrame, road: str = "road_id", order: str = "pos") -> DataFrame:
    """Edges between nodes of a road that follow each other, with great-circle lengths."""
    w = Window.partitionBy(road).orderBy(order)
    ahead = nodes.select(road, order, "node_id", "lat", "lon", F.lead("node_id").over(w).alias("next_id"), F.lead("lat").over(w).alias("_lat"), F.lead("lon").over(w).alias("_lon"))
    return ahead.where("next_id is not null").select(
        road, F.col("node_id").alias("src"), F.col("next_id").alias("dst"), haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("metres"))


def nearest_segment(points: DataFrame, edges: DataFrame, key: str, radius: float, rings: int = 3) -> DataFrame:
    """(key, distance, road_id, road_type): nearest road by distance to its line segments, within 4 ** (rings - 1) times the radius.

    edges: road_id, road_type, lat1, lon1, lat2, lon2. The same tree as ``nearest.nearest_line``, which has no
    threshold: pieces that cross many cells and points near many pieces are no pairs of rows. Points without a road so near have no row.
    """
    return nearest_line(points, edges, key).where(F.col("distance") <= radius * 4 ** (rings - 1))


def grid_green(points: DataFrame, is_green: Column, side: float = 0.005, south: float = 39.7, west: float = 116.1) -> DataFrame:
    """Points, green points, their ratio and the centre of each cell of a grid."""
    y, x = F.floor((F.col("lat") - south) / side), F.floor((F.col("lon") - west) / side)
    cells = points.select(y.alias("cell_y"), x.alias("cell_x"), is_green.cast("long").alias("_g")).groupBy("cell_y", "cell_x").agg(F.count(F.lit(1)).alias("n"), F.sum("_g").alias("n_green"))
    return cells.withColumns({
        "green_ratio": F.col("n_green") / F.col("n"), "lat": south + (F.col("cell_y") + 0.5) * side, "lon": west + (F.col("cell_x") + 0.5) * side})


def grid_intensity(points: DataFrame, south: float, west: float, side: float, rows: int, columns: int, least: float = 0.01) -> DataFrame:
    """Counts of each cell over the range of all cells' counts, of cells above ``least``. Points outside are dropped."""
    y, x = F.floor((F.col("lat") - south) / side), F.floor((F.col("lon") - west) / side)
    inside = points.select(y.alias("cell_y"), x.alias("cell_x")).where(F.col("cell_y").between(0, rows - 1) & F.col("cell_x").between(0, columns - 1))
    cells = inside.groupBy("cell_y", "cell_x").agg(F.count(F.lit(1)).alias("n"))
    # A cell without points makes the least count 0.
    most = cells.agg(F.max("n")).scalar()
    least_n = cells.agg(F.when(F.count(F.lit(1)) == rows * columns, F.min("n")).otherwise(0)).scalar()
    return cells.withColumn("value", (F.col("n") - least_n) / (most - least_n + 1e-6)).where(F.col("value") > least)
