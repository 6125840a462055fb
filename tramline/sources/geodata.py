"""Readers of road networks and POIs: GeoJSON and Overpass JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.sources.jsonsplit import json_objects, parsed

POI_TAGS = ("bus_stop", "station", "parking", "taxi", "subway_entrance")
_FEATURE = "struct<id: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, properties map, geometry_type, coordinates (JSON text) of each feature.

    A FeatureCollection is one JSON value, so one task parses it; read huge ones with
    ``read_geojson_parts``, or write them once with ``write_geojson_lines``.
    """
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"features array<{_FEATURE}>").alias("c"))
    return _features(text.select(F.explode("c.features").alias("f")))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    return _features(spark.read.text(path).select(F.from_json("value", _FEATURE).alias("f")).where("f is not null"))


def read_geojson_parts(spark: SparkSession, path: str) -> DataFrame:
    """A FeatureCollection of any size and any writer, read by many tasks; a feature that is no JSON raises, as does a file that ends too soon."""
    return _features(parsed(json_objects(spark, path, "features"), _FEATURE.removeprefix("struct<").removesuffix(">")).select("f"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """Features as one JSON line each, as ``read_geojson_lines`` takes them."""
    geometry = F.concat(F.lit('{"type":'), F.to_json(F.array("geometry_type")).substr(F.lit(2), F.length(F.to_json(F.array("geometry_type"))) - 2), F.lit(',"coordinates":'), F.coalesce("coordinates", F.lit("null")), F.lit("}"))
    head = F.to_json(F.struct("id", "properties"))
    line = F.concat(F.lit('{"type":"Feature",'), head.substr(F.lit(2), F.length(head) - 2), F.lit(',"geometry":'), geometry, F.lit("}"))
    features.select(line.alias("value")).write.mode("overwrite").text(path)


def _features(df: DataFrame) -> DataFrame:
    properties = F.coalesce("f.properties", F.create_map().cast("map<string,string>"))
    return df.select(F.coalesce(F.try_element_at(properties, F.lit("@id")), F.col("f.id")).alias("id"), properties.alias("properties"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def tag(name: str) -> Column:
    """A tag's value; empty means absent."""
    return F.nullif(F.try_element_at("properties", F.lit(name)), F.lit(""))


def road_network(features: DataFrame) -> DataFrame:
    """Features with a highway or railway tag."""
    roads = features.select("id", tag("highway").alias("highway"), tag("railway").alias("railway"), "geometry_type", "coordinates")
    return roads.where("highway is not null or railway is not null")


def points_of_interest(features: DataFrame) -> DataFrame:
    """id, poi_type, name, lat, lon of features with a POI tag; the type is the first of highway, railway, amenity."""
    tags = [tag(t) for t in ("highway", "railway", "amenity")]
    hit = F.lit(False)
    for t in tags:
        hit = hit | F.coalesce(t.isin(*POI_TAGS), F.lit(False))
    numbers = F.regexp_extract_all("coordinates", F.lit(r"(-?\d+\.?\d*(?:[eE][-+]?\d+)?)"), 1)
    pois = features.where(hit & F.col("geometry_type").isin("Point", "MultiPoint", "LineString"))
    return pois.select("id", F.coalesce(*tags).alias("poi_type"), tag("name").alias("name"), F.try_element_at(numbers, F.lit(2)).try_cast("double").alias("lat"), F.try_element_at(numbers, F.lit(1)).try_cast("double").alias("lon"))


def transit_routes(features: DataFrame) -> DataFrame:
    """Features tagged as a bus, subway, train, tram or light-rail route."""
    kind = tag("route")
    return features.select("id", kind.alias("type"), tag("name").alias("name"), "geometry_type").where(F.col("type").isin("bus", "subway", "train", "tram", "light_rail"))


def road_nodes(roads: DataFrame) -> DataFrame:
    """road_id, pos, node_id, lat, lon, road_type of the vertices of lines and outer rings; other geometries are left out."""
    line = F.when(F.col("geometry_type") == "LineString", F.from_json("coordinates", "array<array<double>>")).when(
        F.col("geometry_type") == "Polygon", F.get(F.from_json("coordinates", "array<array<array<double>>>"), F.lit(0)))
    kept = roads.where(F.col("geometry_type").isin("LineString", "Polygon"))
    vertices = kept.select(F.col("id").alias("road_id"), F.coalesce("highway", "railway").alias("road_type"), F.posexplode(line).alias("pos", "c"))
    return vertices.select("road_id", "pos", F.concat_ws("_", "road_id", "pos").alias("node_id"), F.get("c", F.lit(1)).alias("lat"), F.get("c", F.lit(0)).alias("lon"), "road_type")


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Ways of an Overpass answer of any size as features: node references become coordinates; ways with fewer than two known nodes are left out.

    Elements are read by many tasks; references are joined with nodes, and gathered again for each way. An element that
    comes twice counts once.
    """
    element = "type: string, id: long, lat: double, lon: double, tags: map<string,string>, nodes: array<long>"
    elements = parsed(json_objects(spark, path, "elements"), element).select("f.*")
    nodes = elements.where("type = 'node' and lat is not null").groupBy(F.col("id").alias("node")).agg(F.min(F.struct("lon", "lat")).alias("at")).select("node", F.array("at.lon", "at.lat").alias("c"))
    ways = elements.where("type = 'way'").select("id", F.map_entries("tags").alias("tags"), "nodes").groupBy("id").agg(F.min(F.struct("nodes", "tags")).alias("w")).select("id", "w.nodes", "w.tags")
    references = ways.select("id", F.posexplode("nodes").alias("pos", "node"))
    lines = references.join(nodes, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("v")).where("size(v) >= 2")
    properties = F.coalesce(F.map_from_entries("tags"), F.create_map().cast("map<string,string>"))
    return lines.join(ways.select("id", "tags"), "id").select(
        F.col("id").cast("string").alias("id"), properties.alias("properties"), F.lit("LineString").alias("geometry_type"), F.to_json(F.transform("v", lambda x: x["c"])).alias("coordinates"))
