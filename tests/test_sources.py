import json

import pytest
from pyspark.sql import functions as F

from tramline.sources import geodata, reports, sinks, tracks

HEADER = "\n".join(f"header {k}" for k in range(6))


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def test_plt_of_6_7_and_other_widths(spark, tmp_path):
    write(tmp_path / "000/Trajectory/a.plt", f"{HEADER}\n39.9,116.3,0,100,39744.1,2008-10-23,02:53:04\n39.91,116.31,0,100,39744.1,2008-10-23,02:53:10\n")
    write(tmp_path / "001/Trajectory/b.plt", f"{HEADER}\r\n40.0,117.0,100,39744.1,2008-10-23,02:53:04\r\n")
    write(tmp_path / "001/Trajectory/c.plt", f"{HEADER}\n1,2,3,4,5\n")
    write(tmp_path / "002/Trajectory/d.plt", "")
    rows = tracks.read_plt(spark, f"{tmp_path}/*/Trajectory/*.plt").orderBy("track_id", "seq").collect()
    assert [(r.user_id, r.track_id, r.lat, r.lon, str(r.ts)) for r in rows] == [
        ("000", "a", 39.9, 116.3, "2008-10-23 02:53:04"), ("000", "a", 39.91, 116.31, "2008-10-23 02:53:10"), ("001", "b", 40.0, 117.0, "2008-10-23 02:53:04")]
    assert tracks.first_users(tracks.read_plt(spark, f"{tmp_path}/*/Trajectory/*.plt"), 1).select("user_id").distinct().count() == 1


def test_uploads(spark, tmp_path):
    body = "\n".join(f"{39 + k / 100},116.3,0,100,1.5,extra,2008-10-23,02:53:{k:02d}" for k in range(12))
    good = write(tmp_path / "t.plt", f"{HEADER}\n{body}\nbroken,row\n1,2,3,4,never,x\n")
    assert tracks.read_upload(spark, good).count() == 12
    short = write(tmp_path / "s.plt", f"{HEADER}\n39.1,116.3,0,1,2008-10-23,02:53:04\n")
    with pytest.raises(ValueError, match="fewer"):
        tracks.read_upload(spark, short)
    csv = write(tmp_path / "u.csv", "latitude,longitude,timestamp,x\n" + "".join(f"39.{k},116.1,2020-01-01 00:00:{k:02d},z\n" for k in range(10, 22)))
    assert tracks.read_upload(spark, csv).count() == 12
    js = write(tmp_path / "u.json", json.dumps([{"latitude": 39.1, "longitude": 116.2, "timestamp": f"2020-01-01 00:00:{k:02d}"} for k in range(11)]))
    assert tracks.read_upload(spark, js).agg(F.sum("lat")).first()[0] == pytest.approx(39.1 * 11)
    with pytest.raises(ValueError, match="missing"):
        tracks.read_upload(spark, write(tmp_path / "v.csv", "a,b\n1,2\n"))
    with pytest.raises(tracks.UnknownFormat):
        tracks.read_upload(spark, "x.gpx")


def test_labels(spark, tmp_path):
    path = write(tmp_path / "010/labels.txt", "Start Time\tEnd Time\tTransportation Mode\n2007/06/26 11:32:29\t2007/06/26 11:40:29\tbus\nbad\tbad\twalk\n")
    assert [(r.user_id, str(r.start_ts), r.raw_mode) for r in tracks.read_labels(spark, path).collect()] == [("010", "2007-06-26 11:32:29", "bus")]


GEO = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"@id": "way/1", "highway": "primary", "railway": ""}, "geometry": {"type": "LineString", "coordinates": [[116.1, 39.1], [116.2, 39.2]]}},
    {"type": "Feature", "id": "n2", "properties": {"highway": "bus_stop", "name": "Gate"}, "geometry": {"type": "Point", "coordinates": [116.5, 39.5]}},
    {"type": "Feature", "id": "w3", "properties": {"railway": "rail", "amenity": "parking"}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 2]]]}},
    {"type": "Feature", "id": "r4", "properties": {"route": "subway", "name": "Line 4"}, "geometry": {"type": "MultiLineString", "coordinates": []}},
]}


def test_geojson(spark, tmp_path):
    features = geodata.read_geojson(spark, write(tmp_path / "g.json", json.dumps(GEO)))
    roads = geodata.road_network(features)
    assert sorted(r.id for r in roads.collect()) == ["n2", "w3", "way/1"]
    pois = sorted((r.id, r.poi_type, r.name, r.lat, r.lon) for r in geodata.points_of_interest(features).collect())
    assert pois == [("n2", "bus_stop", "Gate", 39.5, 116.5)]  # the polygon has no point of its own
    nodes = sorted((r.road_id, r.pos, r.lat, r.lon) for r in geodata.road_nodes(roads).collect())
    assert nodes == [("w3", 0, 2.0, 1.0), ("w3", 1, 4.0, 3.0), ("w3", 2, 2.0, 1.0), ("way/1", 0, 39.1, 116.1), ("way/1", 1, 39.2, 116.2)]
    assert [r.name for r in geodata.transit_routes(features).collect()] == ["Line 4"]
    lines = write(tmp_path / "g.jsonl", "\n".join(map(json.dumps, GEO["features"])))
    assert geodata.read_geojson_lines(spark, lines).count() == 4


def test_overpass(spark, tmp_path):
    answer = {"elements": [
        {"type": "node", "id": 1, "lat": 39.0, "lon": 116.0}, {"type": "node", "id": 2, "lat": 39.1, "lon": 116.1},
        {"type": "way", "id": 9, "nodes": [2, 1, 5], "tags": {"highway": "primary"}}, {"type": "way", "id": 8, "nodes": [1, 77]},
    ]}
    rows = geodata.read_overpass(spark, write(tmp_path / "o.json", json.dumps(answer))).collect()
    assert [(r.id, json.loads(r.coordinates)) for r in rows] == [("9", [[116.1, 39.1], [116.0, 39.0]])]


def test_weather_and_reports(spark, tmp_path):
    path = write(tmp_path / "w.csv", ",temp,prcp\n2020-01-01,1.5,\n2020-01-02,x,3\n")
    assert [(str(r.date), r.temp, r.prcp) for r in reports.read_weather(spark, path).collect()] == [("2020-01-01", 1.5, None), ("2020-01-02", None, 3.0)]
    found = reports.read_found_weather(spark, write(tmp_path / "f.csv", "station,obs_date,precip_mm\na,2020-01-01,2.5\n"))
    assert [(str(r.date), r.prcp) for r in found.collect()] == [("2020-01-01", 2.5)]
    report = {"Walk": {"precision": 0.5, "recall": 1.0, "f1-score": 0.66, "support": 4}, "accuracy": 0.5}
    for name, encoding in (("a.json", "utf-8"), ("b.json", "utf-8-sig")):
        rows = {r.label: (r.precision, r.f1, r.support) for r in reports.read_report(spark, write(tmp_path / name, json.dumps(report), encoding)).collect()}
        assert rows == {"Walk": (0.5, 0.66, 4), "accuracy": (0.5, 0.5, None)}


def test_sinks(spark, tmp_path):
    stage = spark.createDataFrame([(1, 2.0)], "k long, v double")
    for mode in ("strict", "gentle", "strict"):
        sinks.write_stage(stage, f"{tmp_path}/stage", mode)
    assert reports.read_stage(spark, f"{tmp_path}/stage").count() == 2 and reports.read_stage(spark, f"{tmp_path}/stage", "strict").count() == 1
    guesses = spark.createDataFrame([("s1", "Walk", "Walk", 0.9), ("s2", "Walk", "Bus", 0.6)], "segment_id string, true_label string, pred_label string, confidence double")
    sinks.write_predictions(guesses, f"{tmp_path}/p")
    assert reports.read_predictions(spark, f"{tmp_path}/p/predictions").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/p/errors").count() == 1
    trips = spark.createDataFrame([(1, [(39.0, 116.0, "t")])], "id long, points array<struct<lat: double, lon: double, timestamp: string>>")
    sinks.append_history(trips, f"{tmp_path}/h")
    sinks.append_history(trips, f"{tmp_path}/h")
    assert [r.points[0].lat for r in reports.read_history(spark, f"{tmp_path}/h").collect()] == [39.0, 39.0]


def test_typed_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b,c,d\n1,x,2.5,true\n\n2,,3,false\n")
    rows = reports.read_typed_csv(spark, str(tmp_path / "p.csv"))
    assert rows.dtypes == [("a", "int"), ("b", "string"), ("c", "double"), ("d", "boolean")]
    assert [tuple(r) for r in rows.orderBy("a").collect()] == [(1, "x", 2.5, True), (2, None, 3.0, False)]
    assert reports.read_typed_csv(spark, str(tmp_path / "p.csv"), "a long, b string, c string, d string").dtypes[2] == ("c", "string")


def test_feature_collections_in_parts_and_as_lines(spark, tmp_path):
    features = [
        {"type": "Feature", "id": f"way/{k}", "properties": {"highway": "primary", "name": f'a "Feature" \\ {k}], {{'}, "geometry": {"type": "LineString", "coordinates": [[116.3 + k, 39.9], [116.4, 39.8]]}}
        for k in range(200)]
    features.append({"type": "Feature", "properties": {"@id": "node/1", "amenity": "parking"}, "geometry": {"type": "Point", "coordinates": [1, 2]}})
    shapes = [{"type": "FeatureCollection", "features": features}, {"type": "FeatureCollection", "name": "x", "features": features, "crs": {"type": "name", "properties": {"name": "y"}}}]
    for k, (shape, indent) in enumerate([(shapes[0], None), (shapes[1], None), (shapes[0], 2), (shapes[1], 1)]):
        path = str(tmp_path / f"c{k}.json")
        with open(path, "w") as f:
            json.dump(shape, f, indent=indent)
        tuples = lambda df: sorted((r.id, sorted(r.properties.items()), r.geometry_type, json.loads(r.coordinates)) for r in df.collect())
        whole = tuples(geodata.read_geojson(spark, path))
        assert len(whole) == 201 and tuples(geodata.read_geojson_parts(spark, path)) == whole
        geodata.write_geojson_lines(geodata.read_geojson(spark, path), str(tmp_path / f"lines{k}"))
        assert tuples(geodata.read_geojson_lines(spark, str(tmp_path / f"lines{k}"))) == whole


def test_tables_of_a_database(spark):
    url = "jdbc:derby:memory:trips;create=true"
    rows = spark.createDataFrame([(k, f"user{k}") for k in range(20)], "id int, name string")
    rows.write.format("jdbc").options(url=url, dbtable="users", driver="org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
    back = reports.read_jdbc(spark, url, "users", "ID", (0, 20), 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == [(k, f"user{k}") for k in range(20)]


def test_problems_of_files(spark, tmp_path):
    head = "".join(f"h{k}\n" for k in range(6))
    files = {
        "000/Trajectory/good.plt": head + "39.9,116.3,0,492,39744.1,2008-10-23,02:53:04\n39.8,116.4,0,492,39744.1,2008-10-23,02:53:10\n",
        "000/Trajectory/some.plt": head + "39.9,116.3,0,492,39744.1,2008-10-23,02:53:04\nx,116.4,0,492,39744.1,2008-10-23,02:53:10\n1,2,3\n39,116,0,4,3,2008-13-23,02:53:10\n",
        "001/Trajectory/wide.plt": head + "1,2,3,4,5,6,7,8\n39.9,116.3,0,492,39744.1,2008-10-23,02:53:04\n", "001/Trajectory/empty.plt": "", "001/Trajectory/head.plt": head + "\n \n", "002/Trajectory/torn.plt": "\x00\x01",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.track_id: (r.user_id, r.n_rows, r.n_points, r.problem, r.example) for r in tracks.read_problems(spark, f"{tmp_path}/*/Trajectory/*.plt").collect()}
    assert got == {
        "good": ("000", 2, 2, None, None), "some": ("000", 4, 1, "rows", "x,116.4,0,492,39744.1,2008-10-23,02:53:10"), "wide": ("001", 2, 0, "columns", "1,2,3,4,5,6,7,8"),
        "empty": ("001", 0, 0, "no rows", None), "head": ("001", 0, 0, "no rows", None), "torn": ("002", 0, 0, "no rows", None)}
    points = tracks.read_plt(spark, f"{tmp_path}/*/Trajectory/*.plt").where("lat is not null and lon is not null")
    assert {r.track_id: r["count"] for r in points.groupBy("track_id").count().collect()} == {"good": 2, "some": 1}
