"""Files of JSON objects cut anywhere, against json.loads of the whole."""

import json
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from tramline.sources import geodata, jsonsplit

TEXTS = ['"', "\\", '\\"', "}", "{", "]", "[", ":", "features", '"features":[{', "Feature", "FeatureCollection", "é😀", "\n", "", "a}b", "\\\\", "}}}", '{"type":"Feature"}']


def value(draw, depth=0):
    kind = draw.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return "".join(draw.choice(TEXTS) for _ in range(draw.randrange(4)))
    if kind < 4:
        return [draw.randrange(99), None, True][kind - 1]
    if kind == 4:
        return [value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {draw.choice(TEXTS) + str(k): value(draw, depth + 1) for k in range(draw.randrange(4))}


def document(draw, n):
    objects = [{f"{draw.choice(TEXTS)}{k}": value(draw) for k in range(draw.randrange(4))} for _ in range(n)]
    others = [(k, v) for k, v in (("type", "FeatureCollection"), ("crs", value(draw)), ("other", [{"a": [{}]}, {"features": [{"no": 1}]}]), ("feat}ures", {"features": {"x": {}}}), ('"', 1)) if draw.random() < 0.7]
    root = [*others, ("features", objects)]
    draw.shuffle(root)
    text = json.dumps(dict(root), ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, None, 1]), separators=draw.choice([(",", ":"), (" , ", " : ")]))
    return text + draw.choice(["", "\n", "  \r\n"]), objects


def cut(text, sizes, file="f"):
    """Rows as the text reader has them: records end at closing braces, ranges at given records."""
    records = text.split("}")
    records = records[:-1] if records[-1] == "" else records
    ranges, at = [], 0
    while records:
        n = sizes()
        ranges.append([(file, at, r.encode()) for r in records[:n]])
        records, at = records[n:], at + 1000
    return ranges


def batch(rows):
    a, b, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["file", "at", "value"])


def test_any_cut_against_json(monkeypatch):
    draw = random.Random(3)
    for step in (1, 7, 60, 1 << 20):
        monkeypatch.setattr(jsonsplit, "STEP", step)
        for trial in range(60):
            text, objects = document(draw, draw.choice([0, 1, 2, 9]))
            ranges = cut(text, lambda: draw.choice([1, 1, 2, 5, 40]))
            # Several ranges may be one task, and a range several batches.
            tasks = [[batch(r[:2]), batch(r[2:])] for r in ranges] if trial % 2 else [[batch(sum(ranges, []))]]
            shapes = [SimpleNamespace(**row) for t in tasks for out in jsonsplit._shapes("features")(iter(t)) for row in out.to_pylist()]
            states = SimpleNamespace(value=jsonsplit._fold(shapes))
            rows = [r for t in tasks for out in jsonsplit._objects("features", states)(iter(t)) for r in out.to_pylist()]
            found = {}
            for r in sorted(rows, key=lambda r: (r["number"], r["at"], r["part"] or 0)):
                assert r["part"] is not None or r["number"] not in found
                found[r["number"]] = found.get(r["number"], "") + r["text"]
            assert [json.loads(found[k]) for k in sorted(found)] == objects, (step, trial, text)


def test_files_in_many_ranges(spark, tmp_path):
    draw = random.Random(5)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        want = {}
        for k in range(3):
            text, objects = document(draw, 60)
            (tmp_path / f"d{k}.json").write_text(text, encoding="utf-8")
            want[f"d{k}.json"] = objects
        (tmp_path / "empty.json").write_text("")
        (tmp_path / "none.json").write_text('{"a": [{"features": [{}]}]}')
        for size in ("300b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {}
            for r in sorted(jsonsplit.json_objects(spark, str(tmp_path), "features").collect(), key=lambda r: (r.file, r.number)):
                got.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.text))
            assert got == want
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_geojson_of_any_writer(spark, tmp_path):
    features = [
        {"geometry": {"coordinates": [116.0, 39.0], "type": "Point"}, "id": "a", "properties": {"name": "FeatureCollection", "highway": "Feature"}, "type": "Feature"},
        {"properties": None, "geometry": None, "type": "Feature"}, {"id": "c", "properties": {"note": 'he said "Feature" } ] {'}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "type": "Feature"},
    ]
    path = tmp_path / "g.geojson"
    path.write_text(json.dumps({"features": features, "bbox": [[1, 2], [3, 4]], "type": "FeatureCollection"}))
    told = lambda df: sorted(((r.id or "", dict(r.properties), r.geometry_type, r.coordinates) for r in df.collect()), key=repr)
    got = told(geodata.read_geojson_parts(spark, str(path)))
    assert got == told(geodata.read_geojson(spark, str(path))) and len(got) == 3


def test_wrong_files_raise(spark, tmp_path):
    for k, text in enumerate(('{"features": [{"a": 1}, {"b": ', '{"features": [{"a": tru}]}', '{"features": [{"a": "x}')):
        path = tmp_path / f"w{k}.json"
        path.write_text(text)
        with pytest.raises(Exception, match="ends within|no JSON object"):
            geodata.read_geojson_parts(spark, str(path)).collect()


def test_overpass_in_parts(spark, tmp_path):
    draw = random.Random(7)
    nodes = [{"type": "node", "id": k, "lat": 39 + k * 1e-3, "lon": 116 + k * 1e-3} for k in range(200)]
    ways = [{"nodes": [draw.randrange(220) for _ in range(draw.randrange(6))], "id": 1000 + k, "tags": {"highway": "primary", "name": 'a "}{" b'} if k % 3 else None, "type": "way"} for k in range(80)]
    elements = [*nodes, *ways, nodes[0], ways[5], {"type": "relation", "id": 1, "members": [{"ref": 1}]}]
    draw.shuffle(elements)
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"version": 0.6, "elements": elements, "osm3s": {"copyright": "}"}}))
    known = {n["id"]: [n["lon"], n["lat"]] for n in nodes}
    want = {str(w["id"]): ([known[n] for n in w["nodes"] if n in known], w["tags"] or {}) for w in ways}
    want = {k: v for k, v in want.items() if len(v[0]) > 1}
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        got = {r.id: (json.loads(r.coordinates), dict(r.properties)) for r in geodata.read_overpass(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and [x for c in got[k][0] for x in c] == pytest.approx([x for c in want[k][0] for x in c]) for k in want)
