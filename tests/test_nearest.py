"""The packed tree against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.operators import nearest

EDGE = "road_id long, road_type string, lat1 double, lon1 double, lat2 double, lon2 double"


def all_pairs(points, edges):
    out = {}
    for key, y, x in points:
        best = []
        for road, kind, y1, x1, y2, x2 in edges:
            if not all(v is not None and math.isfinite(v) for v in (y, x, y1, x1, y2, x2)):
                continue
            dy, dx = y2 - y1, x2 - x1
            size = dy * dy + dx * dx
            at = min(1.0, max(0.0, ((y - y1) * dy + (x - x1) * dx) / size)) if size else 0.0
            best.append((math.hypot(y - y1 - at * dy, x - x1 - at * dx) * 111300, road, kind))
        if best:
            low = min(b[0] for b in best)
            out[key] = (pytest.approx(low, rel=1e-9, abs=1e-6), [b[1:] for b in best if b[0] <= low + 1e-6])
    return out


def check(spark, points, edges, **how):
    found = nearest.nearest_line(spark.createDataFrame(points, "k long, lat double, lon double").repartition(3), spark.createDataFrame(edges, EDGE).repartition(3), "k", **how).collect()
    want = all_pairs(points, edges)
    assert {r.k for r in found} == set(want) and len(found) == len(want)
    for r in found:
        assert r.distance == want[r.k][0] and (r.road_id, r.road_type) in want[r.k][1], r


def made(seed, n_points, n_edges, long=0.05):
    draw = np.random.default_rng(seed)
    centre = draw.uniform(0, 0.2, (n_edges, 2))
    away = draw.normal(0, 1, (n_edges, 2)) * np.where(draw.random((n_edges, 1)) < 0.1, long, 0.0005)
    edges = [(k % 50, f"t{k % 3}", *map(float, row)) for k, row in enumerate(np.hstack((centre, centre + away)))]
    points = [(k, *map(float, p)) for k, p in enumerate(draw.uniform(-0.1, 0.3, (n_points, 2)))]
    return points, edges


def test_tree_finds_all_boxes_within_a_bound():
    draw = np.random.default_rng(2)
    for n in (1, 2, 16, 17, 300, 5000):
        low = draw.uniform(0, 1, (2, n))
        boxes = np.concatenate((low, low + draw.exponential(0.02, (2, n))))
        tree = nearest.PackedTree(boxes)
        y, x, bound = draw.uniform(-0.2, 1.2, 50), draw.uniform(-0.2, 1.2, 50), draw.exponential(0.1, 50)
        far = nearest.PackedTree._far(boxes[:, None, :], y[:, None], x[:, None])
        got = {(int(p), int(k)) for points, items, _ in tree.reached(y, x, bound) for p, k in zip(points, items)}
        assert got == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(far <= bound[:, None])))))
        assert all(0 <= k < n for k in tree.descend(y, x))


def test_blocks_are_halved_where_boxes_are_many(monkeypatch):
    monkeypatch.setattr(nearest, "MOST_PAIRS", 200)
    draw = np.random.default_rng(4)
    low = draw.uniform(0, 1, (2, 400))
    tree = nearest.PackedTree(np.concatenate((low, low + 0.01)))
    got = [(int(p), int(k)) for points, items, _ in tree.reached(np.zeros(7), np.zeros(7), np.full(7, 9.0)) for p, k in zip(points, items)]
    assert sorted(got) == [(p, k) for p in range(7) for k in range(400)]


def test_against_all_pairs(spark, monkeypatch):
    points, edges = made(1, 300, 400)
    check(spark, points, edges)
    monkeypatch.setattr(nearest, "TILE", 20)
    check(spark, points, edges)
    check(spark, points, edges, part=7)


def test_ties_repeated_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TILE", 2)
    edges = [(5, "b", 0.0, 0.0, 0.0, 1.0), (5, "a", 0.0, 0.0, 0.0, 1.0), (7, "a", 0.0, 0.0, 0.0, 1.0), (None, None, 2.0, 2.0, 2.0, 2.0), (1, "x", float("nan"), 0.0, 0.0, 1.0), (1, "x", None, 0.0, 0.0, 1.0), (9, "z", 50.0, 100.0, 50.0, 101.0)]
    points = [(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 2.0, 2.1), (3, float("inf"), 0.0), (4, None, 0.0), (5, 50.0, 179.0), (6, -80.0, -170.0)]
    found = nearest.nearest_line(spark.createDataFrame(points, "k long, lat double, lon double"), spark.createDataFrame(edges, EDGE), "k").collect()
    got = {r.k: (round(r.distance / 111300, 6), r.road_id, r.road_type) for r in found}
    assert got == {1: (0.5, 5, "a"), 2: (0.1, None, None), 5: (78.0, 9, "z"), 6: (round(math.hypot(80, 170), 6), 5, "a")} and len(found) == 4


def test_empty_sides(spark):
    points, edges = spark.createDataFrame([(1, 0.0, 0.0)], "k long, lat double, lon double"), spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0)], EDGE)
    assert nearest.nearest_line(points.limit(0), edges, "k").count() == 0
    assert nearest.nearest_line(points, edges.limit(0), "k").columns == ["k", "distance", "road_id", "road_type"]
    assert nearest.nearest_line(points, edges.limit(0), "k").count() == 0


def test_a_hot_tile_is_many_tasks(spark):
    points = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 1e-7).alias("lat"), F.lit(0.0).alias("lon"))
    edges = spark.createDataFrame([(1, "a", 0.0, 0.001, 1.0, 0.001), (2, "b", 0.0, 5.0, 0.0, 6.0)], EDGE)
    found = nearest.nearest_line(points, edges, "k", part=10_000)
    assert found.where("road_id = 1 and abs(distance - 111.3) < 1e-6").count() == 60_000


def test_copies_of_a_piece_are_one(spark, monkeypatch):
    sizes, tiles = [], nearest._tiles
    monkeypatch.setattr(nearest, "_tiles", lambda edges, n: sizes.append((n, edges.count())) or tiles(edges, n))
    points, edges = made(3, 40, 30)
    check(spark, points, [(road + 1000 * k, kind, *piece) for k in range(5) for road, kind, *piece in edges])
    assert sizes == [(30, 30)]


def test_any_line_asks_for_all_points(spark, sf_dir):
    from tramline.plans import fixtures, queries

    found = queries.QUERIES["geo19_nearest_any_line"](spark, sf_dir)
    assert found.columns == ["seq", "road_id", "distance"] and found.count() == fixtures.points(spark, sf_dir).count()
