"""Nearest line without a threshold: a packed R-tree, dealt over tasks.

The pieces of the lines are packed into tiles by sort-tile-recursive: by length class (so that a
long piece doesn't widen the box of short ones), then by strips of longitude, then by
latitude. The boxes of the tiles, at most MAX_TILES, are the top of the tree and known to
every task; what lies below, a packed tree of the pieces of one tile, is built where the
tile's points are. A point first goes to the tile whose box is nearest, which bounds its
distance, and then to those other tiles that the bound reaches, mostly none. Tiles with very
many points are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.scalar import DEGREE

#: Pieces of a tile; of more than MAX_TILES times as many, tiles get larger instead.
TILE, MAX_TILES = 4096, 100_000
#: Points that one task searches in a tile.
PART = 200_000
FAN, PARTS = 16, 32
#: Stands for the tile of points that have an answer.
ANSWERED = -1
#: Points at a time, and pairs of points and boxes beyond which they are halved.
BLOCK, MOST_PAIRS = 1024, 1 << 22
_PIECE = ("lat1", "lon1", "lat2", "lon2")


def _loose(bound: np.ndarray) -> np.ndarray:
    """Boxes and pieces are measured in different ways; a bound allows for the last places."""
    return bound * (1 + 1e-9) + 1e-12


class PackedTree:
    """R-tree of boxes (low y, low x, high y, high x), packed level by level; FAN neighbours share a parent."""

    def __init__(self, boxes: np.ndarray):
        n = boxes.shape[1]
        strips = max(1, int(np.ceil(np.sqrt(n / FAN))))
        across = np.argsort(np.argsort(boxes[1] + boxes[3], kind="stable"), kind="stable") * strips // n
        self.order = np.lexsort((boxes[0] + boxes[2], across))
        self.levels = [boxes[:, self.order]]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            at = np.arange(0, below.shape[1], FAN)
            self.levels.append(np.concatenate((np.minimum.reduceat(below[:2], at, axis=1), np.maximum.reduceat(below[2:], at, axis=1))))

    @staticmethod
    def _far(box: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        dy = np.maximum(np.maximum(box[0] - y, y - box[2]), 0)
        dx = np.maximum(np.maximum(box[1] - x, x - box[3]), 0)
        return np.sqrt(dy * dy + dx * dx)

    def descend(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A near box of each point: down the tree, always to the nearest child."""
        node = np.zeros(len(y), np.int64)
        for level in reversed(self.levels[:-1]):
            child = node[:, None] * FAN + np.arange(FAN)
            far = self._far(level[:, np.minimum(child, level.shape[1] - 1)], y[:, None], x[:, None])
            far[child >= level.shape[1]] = np.inf
            node = child[np.arange(len(y)), far.argmin(axis=1)]
        return self.order[node]

    @staticmethod
    def _surely(box: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Within this distance there is something: each side of a box is touched by what it holds."""
        ys, xs = (np.abs(box[0] - y), np.abs(box[2] - y)), (np.abs(box[1] - x), np.abs(box[3] - x))
        return np.minimum(np.hypot(np.minimum(*ys), np.maximum(*xs)), np.hypot(np.maximum(*ys), np.minimum(*xs)))

    def reached(self, y: np.ndarray, x: np.ndarray, bound: np.ndarray, nearest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(points, boxes, distances), some points at a time: the boxes that are not farther from a point than its bound.

        With ``nearest`` those that may hold the nearest: boxes on the way lower the bound.
        """
        bound = bound.copy()
        todo = [np.arange(lo, min(lo + BLOCK, len(y))) for lo in range(0, len(y), BLOCK)][::-1]
        while todo:
            block = todo.pop()
            point, node, far = block, np.zeros(len(block), np.int64), self._far(self.levels[-1], y[block], x[block])
            point, node, far = (v[far <= bound[block]] for v in (point, node, far))
            for level in reversed(self.levels[:-1]):
                if len(point) * FAN > MOST_PAIRS and len(block) > 1:
                    break
                point, node = np.repeat(point, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < level.shape[1]
                point, node = point[there], node[there]
                far = self._far(level[:, node], y[point], x[point])
                if nearest and len(point):
                    one = np.flatnonzero(np.concatenate(([True], point[1:] != point[:-1])))
                    bound[point[one]] = np.minimum(bound[point[one]], _loose(np.minimum.reduceat(self._surely(level[:, node], y[point], x[point]), one)))
                near = far <= bound[point]
                point, node, far = point[near], node[near], far[near]
            else:
                yield point, self.order[node], far
                continue
            todo += [block[len(block) // 2 :], block[: len(block) // 2]]


def _boxes(piece: dict[str, np.ndarray]) -> np.ndarray:
    lat, lon = (piece["lat1"], piece["lat2"]), (piece["lon1"], piece["lon2"])
    return np.stack((np.minimum(*lat), np.minimum(*lon), np.maximum(*lat), np.maximum(*lon)))


def _parts(piece: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Parts of the pieces, of about one length and at most PARTS + 1 times as many, and the piece of each."""
    long = np.maximum(np.abs(piece["lat2"] - piece["lat1"]), np.abs(piece["lon2"] - piece["lon1"]))
    n = np.maximum(1, np.ceil(long / max(long.mean() / PARTS, 1e-12))).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    out = {}
    for a in ("lat", "lon"):
        start, way = piece[f"{a}1"][owner], (piece[f"{a}2"] - piece[f"{a}1"])[owner] / n[owner]
        out |= {f"{a}1": start + way * k, f"{a}2": start + way * (k + 1)}
    return out, owner


def _to_piece(y: np.ndarray, x: np.ndarray, piece: dict[str, np.ndarray], k: np.ndarray) -> np.ndarray:
    """Degrees from points to pieces: to the foot of the perpendicular or the nearer end."""
    y1, x1 = piece["lat1"][k], piece["lon1"][k]
    dy, dx = piece["lat2"][k] - y1, piece["lon2"][k] - x1
    size = dy * dy + dx * dx
    along = np.divide((y - y1) * dy + (x - x1) * dx, size, out=np.zeros(len(k)), where=size > 0)
    along = np.clip(along, 0.0, 1.0)
    return np.sqrt((y - (y1 + along * dy)) ** 2 + (x - (x1 + along * dx)) ** 2)


def _search(points: pa.Table, pieces: pa.Table) -> pa.Table:
    """Points with the nearest of the pieces where it is nearer than what they have, ties by least road."""
    if not pieces.num_rows or not points.num_rows:
        return points.select([c for c in points.column_names if c != "salt"])
    y, x, best = (points[c].to_numpy().astype(float) for c in ("lat", "lon", "distance"))
    piece = {c: pieces[c].to_numpy().astype(float) for c in _PIECE}
    # The box of a long slanting piece holds much that is far from it: the tree has boxes of its parts.
    cut, owner = _parts(piece)
    tree = PackedTree(_boxes(cut))
    first = _to_piece(y, x, piece, owner[tree.descend(y, x)])
    bound = _loose(np.minimum(best / DEGREE, first))
    names = pieces.select(["road_id", "road_type"])
    rank = np.empty(len(names), np.int64)
    # Nulls first, as Spark's least structure has them.
    rank[pc.sort_indices(names, sort_keys=[("road_id", "ascending"), ("road_type", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(names))
    found, far = np.full(len(y), -1), np.full(len(y), np.inf)
    for point, k, _ in tree.reached(y, x, bound, nearest=True):
        k = owner[k]
        d = _to_piece(y[point], x[point], piece, k) * DEGREE
        order = np.lexsort((rank[k], d, point))
        point, k, d = point[order], k[order], d[order]
        one = np.flatnonzero(np.concatenate((point[:1] == point[:1], point[1:] != point[:-1])))
        found[point[one]], far[point[one]] = k[one], d[one]
    # What a point has from its first tile and ties with is settled by the last aggregation.
    hit = np.flatnonzero((found >= 0) & (far <= best))
    kept = points.take(pa.array(hit))
    own = names.take(pa.array(found[hit]))
    changed = {"distance": pa.array(far[hit]), "road_id": own["road_id"], "road_type": own["road_type"]}
    return pa.table({c: changed.get(c, kept[c]) for c in points.column_names if c != "salt"})


def _tiles(edges: DataFrame, n: int) -> DataFrame:
    """edges with a tile, by sort-tile-recursive with approximate quantiles; these decide how even tiles are, not what is found."""
    size = max(TILE, -(-n // MAX_TILES))
    across, up = (F.col("lon1") + F.col("lon2")) / 2, (F.col("lat1") + F.col("lat2")) / 2
    long = F.greatest(F.abs(F.col("lat2") - F.col("lat1")), F.abs(F.col("lon2") - F.col("lon1")))
    classed = edges.select("*", across.alias("_x"), up.alias("_y"), F.when(long > 0, F.floor(F.log(4.0, long))).otherwise(-99).cast("int").alias("_class"))
    counts = {r["_class"]: r["count"] for r in classed.groupBy("_class").count().collect()}
    cuts = {c: int(np.ceil(np.sqrt(k / size))) for c, k in counts.items()}
    if max(cuts.values()) == 1:
        return classed.select(*edges.columns, F.col("_class").alias("tile"))
    steps = max(cuts.values())
    at = F.array(*(F.lit(k / steps) for k in range(1, steps)))
    strips = {r["_class"]: r.q for r in classed.groupBy("_class").agg(F.percentile_approx("_x", at, 1000).alias("q")).collect()}
    picked = lambda q, c: np.unique([q[min(steps * k // cuts[c], steps - 1) - 1] for k in range(1, cuts[c]) if steps * k // cuts[c] >= 1])
    strips = {c: picked(q, c) for c, q in strips.items()}
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classed.schema)

    def stripped(batches: Iterator[pa.RecordBatch], within: dict | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, x, y = (batch.column(batch.schema.get_field_index(f)).to_numpy() for f in ("_class", "_x", "_y"))
            strip, row = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                of = c == k
                strip[of] = np.searchsorted(strips[k], x[of], side="right")
                for s in np.unique(strip[of]) if within else ():
                    both = of & (strip == s)
                    row[both] = np.searchsorted(within[k, s], y[both], side="right")
            tile = ((c.astype(np.int64) + 128) * (steps + 1) + strip) * (steps + 1) + row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(strip), pa.array(tile)], [*batch.schema.names, "_strip", "tile"])

    first = classed.mapInArrow(lambda b: stripped(b, None), f"{kind}, _strip long, tile long")
    rows = first.groupBy("_class", "_strip").agg(F.percentile_approx("_y", at, 1000).alias("q")).collect()
    within = {(r["_class"], r["_strip"]): picked(r.q, r["_class"]) for r in rows}
    return classed.mapInArrow(lambda b: stripped(b, within), f"{kind}, _strip long, tile long").select(*edges.columns, "tile")


def nearest_line(points: DataFrame, edges: DataFrame, key: str, part: int = PART) -> DataFrame:
    """(key, distance, road_id, road_type) of the nearest line of each point with finite coordinates, however far; ties by the least road_id, then road_type.

    edges: road_id, road_type, lat1, lon1, lat2, lon2; those that aren't finite are left out; without
    edges no point has a line. Distances are planar, in degrees times 111300. What comes to the driver is one
    row for each tile and one number of points for each, at most some MAX_TILES.
    """
    finite = lambda *names: reduce(and_, (F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in names))
    points = points.select(F.col(key).alias("key"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(finite("lat", "lon"))
    edges = edges.select("road_id", "road_type", *(F.col(c).cast("double").alias(c) for c in _PIECE)).where(finite(*_PIECE))
    # Of equal pieces only the least road is ever the answer, so copies make neither tiles nor searches longer.
    edges = edges.groupBy(*_PIECE).agg(F.min(F.struct("road_id", "road_type")).alias("_r")).select("_r.road_id", "_r.road_type", *_PIECE)
    ids = {c: t for c, t in edges.dtypes if c in ("road_id", "road_type")}
    key_type = points.schema["key"].dataType.simpleString()
    answer = f"key {key_type}, lat double, lon double, distance double, road_id {ids['road_id']}, road_type {ids['road_type']}"
    shape = f"tile long, {answer}"
    session = points.sparkSession
    n = edges.count()
    if n == 0:
        return session.createDataFrame([], answer).select(F.col("key").alias(key), "distance", "road_id", "road_type")
    tiled = _tiles(edges, n).withColumn("tile", F.col("tile").cast("long"))
    low, high = (lambda a: F.min(F.least(f"{a}1", f"{a}2"))), (lambda a: F.max(F.greatest(f"{a}1", f"{a}2")))
    top = tiled.groupBy("tile").agg(low("lat").alias("y0"), low("lon").alias("x0"), high("lat").alias("y1"), high("lon").alias("x1")).orderBy("tile").toArrow()
    directory = session.sparkContext.broadcast((top["tile"].to_numpy(), np.stack([top[c].to_numpy() for c in ("y0", "x0", "y1", "x1")])))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, boxes = directory.value
        tree, room = PackedTree(boxes), (boxes[2] - boxes[0]) * (boxes[3] - boxes[1])
        for batch in batches:
            y, x = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            home = np.zeros(len(y), np.int64)
            near = tree.descend(y, x)
            for point, k, far in tree.reached(y, x, _loose(PackedTree._far(boxes[:, near], y, x))):
                # Of several boxes that hold a point the smallest.
                order = np.lexsort((k, room[k], far, point))
                point, k = point[order], k[order]
                one = np.concatenate((point[:1] == point[:1], point[1:] != point[:-1]))
                home[point[one]] = k[one]
            yield pa.RecordBatch.from_arrays([pa.array(names[home]), *batch.columns], ["tile", "key", "lat", "lon"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, boxes = directory.value
        tree = PackedTree(boxes)
        for batch in batches:
            home, y, x, best = (batch.column(k).to_numpy() for k in (0, 2, 3, 4))
            # Answered already, unless another tile is as near.
            yield batch.set_column(0, "tile", pa.array(np.full(len(y), ANSWERED)))
            for point, k, _ in tree.reached(y, x, _loose(best / DEGREE)):
                other = names[k] != home[point]
                rows = batch.take(pa.array(point[other]))
                yield rows.set_column(0, "tile", pa.array(names[k][other]))

    routed = points.mapInArrow(route, f"tile long, key {key_type}, lat double, lon double")
    crowds = {r.tile: r["count"] for r in routed.groupBy("tile").count().collect()}
    crowds[ANSWERED] = sum(crowds.values())
    parts = {tile: -(-k // part) for tile, k in crowds.items() if k > part}
    parts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v).cast("long") for kv in parts.items() for v in kv)), F.col("tile")), F.lit(1)) if parts else F.lit(1)
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("key", "lat", "lon"), parts.cast("long")))
    pieces = tiled.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))

    def searched(df: DataFrame) -> DataFrame:
        return salted(df).groupBy("tile", "salt").cogroup(pieces.groupBy("tile", "salt")).applyInArrow(_search, shape)

    start = routed.select("*", F.lit(float("inf")).alias("distance"), F.lit(None).cast(ids["road_id"]).alias("road_id"), F.lit(None).cast(ids["road_type"]).alias("road_type"))
    # Answers go along as they are, there being no such tile; only the few rows for other tiles are searched again.
    second = searched(searched(start).mapInArrow(spread, shape))
    best = second.groupBy("key").agg(F.min(F.struct("distance", "road_id", "road_type")).alias("_b"))
    return best.select(F.col("key").alias(key), "_b.distance", "_b.road_id", "_b.road_type")
