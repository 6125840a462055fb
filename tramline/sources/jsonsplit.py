"""Large JSON files as many tasks: the objects of one array of the root object, whatever their keys and texts.

Spark's text reader cuts a file into ranges at any closing brace. Where such a range begins,
inside a string or not and how deep, depends on all that comes before. So each range is
scanned twice. First for both cases (a range begins in a string or outside): whether it ends in one, and how it
changes the depth; a fold over these few numbers, one row for each range, gives every range its true
state. Then with that state, which tells what is an object of the array. Objects within
STEP bytes are told as they are; the few that go on are told in parts and put together by number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are scanned at a time.
STEP = 1 << 23
_KIND = np.zeros(256, np.int8)
for _c in b'"{}[]:':
    _KIND[_c] = 1
_DEEPER = np.zeros(256, np.int8)
for _c in b"{[":
    _DEEPER[_c] = 1
for _c in b"}]":
    _DEEPER[_c] = -1


class Marks:
    """Quotes, and brackets and colons outside of strings, of some bytes that begin in a string or not."""

    def __init__(self, raw: bytes, in_string: bool):
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(_KIND[data])
        what = data[at]
        quote = what == ord('"')
        if b"\\" in raw:
            # A quote after an odd number of backslashes is part of a string.
            slash = np.flatnonzero(data == ord("\\"))
            begins = np.concatenate(([True], np.diff(slash) > 1))
            first, last = slash[begins], slash[np.append(np.flatnonzero(begins)[1:] - 1, len(slash) - 1)]
            escaped = last[(last - first) % 2 == 0] + 1
            quote &= ~np.isin(at, escaped)
        inside = (np.cumsum(quote) + in_string) % 2 == 1
        self.in_string = bool(inside[-1]) if len(inside) else in_string
        self.quotes = at[quote]
        told = ~inside & ~quote & (what != ord('"'))
        self.at, self.what = at[told], what[told]
        deeper = _DEEPER[self.what].astype(np.int64)
        self.after = np.cumsum(deeper)
        self.before = self.after - deeper

    def is_key(self, colon: int, key: str) -> bool:
        """Whether the string before a colon is the key; bytes end at a closing brace, so never between a key without braces and its colon."""
        k = int(np.searchsorted(self.quotes, colon))
        if k < 2:
            return False
        try:
            return json.loads(self.raw[self.quotes[k - 2] : self.quotes[k - 1] + 1]) == key
        except ValueError:
            return False


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes | None]]:
    """((file, at), bytes) of rows (file, at, value) in the order of the file, STEP bytes or more at a time; None ends a range."""
    here, held, size = None, [], 0
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for file, at, value in zip(files, starts, batch.column(2)):
            if here != (file, at):
                if here is not None:
                    yield here, b"".join(held)
                    yield here, None
                here, held, size = (file, at), [], 0
            # Rows end where the reader took a closing brace away.
            value = value.as_py()
            held += (value, b"}")
            size += len(value) + 1
            if size >= STEP:
                yield here, b"".join(held)
                held, size = [], 0
    if here is not None:
        yield here, b"".join(held)
        yield here, None


def _shapes(key: str):
    """For each range and both ways to begin: how it ends, its change of depth, opening braces by depth, and whether the last key of each depth is the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, states = [], None
        for here, raw in _ranges(batches):
            if raw is None:
                out.append((*here, json.dumps([[s, d, sorted(o.items()), sorted(k.items())] for s, d, o, k in states])))
                states = None
                continue
            states = states or [(False, 0, {}, {}), (True, 0, {}, {})]
            for way, (in_string, depth, opens, keys) in enumerate(states):
                marks = Marks(raw, in_string)
                depths, counts = np.unique(marks.before[marks.what == ord("{")], return_counts=True)
                for d, n in zip(depths.tolist(), counts.tolist()):
                    opens[depth + d] = opens.get(depth + d, 0) + n
                colons = marks.what == ord(":")
                where, level = marks.at[colons], marks.before[colons]
                # From behind, the first of each depth is its last.
                levels, first = np.unique(level[::-1], return_index=True)
                for d, k in zip(levels.tolist(), first.tolist()):
                    keys[depth + d] = marks.is_key(int(where[len(where) - 1 - k]), key)
                states[way] = marks.in_string, depth + (int(marks.after[-1]) if len(marks.after) else 0), opens, keys
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["file", "at", "shape"])

    return run


def _fold(rows: list) -> dict[tuple[str, int], tuple[bool, int, bool, int]]:
    """State at the begin of each range: in a string, depth, under the key, objects so far."""
    known: dict[tuple[str, int], tuple[bool, int, bool, int]] = {}
    file, state = None, (False, 0, False, 0)

    def ended():
        if state[0] or state[1] > 0:
            raise ValueError(f"{file} ends within a JSON value")

    for row in sorted(rows, key=lambda r: (r.file, r.at)):
        if row.file != file:
            ended()
            file, state = row.file, (False, 0, False, 0)
        known[row.file, row.at] = state
        in_string, depth, under, number = state
        ends, change, opens, keys = json.loads(row.shape)[in_string]
        state = ends, depth + change, dict(map(tuple, keys)).get(1 - depth, under), number + dict(map(tuple, opens)).get(2 - depth, 0)
    ended()
    return known


def _objects(key: str, states):
    """(file, number, at, part, text): objects of the array; part is null for whole ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        here, part = None, 0
        for place, raw in _ranges(batches):
            if raw is None:
                continue
            if place != here:
                if place not in states.value:
                    raise RuntimeError(f"{place[0]} changed between two scans, or Spark cuts it otherwise now")
                here, part = place, 0
                in_string, depth, under, number = states.value[place]
            marks = Marks(raw, in_string)
            brace, level = (marks.what == ord("{")) & (marks.before + depth == 2), marks.after + depth
            starts, ends = marks.at[brace], marks.at[(marks.what == ord("}")) & (level == 2)] + 1
            colons = marks.at[(marks.what == ord(":")) & (marks.before + depth == 1)]
            under_at = np.array([under, *(marks.is_key(int(c), key) for c in colons)])
            wanted = under_at[np.searchsorted(colons, starts)]
            if depth > 2:
                # The object that is open goes on here, maybe to its end.
                if under:
                    out.append((here[0], number - 1, here[1], part, raw[: int(ends[0])] if len(ends) else raw))
                ends = ends[1:]
            whole = [(int(a), int(b), number + k) for k, (a, b, w) in enumerate(zip(starts, ends, wanted)) if w]
            for a, b, n in whole:
                out.append((here[0], n, here[1], None, raw[a:b]))
                if len(out) >= 2000:
                    yield _told(out)
                    out = []
            if len(starts) > len(ends) and wanted[-1]:
                out.append((here[0], number + len(starts) - 1, here[1], part, raw[int(starts[-1]) :]))
            in_string, depth, under, number, part = marks.in_string, int(level[-1]) if len(level) else depth, bool(under_at[-1]), number + len(starts), part + 1
        yield _told(out)

    return run


def _told(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([*arrays[:4], arrays[4].cast(pa.string())], ["file", "number", "at", "part", "text"])


def json_objects(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, number, text) of the objects of the root object's array ``key``, of files of any size, in any order of keys.

    Only objects are elements of the array; what else the root holds is passed over, objects as well. Numbers ascend with
    the place in the file. A file without the key, or an empty one, gives no row; one that ends before its
    root does raises. The first scan is done at once and brings one row for each range of a file to the driver, which
    Spark's driver lists as well.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))
    shapes = rows.mapInArrow(_shapes(key), "file string, at long, shape string").collect()
    states = _fold(shapes)
    found = rows.mapInArrow(_objects(key, spark.sparkContext.broadcast(states)), "file string, number long, at long, part long, text string")
    whole = found.where("part is null").select("file", "number", "text")
    # Few, at most two for each STEP bytes.
    parts = found.where("part is not null").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("at", "part", "text"))).alias("p"))
    return whole.unionByName(parts.select("file", "number", F.array_join(F.col("p.text"), "").alias("text")))


def parsed(objects: DataFrame, schema: str) -> DataFrame:
    """(file, number, f) with the objects as structs; one that is no JSON raises."""
    read = F.from_json("text", f"struct<{schema}, _wrong: string>", {"columnNameOfCorruptRecord": "_wrong"})
    seen = objects.select("file", "number", "text", read.alias("f"))
    wrong = F.raise_error(F.concat(F.lit("no JSON object: "), F.left("text", F.lit(200))))
    return seen.select("file", "number", F.when(F.col("f._wrong").isNotNull(), wrong.cast(seen.schema["f"].dataType)).otherwise(F.col("f")).alias("f"))
