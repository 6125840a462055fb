"""Line dedup (operator 7): a suffix array over line ids, by distributed prefix doubling.

A document is a sequence of line ids (128-bit hashes), and each of its lines starts a suffix.
The rank of a suffix is the id of its first line and its offset among the suffixes that start
with that line. Offsets are refined by doubling: suffixes that agree in h lines are sorted by
the rank of what follows h lines on (from h = 2 on also 2h and 3h lines on, two doublings by
one sort), and a running count over the sorted, range-partitioned
rows makes their new offsets, so no group has to fit one task. Ranks that follow are looked
up inside the document's own row. Suffixes that are unique or end go no further; lines that
occur once never enter.

The suffix array is the table of suffixes sorted by rank, equal ones by document. Neighbours
were separated between h and 4h lines for a known h. Where the lines before them are equal,
their common prefix is one shorter than that of the suffixes one line up; only for the others
are the lines from h to 4h fetched and compared. A sweep over the array with a stack of open
intervals then gives each suffix its longest common prefix with one that stands earlier in
the corpus: the maximal repeated runs, which are deleted. What passes between partitions (row
counts, last rows, stacks) is one row for each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import cut, written

#: Lines of the shortest run that counts as repeated.
MIN_LINES = 2
#: Words with a letter or digit that a single line needs to be deleted alone, where op7 asks for it.
LONE_WORDS = 2

#: States of a suffix: to be refined; its first line occurs twice or more.
OPEN, REPEATED = 1, 2
#: Marks of suffixes whose common prefix follows from the one above, or has to be compared.
FOLLOWS, UNKNOWN = -1, -2
_ENDLESS = 1 << 40
_GROUP = ["id", "off"]
_NEXT = ["id1", "off1", "id2", "off2", "id3", "off3"]
_ORDER = ["id", "off", "_id", "_h", "pos"]


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _line_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_id, _h, _text) to (_id, _h, ids): 16 bytes for each line."""
    import xxhash

    for batch in batches:
        ids = [b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in _lines(t.as_py())) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["_id", "_h", "ids"])


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
    """A partition as one batch; None if it has no rows."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.names.index(n)).to_numpy(zero_copy_only=False) for n in names]


def _repeat(column: pa.Array, sizes: list[int]) -> pa.Array:
    return column.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))


def _join(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)


def _open_suffixes(size: int):
    """Document rows to their open suffixes, with their rank and those ``size`` lines on, and 2 and 3 times as many (-1 at the end).

    At size 0 all suffixes, by the halves of the line's id; at 1 by one rank more only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                sizes, found = [], [[] for _ in range(10)]
                for ids, off, split, state in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                    first, second = np.frombuffer(ids, np.int64).reshape(-1, 2).T
                    n = len(first)
                    if size == 0:
                        pos, none = np.arange(n), np.zeros(n, np.int64)
                        columns = [pos, none, first, none, second, *[none] * 5]
                    else:
                        pos, off = np.flatnonzero(np.frombuffer(state, np.uint8) & OPEN), np.frombuffer(off, np.int64)
                        columns = [pos, np.frombuffer(split, np.int32)[pos], first[pos], off[pos]]
                        for step in range(1, 4):
                            inside, at = pos + step * size < n, np.minimum(pos + step * size, n - 1)
                            columns += [np.where(inside, first[at], 0), np.where(inside, off[at], -1)] if step == 1 or size > 1 else [np.zeros(len(pos), np.int64)] * 2
                    sizes.append(len(pos))
                    for part, column in zip(found, columns):
                        part.append(column)
                kinds = (np.int32, np.int32, *[np.int64] * 8)
                yield pa.RecordBatch.from_arrays(
                    [_repeat(batch.column(0), sizes), _repeat(batch.column(1), sizes), *(pa.array(_join(x, k)) for x, k in zip(found, kinds))],
                    ["_id", "_h", "pos", "split", *_GROUP, *_NEXT])

    return run


def _sorted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the order of the keys over all partitions, with ``part``, the number of the partition."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())


def _changes(a: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Whether any of the columns differs from the row before; true in the first row."""
    out = np.ones(len(a), bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (a, *more)])
    return out


def _group_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a partition sorted by group and key (the group and what follows): its first and last key, and rows in the last group and key."""
    batch = _whole(batches)
    if batch is None:
        return
    part, *keys = _numbers(batch, "part", *_GROUP, *_NEXT)
    n = len(part)
    group, key = np.flatnonzero(_changes(*keys[:2])), np.flatnonzero(_changes(*keys))
    row = [int(part[0]), n, *(int(k[0]) for k in keys), *(int(k[-1]) for k in keys), n - int(group[-1]), n - int(key[-1])]
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], [f"c{k}" for k in range(len(row))])


def _group_carries(rows: list[tuple]) -> dict[int, tuple[int, int, bool]]:
    """For each partition the rows before it of its first group and of its first key, and whether the last key goes on after it."""
    carries, group, key, n_group, n_key, before = {}, None, None, 0, 0, None
    for part, n, *keys, last_group, last_key in sorted(rows):
        first, last = tuple(keys[: len(keys) // 2]), tuple(keys[len(keys) // 2 :])
        n_group, n_key = (n_group if group == first[:2] else 0), (n_key if key == first else 0)
        if before is not None and n_key:
            carries[before] = (*carries[before][:2], True)
        carries[part] = (n_group, n_key, False)
        n_group, n_key = (n_group if last_group == n else 0) + last_group, (n_key if last_key == n else 0) + last_key
        group, key, before = last[:2], last, part
    return carries


def _refine(size: int, shared):
    """Sorted suffixes to their new offsets, by running counts inside the groups; ``shared`` has the carries of _group_carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _whole(batches)
        if batch is None:
            return
        part, split, group, off, *after = _numbers(batch, "part", "split", *_GROUP, *_NEXT)
        n_group, n_key, goes_on = shared.value[int(part[0])]
        n = len(part)
        new_group, new_key = _changes(group, off), _changes(group, off, *after)
        at = np.arange(n)
        group_at, key_at = np.maximum.accumulate(np.where(new_group, at, 0)), np.maximum.accumulate(np.where(new_key, at, 0))
        less = key_at - group_at
        less[group_at == 0] += n_group
        less[key_at == 0] -= n_key
        number = np.cumsum(new_key) - 1
        counts = np.bincount(number)
        counts[0] += n_key
        counts[-1] += goes_on
        several = counts[number] > 1
        state = (several & (np.minimum.reduce(after[1::2]) >= 0)) * OPEN + (several * REPEATED if size == 0 else 0)
        told = pa.array(several | (less > 0)) if size == 0 else pa.array(np.ones(n, bool))
        columns = [pa.array(off + less), pa.array(np.where(less > 0, size, split).astype(np.int32)), pa.array(state.astype(np.int32))]
        keys = [batch.column(batch.schema.names.index(c)) for c in ("_id", "_h", "pos")]
        yield pa.RecordBatch.from_arrays([c.filter(told) for c in (*keys, *columns)], ["_id", "_h", "pos", "off", "split", "state"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows with the list of their new (pos, off, split, state) to new document rows."""
    for batch in batches:
        news = batch.column(6)
        ends, flat = news.offsets.to_numpy(), news.values
        pos, *values = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        out = [[], [], [], []]
        for k, (ids, *old) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)))):
            n, here = len(ids) // 16, slice(ends[k], ends[k + 1])
            for o, raw, kind, new in zip(out, old, (np.int64, np.int32, np.uint8), values):
                whole = np.frombuffer(raw, kind).copy() if raw is not None else np.zeros(n, kind)
                # A state keeps that the first line is repeated.
                whole[pos[here]] = new[here] | (whole[pos[here]] & REPEATED) if kind is np.uint8 else new[here]
                o.append(whole.tobytes())
            out[3].append(bool((whole & OPEN).any()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), *(pa.array(x, pa.binary()) for x in out[:3]), pa.array(out[3], pa.bool_())],
            ["_id", "_h", "ids", "off", "split", "state", "open"])


def _rank(numbered: DataFrame, kind: str) -> DataFrame | None:
    """Document rows (_id, _h, ids, off, split, state) whose suffixes all have their final rank; those without a repeated line are left out."""
    blank = F.lit(None).cast("binary")
    docs, size, done = numbered.select("_id", "_h", "ids", blank.alias("off"), blank.alias("split"), blank.alias("state")), 0, None
    context = numbered.sparkSession.sparkContext
    fields = f"_id {kind}, _h long"
    while True:
        rows = docs.mapInArrow(_open_suffixes(size), f"{fields}, pos int, split int, " + ", ".join(f"{c} long" for c in (*_GROUP, *_NEXT)))
        # Read twice; a part that is lost with its executor is sorted again, from the written table.
        rows = _sorted(rows, [*_GROUP, *_NEXT, "_id", "_h", "pos"]).persist(StorageLevel.DISK_ONLY)
        ends = rows.mapInArrow(_group_ends, ", ".join(f"c{k} long" for k in range(20))).collect()
        shared = context.broadcast(_group_carries([tuple(r) for r in ends]))
        new = rows.mapInArrow(_refine(size, shared), f"{fields}, pos int, off long, split int, state int")
        lists = new.groupBy("_id", "_h").agg(F.collect_list(F.struct("pos", "off", "split", "state")).alias("news"))
        docs = written(docs.join(lists, ["_id", "_h"]).mapInArrow(_merge, f"{fields}, ids binary, off binary, split binary, state binary, open boolean"))
        rows.unpersist()
        ranked = docs.where("not open").drop("open")
        done = ranked if done is None else done.union(ranked)
        docs = docs.where("open").drop("open")
        if docs.isEmpty():
            return done
        size = size + 1 if size < 2 else 4 * size


def _ranked_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows to their suffixes with a repeated first line, with the lines left and the id of the line before."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            sizes, found, before = [], [[], [], [], [], []], []
            for ids, off, split, state in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                pos = np.flatnonzero(np.frombuffer(state, np.uint8) & REPEATED)
                first = np.frombuffer(ids, np.int64)[::2]
                for part, column in zip(found, (pos, first[pos], np.frombuffer(off, np.int64)[pos], np.frombuffer(split, np.int32)[pos], len(first) - pos)):
                    part.append(column)
                before += [ids[16 * (p - 1) : 16 * p] if p else None for p in pos.tolist()]
                sizes.append(len(pos))
            kinds = (np.int32, np.int64, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays(
                [_repeat(batch.column(0), sizes), _repeat(batch.column(1), sizes), *(pa.array(_join(x, k)) for x, k in zip(found, kinds)), pa.array(before, pa.binary())],
                ["_id", "_h", "pos", "id", "off", "split", "rest", "before"])


def _last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch = _whole(batches)
    if batch is not None:
        last = {n: c[-1].as_py() for n, c in zip(batch.schema.names, batch.columns)}
        yield pa.RecordBatch.from_arrays([pa.array([last["part"]], pa.int32()), pa.array([pickle.dumps(last)], pa.binary())], ["part", "last"])


def _shifted(batch: pa.RecordBatch, shared, name: str) -> pa.Array:
    """The column of the row before each; null in the first row of all."""
    column, known = batch.column(batch.schema.names.index(name)), shared.value
    before = known.get(int(batch.column(batch.schema.names.index("part"))[0].as_py()))
    return pa.concat_arrays([pa.array([before[name] if before else None], column.type), column.slice(0, len(column) - 1)])


def _neighbours(batch: pa.RecordBatch, shared) -> np.ndarray:
    """Common prefix of each suffix of the array with the one before it, or FOLLOWS or UNKNOWN."""
    group, off, split, rest = _numbers(batch, "id", "off", "split", "rest")
    same = lambda name: pc.fill_null(pc.equal(batch.column(batch.schema.names.index(name)), _shifted(batch, shared, name)), False).to_numpy(zero_copy_only=False)
    same_line, same_before = same("id"), same("before")
    equal = same_line & same("off")
    apart = np.where(split < 2, split, np.where(same_before, FOLLOWS, UNKNOWN))
    return np.where(equal, rest, np.where(same_line, apart, 0)).astype(np.int32)


def _known_prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _whole(batches)
        if batch is not None:
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in _ORDER), pa.array(_neighbours(batch, shared))], [*_ORDER, "lcp"])

    return run


def _requests(shared):
    """Which lines are needed to compare UNKNOWN neighbours: (_id, _h, at, size), 3 * size lines from at on, for the suffix (key_id, key_h, key_pos), one row for each of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _whole(batches)
        if batch is None:
            return
        wanted = pa.array(_neighbours(batch, shared) == UNKNOWN)
        key = [batch.column(batch.schema.names.index(c)).filter(wanted) for c in ("_id", "_h", "pos")]
        size = batch.column(batch.schema.names.index("split")).filter(wanted)
        for own in (key, [_shifted(batch, shared, c).filter(wanted) for c in ("_id", "_h", "pos")]):
            yield pa.RecordBatch.from_arrays([own[0], own[1], pc.add(own[2], size), size, *key], ["_id", "_h", "at", "size", "key_id", "key_h", "key_pos"])

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ids, list of requests) to the lines that each asks for; there are at most two requests for a line of the document."""
    for batch in batches:
        asks = batch.column(1)
        ends, flat = asks.offsets.to_numpy(), asks.values
        at, size = (flat.field(k).to_numpy(zero_copy_only=False).tolist() for k in (0, 1))
        found = []
        for k, ids in enumerate(batch.column(0)):
            ids = ids.as_py()
            found += [ids[16 * at[x] : 16 * (at[x] + 3 * size[x])] for x in range(ends[k], ends[k + 1])]
        here = slice(ends[0], ends[-1])
        keys = [flat.field(k)[here] for k in (2, 3, 4, 1)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(found, pa.binary())], ["_id", "_h", "pos", "size", "lines"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_id, _h, pos, size, two line sequences) to (_id, _h, pos, lcp)."""
    for batch in batches:
        out = []
        for size, a, b in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
            n = min(len(a), len(b)) // 16
            other = (np.frombuffer(a, np.int64, 2 * n) != np.frombuffer(b, np.int64, 2 * n)).reshape(n, 2).any(axis=1)
            out.append(size + (int(other.argmax()) if other.any() else n))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int32())], ["_id", "_h", "pos", "lcp"])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the list of their (pos, id, off, lcp), where off is -1 in compared ones, to all suffixes with their common prefix."""
    for batch in batches:
        rows = batch.column(2)
        ends, flat = rows.offsets.to_numpy(), rows.values
        pos, group, off, lcp = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        out, sizes = [[], [], [], []], []
        for a, b in zip(ends, ends[1:]):
            # By position; a compared row comes before the one that waits for it.
            order = a + np.lexsort((off[a:b], pos[a:b]))
            p, o, x = pos[order], off[order], lcp[order].copy()
            waits = np.flatnonzero(x == UNKNOWN)
            x[waits] = x[waits - 1]
            real = o >= 0
            p, x, order = p[real], x[real], order[real]
            known = np.maximum.accumulate(np.where(x != FOLLOWS, np.arange(len(x)), 0))
            x = x[known] - (np.arange(len(x)) - known)
            for part, column in zip(out, (p, group[order], off[order], x)):
                part.append(column)
            sizes.append(len(p))
        kinds = (np.int32, np.int64, np.int64, np.int32)
        yield pa.RecordBatch.from_arrays(
            [_repeat(batch.column(0), sizes), _repeat(batch.column(1), sizes), *(pa.array(_join(x, k)) for x, k in zip(out, kinds))], ["_id", "_h", "pos", "id", "off", "lcp"])


def sweep(prefixes: list[int], places: list, stack: list[tuple]) -> list[int]:
    """For suffixes in the order of the array, the longest common prefix with one before of a smaller place.

    prefixes are those with the suffix before. The stack of (common prefix with the last
    suffix, place) is changed; both ascend in it.
    """
    out = []
    for prefix, place in zip(prefixes, places):
        least = None
        while stack and stack[-1][0] >= prefix:
            least = stack.pop()[1]
        if least is not None and prefix:
            stack.append((prefix, least))
        # What stands later than this suffix is of no more use: this one is nearer.
        while stack and stack[-1][1] > place:
            stack.pop()
        out.append(stack[-1][0] if stack else 0)
        stack.append((_ENDLESS, place))
    return out


def _after(stack: list[tuple], least: int, own: list[tuple]) -> list[tuple]:
    """The stack behind a partition, from that before it, the least prefix of the partition and the stack of its own suffixes."""
    stack, low = list(stack), None
    while stack and stack[-1][0] >= least:
        low = stack.pop()[1]
    if low is not None and least:
        stack.append((least, low))
    while stack and own and stack[-1][1] > own[0][1]:
        stack.pop()
    return stack + own


def _pieces(batch: pa.RecordBatch, backward: bool, following: int, stack: list[tuple]) -> np.ndarray:
    """sweep over a partition, forward or backward, with few Python objects at a time."""
    n = batch.num_rows
    lcp = _numbers(batch, "lcp")[0]
    prefixes = np.append(lcp[1:], following) if backward else lcp
    keys = [batch.column(batch.schema.names.index(c)) for c in ("_id", "_h", "pos")]
    out = np.zeros(n, np.int64)
    bounds = [(lo, min(lo + 4096, n)) for lo in range(0, n, 4096)]
    for lo, hi in reversed(bounds) if backward else bounds:
        places = list(zip(*(k.slice(lo, hi - lo).to_pylist() for k in keys)))
        some = prefixes[lo:hi].tolist()
        out[lo:hi] = sweep(some[::-1], places[::-1], stack)[::-1] if backward else sweep(some, places, stack)
    return out


def _stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, pickled (first prefix, least of the others, stacks of the partition's own suffixes forward and backward))."""
    batch = _whole(batches)
    if batch is None:
        return
    lcp, part = _numbers(batch, "lcp", "part")
    stacks = []
    for backward in (False, True):
        stacks.append([])
        _pieces(batch, backward, 0, stacks[-1])
    told = (int(lcp[0]), int(lcp[1:].min()) if len(lcp) > 1 else _ENDLESS, *stacks)
    yield pa.RecordBatch.from_arrays([pa.array([int(part[0])], pa.int32()), pa.array([pickle.dumps(told)], pa.binary())], ["part", "told"])


def _stack_carries(told: dict[int, tuple]) -> dict[int, tuple[list[tuple], list[tuple], int]]:
    """For each partition the stack from the left, the one from the right, and the first prefix of the next partition."""
    parts, left, right, following = sorted(told), {}, {}, {}
    stack: list[tuple] = []
    for p in parts:
        left[p] = stack
        stack = _after(stack, min(told[p][0], told[p][1]), told[p][2])
    stack, first = [], 0
    for p in reversed(parts):
        right[p], following[p] = stack, first
        stack = _after(stack, min(first, told[p][1]), told[p][3])
        first = told[p][0]
    return {p: (left[p], right[p], following[p]) for p in parts}


def _longest(shared):
    """Sorted suffixes with common prefixes to (_id, _h, pos, run): the lines that also stand earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _whole(batches)
        if batch is None:
            return
        left, right, following = shared.value[batch.column(batch.schema.names.index("part"))[0].as_py()]
        runs = np.maximum(_pieces(batch, False, following, list(left)), _pieces(batch, True, following, list(right)))
        some = pa.array(runs > 0)
        keys = [batch.column(batch.schema.names.index(c)).filter(some) for c in ("_id", "_h", "pos")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(runs.astype(np.int32)).filter(some)], ["_id", "_h", "pos", "run"])

    return run


def suffix_array(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suffixes (_id, _h, pos, id, off, lcp, part) in the order of their ranks, and the document rows of _rank, for documents (_id, _h, _text).

    lcp is the common prefix with the suffix before, in lines. Suffixes whose first line
    occurs nowhere else are left out.
    """
    kind, context = docs.schema["_id"].dataType.simpleString(), docs.sparkSession.sparkContext
    fields = f"_id {kind}, _h long"
    numbered = written(docs.select("_id", "_h", "_text").mapInArrow(_line_ids, f"{fields}, ids binary").groupBy("_id", "_h").agg(F.first("ids").alias("ids")))
    ranked = _rank(numbered, kind)
    array = cut(_sorted(ranked.mapInArrow(_ranked_suffixes, f"{fields}, pos int, id long, off long, split int, rest int, before binary"), _ORDER))
    lasts, known, before = sorted((r["part"], r["last"]) for r in array.mapInArrow(_last_rows, "part int, last binary").collect()), {}, None
    for part, last in lasts:
        known[part], before = before, pickle.loads(last)
    shared = context.broadcast(known)

    asks = array.mapInArrow(_requests(shared), f"{fields}, at int, size int, key_id {kind}, key_h long, key_pos int")
    asks = asks.groupBy("_id", "_h").agg(F.collect_list(F.struct("at", "size", "key_id", "key_h", "key_pos")).alias("asks"))
    slices = ranked.select("_id", "_h", "ids").join(asks, ["_id", "_h"]).select("ids", "asks").mapInArrow(_slices, f"{fields}, pos int, size int, lines binary")
    two = slices.groupBy("_id", "_h", "pos").agg(F.max("size").alias("size"), F.min("lines").alias("a"), F.max("lines").alias("b"))
    compared = two.mapInArrow(_compare, f"{fields}, pos int, lcp int").select("_id", "_h", "pos", F.lit(0).cast("long").alias("id"), F.lit(-1).cast("long").alias("off"), "lcp")
    prefixes = array.mapInArrow(_known_prefixes(shared), f"id long, off long, {fields}, pos int, lcp int")
    each = prefixes.select("_id", "_h", "pos", "id", "off", "lcp").union(compared).groupBy("_id", "_h").agg(F.collect_list(F.struct("pos", "id", "off", "lcp")).alias("rows"))
    return cut(_sorted(each.mapInArrow(_follow, f"{fields}, pos int, id long, off long, lcp int"), _ORDER)), ranked


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(_id, _h, pos, run) for documents (_id, _h, _text): the most lines from pos on that also start at an earlier place (_id, _h, pos); none are left out."""
    array, _ = suffix_array(docs)
    told = {r["part"]: pickle.loads(r["told"]) for r in array.mapInArrow(_stacks, "part int, told binary").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(_stack_carries(told))
    return array.mapInArrow(_longest(shared), f"_id {docs.schema['_id'].dataType.simpleString()}, _h long, pos int, run int")


def _carries(line: str, words: int) -> bool:
    """Whether that many of the line's words (between white space) hold a letter or a digit."""
    for word in line.split():
        if words <= 0:
            break
        words -= any(map(str.isalnum, word))
    return words <= 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, lone_words: int | None = None) -> DataFrame:
    """Input columns and n_lines, n_removed, longest_run; the text keeps what no later copy covers.

    A run of at least min_lines lines is deleted where the same lines occur earlier, in a
    document of a lower id or further up in the same one; a copy may overlap what it
    copies. longest_run is the largest number of lines, of min_lines on, that the document
    holds in a row and that occur earlier. With lone_words
    a single line that occurs earlier goes too, if at least that many of its words hold a
    letter or a digit, so that blank lines and brackets stay; longest_run is then 1 at least.
    Lines are what lies between newlines, compared byte for byte, empty ones too. A text of which all lines go is empty. A null text
    stays null and counts as one empty line. Rows of one id with one text are one document
    and get the same result; with several texts they come in the order of a text hash. Rows
    with a null id are kept as they are. Other columns pass through, whatever they are called; those named like a result are replaced.
    A text has to fit a row, as all of its lines do; lines are compared by 128-bit hashes.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 at least")
    docs = docs.drop("n_lines", "n_removed", "longest_run")
    # Inside, columns go by number, so that none can clash.
    names = [f"c{k}" for k in range(len(docs.columns))]
    inner_id, inner_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = docs.toDF(*names).withColumn(inner_text, F.col(inner_text).cast("string")).withColumn("_h", F.xxhash64(inner_text))
    runs = repeated_runs(rows.where(F.col(inner_id).isNotNull()).select(F.col(inner_id).alias("_id"), "_h", F.col(inner_text).alias("_text")))
    found = runs.groupBy("_id", "_h").agg(F.collect_list(F.struct("pos", "run")).alias("_runs"))
    out = rows.join(found.withColumnRenamed("_id", inner_id), [inner_id, "_h"], "left").select(*names, "_runs")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.names.index(inner_text)
            texts, counts, removed, longest = [], [], [], []
            for text, own in zip(batch.column(column), batch.column(len(names))):
                text, own = text.as_py(), own.as_py() or ()
                lines = _lines(text)
                change, lone = np.zeros(len(lines) + 1, np.int64), []
                most = 0
                for r in own:
                    if r["run"] >= min_lines:
                        change[r["pos"]] += 1
                        change[r["pos"] + r["run"]] -= 1
                        most = max(most, r["run"])
                    elif lone_words is not None and _carries(lines[r["pos"]], lone_words):
                        lone.append(r["pos"])
                gone = np.cumsum(change[:-1]) > 0
                gone[lone] = True
                if text is None:
                    gone[:] = False
                texts.append(text if not gone.any() else "\n".join(x for x, g in zip(lines, gone.tolist()) if not g))
                counts.append(len(lines))
                removed.append(int(gone.sum()))
                longest.append(max(most, int(gone.any())))
            columns = [pa.array(texts, pa.string()) if k == column else batch.column(k) for k in range(len(names))]
            numbers = [pa.array(x, pa.int32()) for x in (longest, counts, removed)]
            yield pa.RecordBatch.from_arrays([*columns, *numbers], [*names, "longest_run", "n_lines", "n_removed"])

    fields = ", ".join(f"{n} {'string' if n == inner_text else f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    edited = out.mapInArrow(edit, f"{fields}, longest_run int, n_lines int, n_removed int")
    return edited.toDF(*docs.columns, "longest_run", "n_lines", "n_removed")
