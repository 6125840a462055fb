"""Cleaning of labelled segments: outlier flags and repair, smoothing, discards and their counts.

Flags, discards and the linear smoothing are window expressions. Repairs read values that
were repaired before, in order; they run in NumPy for each piece of a segment, cut where
nothing is to be repaired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tramline import schemas
from tramline.functions.scalar import mapped
from tramline.operators.kinematics import chunk_of, whole_rows

#: Least-squares weights of a quadratic in the middle of 5 and 7 points.
SMOOTHING = {5: ((-3, 12, 17, 12, -3), 35), 7: ((-2, 3, 6, 7, 6, 3, -2), 21)}

#: Points that smoothing and repair look at on each side, at most.
HALO = 3
#: Points of a segment after which it is cut, where it is quiet.
CHUNK = 1 << 16
_FIRST = -(1 << 62)


def not_finite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def outlier(label: Column, speed: Column, acceleration: Column) -> Column:
    """Beyond 1.2 times the speed limit or 1.5 times the acceleration limit of the label, below 0, or no number."""
    top = mapped(label, schemas.SPEED_LIMITS, F.lit(schemas.OTHER_SPEED_LIMIT))
    push = mapped(label, schemas.ACCEL_LIMITS, F.lit(schemas.OTHER_ACCEL_LIMIT))
    wrong = not_finite(speed) | not_finite(acceleration)
    return F.when(wrong, True).otherwise((speed < 0) | (speed > top * 1.2) | (F.abs(acceleration) > push * 1.5))


def flag_outliers(points: DataFrame) -> DataFrame:
    """points with label, speed, acceleration; adds is_outlier."""
    return points.withColumn("is_outlier", outlier(F.col("label"), F.col("speed"), F.col("acceleration")))


def outlier_share(flagged: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Share of flagged points of each segment, and whether it is over the limit."""
    return flagged.groupBy(*keys).agg(F.avg(F.col("is_outlier").cast("double")).alias("outlier_share"), F.count(F.lit(1)).alias("n_points")).withColumn(
        "discarded", F.col("outlier_share") > limit)


def repair_column(values: np.ndarray, flagged: np.ndarray) -> np.ndarray:
    """Each flagged value becomes the median of its neighbours up to two places off, as they then are."""
    out = values.astype(float).copy()
    for i in np.flatnonzero(flagged):
        near = np.concatenate((out[max(0, i - 2) : i], out[i + 1 : i + 3]))
        if not len(near):
            near = out[np.isfinite(out)]
        out[i] = np.median(near) if len(near) else 0.0
    return out


def settle_bearing(change: np.ndarray, limit: float) -> np.ndarray:
    """Inner values over the limit become the mean of themselves and both neighbours, one after the other."""
    out = change.astype(float).copy()
    for i in np.flatnonzero(out > limit):
        if 0 < i < len(out) - 1:
            out[i] = out[i - 1 : i + 2].mean()
    return out


def smooth_values(values: np.ndarray, window: int) -> np.ndarray:
    """The quadratic smoothing of ``smooth`` for one segment."""
    if len(values) < window:
        return values
    weights, total = SMOOTHING[window]
    padded = np.pad(values.astype(float), window // 2, mode="edge")
    return sum(float(w) * padded[k : k + len(values)] for k, w in enumerate(weights)) / float(total)


def _whole_segments(keys: list[str], change: Callable[[pd.DataFrame, list[slice]], pd.DataFrame]):
    """Applies ``change`` to rows and the slices of their segments, over batches of rows sorted by segment.

    A segment that goes on in the next batch waits in pieces, which are put together once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            differs = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy().copy()
            differs[0] = bool(waiting) and bool((pdf[keys].iloc[0] != waiting[-1][keys].iloc[-1]).any())
            starts = np.flatnonzero(differs)
            if len(starts):
                ready = sum(map(len, waiting))
                whole = pd.concat([*waiting, pdf.iloc[: starts[-1]]], ignore_index=True)
                bounds = [0, *(ready + starts).tolist()]
                yield change(whole, [slice(a, b) for a, b in zip(bounds, bounds[1:]) if b > a])
                waiting = []
            waiting.append(pdf.iloc[starts[-1] if len(starts) else 0 :])
        if waiting:
            rest = pd.concat(waiting, ignore_index=True)
            yield change(rest, [slice(0, len(rest))])

    return run


def _pieces(points: DataFrame, keys: list[str], order: str, quiet: Column, chunk: int, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """points, cut where no repair reaches across; adds _k, _piece, _halo.

    A segment is cut once for each ``chunk`` places of its order column, before the middle of the first 2 * HALO + 1 neighbours in
    that chunk which are all quiet (need no repair): so what a repair or a smoothing reads lies in the
    same piece, with the HALO points on the other side of a cut, which are there twice, marked _halo. A
    segment within one chunk, or without so many quiet neighbours, stays whole. One exchange of the points by
    segment and chunk and one row for each chunk; ``kept`` may filter these rows (with n, flagged), and the points with them.
    """
    base = points.select("*", F.struct(*keys).alias("_k"), chunk_of(order, chunk).alias("_c"))
    w = Window.partitionBy("_k", "_c").orderBy(order)
    near = w.rowsBetween(-HALO, HALO)
    calm = (F.count(F.lit(1)).over(near) == 2 * HALO + 1) & (F.sum(F.when(quiet, 0).otherwise(1)).over(near) == 0)
    marked = base.select("*", F.row_number().over(w).alias("_r"), calm.alias("_calm"))
    chunks = marked.groupBy("_k", "_c").agg(
        F.min(F.when(F.col("_calm"), F.col("_r"))).alias("_cut"), F.count(F.lit(1)).alias("n"), F.sum(F.col("is_outlier").cast("long") if "is_outlier" in points.columns else F.lit(0)).alias("flagged"), whole_rows(base)).where("_whole is not null").drop("_whole")
    if kept is not None:
        chunks = kept(chunks)
    v = Window.partitionBy("_k").orderBy("_c")
    chunks = chunks.withColumn("_first", F.row_number().over(v) == 1).withColumn("_cut", F.when(~F.col("_first"), F.col("_cut")))
    chunks = chunks.select("_k", "_c", "_cut", F.coalesce(F.last(F.when(F.col("_cut").isNotNull(), F.col("_c")), ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(_FIRST)).alias("_open"))
    if kept is None:
        # Segments of one chunk, nearly all, need no row.
        joined = marked.join(chunks.where(f"_cut is not null or _open <> {_FIRST}"), ["_k", "_c"], "left")
    else:
        joined = marked.join(chunks, ["_k", "_c"])
    after = F.coalesce(F.col("_r") >= F.col("_cut"), F.lit(False))
    open_ = F.coalesce("_open", F.lit(_FIRST))
    own = F.struct(F.when(after, F.col("_c")).otherwise(open_).alias("piece"), F.lit(False).alias("halo"))
    twice = F.struct(F.when(after, open_).otherwise(F.col("_c")).alias("piece"), F.lit(True).alias("halo"))
    both = F.when((F.col("_r") >= F.col("_cut") - HALO) & (F.col("_r") < F.col("_cut") + HALO), F.array(own, twice)).otherwise(F.array(own))
    return joined.select(*points.columns, "_k", F.explode(both).alias("_p")).select(*points.columns, "_k", F.col("_p.piece").alias("_piece"), F.col("_p.halo").alias("_halo"))


def _each_segment(points: DataFrame, keys: list[str], order: str, change: Callable[[pd.DataFrame, list[slice]], pd.DataFrame]) -> DataFrame:
    """Applies ``change`` to rows and the slices of their segments, many segments at a time."""
    return points.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(_whole_segments(keys, change), points.schema)


def _each_piece(pieces: DataFrame, order: str, schema: StructType, change: Callable[[pd.DataFrame, list[slice]], pd.DataFrame]) -> DataFrame:
    """Applies ``change`` to rows and the slices of their pieces, many pieces at a time; halos are left out."""
    names = schema.names

    def whole(pdf: pd.DataFrame, segments: list[slice]) -> pd.DataFrame:
        return change(pdf, segments).loc[lambda x: ~x["_halo"].to_numpy(bool), names]

    # A key of text, so that pandas compares plain values.
    keyed = pieces.withColumn("_k", F.to_json("_k", {"ignoreNullFields": "false"}))
    return keyed.repartition("_k", "_piece").sortWithinPartitions("_k", "_piece", order).mapInPandas(_whole_segments(["_k", "_piece"], whole), schema)


def _repaired(pdf: pd.DataFrame, segments: list[slice]) -> pd.DataFrame:
    marks = pdf["is_outlier"].to_numpy(bool)
    for c in ("speed", "acceleration", "bearing_change"):
        values = pdf[c].to_numpy(float).copy()
        for s in segments:
            if marks[s].any():
                values[s] = repair_column(values[s], marks[s])
        pdf[c] = values
    return pdf


def _level(limit: float) -> Column:
    """Whether no settling begins here, whatever the label."""
    return F.coalesce(F.col("bearing_change") <= limit * 0.8, F.lit(False))


def _settled(pdf: pd.DataFrame, segments: list[slice], limit: float) -> pd.DataFrame:
    values, slow = pdf["bearing_change"].to_numpy(float).copy(), pdf["label"].isin(["Walk", "Bike"]).to_numpy()
    for s in segments:
        values[s] = settle_bearing(values[s], limit * 0.8 if slow[s][0] else limit)
    pdf["bearing_change"] = values
    return pdf


def repair(flagged: DataFrame, keys: list[str], order: str = "step", chunk: int | None = None) -> DataFrame:
    """Repairs speed, acceleration and bearing_change of flagged points, segment by segment; with ``chunk`` (CHUNK, say) long ones in pieces of about so many points."""
    if chunk is None:
        return _each_segment(flagged, keys, order, _repaired)
    return _each_piece(_pieces(flagged, keys, order, ~F.col("is_outlier"), chunk), order, flagged.schema, _repaired)


def smooth(points: DataFrame, keys: list[str], window: int | None, order: str = "step", columns: tuple[str, ...] = ("speed", "acceleration")) -> DataFrame:
    """Quadratic smoothing over 5 or 7 points; ends repeat the outermost value; shorter segments stay."""
    if window is None:
        return points
    weights, total = SMOOTHING[window]
    by = Window.partitionBy(*keys)
    w = by.orderBy(order)
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    half = window // 2

    def at(c: str, k: int) -> Column:
        if k == 0:
            return F.col(c)
        if k < 0:
            return F.coalesce(F.lag(c, -k).over(w), F.first(c).over(all_of))
        return F.coalesce(F.lead(c, k).over(w), F.last(c).over(all_of))

    smoothed = {
        c: F.when(F.count(F.lit(1)).over(by) < window, F.col(c)).otherwise(sum((F.lit(float(x)) * at(c, k - half) for k, x in enumerate(weights)), F.lit(0.0)) / float(total))
        for c in columns
    }
    return points.select(*(smoothed[c].alias(c) if c in smoothed else F.col(c) for c in points.columns))


def smooth_bearing(points: DataFrame, keys: list[str], limit: float, order: str = "step", chunk: int | None = None) -> DataFrame:
    """Settles bearing changes over the limit, 0.8 times the limit for walking and cycling; with ``chunk`` long segments in pieces of about so many points."""
    if chunk is None:
        return _each_segment(points, keys, order, lambda pdf, segments: _settled(pdf, segments, limit))
    pieces = _pieces(points, keys, order, _level(limit), chunk)
    return _each_piece(pieces, order, points.schema, lambda pdf, segments: _settled(pdf, segments, limit))


def _discard_reason(n_points: Column, n_outliers: Column, p: schemas.Preset) -> Column:
    return F.when(~F.col("label").isin(*schemas.MODES), "other_label").when(n_points < p.min_length, "too_short").when(n_outliers / n_points > p.max_outlier_ratio, "too_many_outliers")


def verdicts(points: DataFrame, keys: list[str], mode: str = "balanced") -> DataFrame:
    """keys, label, n_points, n_outliers, discard_reason (null: kept) of each segment."""
    p = schemas.preset(mode)
    sums = flag_outliers(points).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_points"), F.sum(F.col("is_outlier").cast("long")).alias("n_outliers"))
    return sums.withColumn("discard_reason", _discard_reason(F.col("n_points"), F.col("n_outliers"), p))


def clean(points: DataFrame, keys: list[str], mode: str = "balanced", order: str = "step", chunk: int | None = None) -> DataFrame:
    """Points of the segments that are kept, repaired and smoothed. Distances and totals stay as they were.

    The same as ``verdicts``, ``repair``, ``smooth`` and ``smooth_bearing`` one after the
    other; rows of one segment with two labels are two segments. One exchange of the points by segment; with ``chunk``
    (CHUNK, say) one by segment and chunk and one by piece, and a segment of any length is many pieces.
    """
    p = schemas.preset(mode)
    every = [*keys, *(c for c in ("label",) if c not in keys)]
    flagged = flag_outliers(points)

    def change(pdf: pd.DataFrame, segments: list[slice]) -> pd.DataFrame:
        pdf = _repaired(pdf, segments)
        if p.window is None:
            return pdf
        for c in ("speed", "acceleration"):
            values = pdf[c].to_numpy(float).copy()
            for s in segments:
                values[s] = smooth_values(values[s], p.window)
            pdf[c] = values
        return _settled(pdf, segments, p.max_bearing_change)

    if chunk is None:
        by = Window.partitionBy(*every)
        counted = flagged.repartition(*every).withColumns({"_points": F.count(F.lit(1)).over(by), "_outliers": F.sum(F.col("is_outlier").cast("long")).over(by)})
        rows = counted.where(_discard_reason(F.col("_points"), F.col("_outliers"), p).isNull()).drop("_points", "_outliers")
        return rows.sortWithinPartitions(*every, order).mapInPandas(_whole_segments(every, change), rows.schema)
    totals = Window.partitionBy("_k")

    def kept(chunks: DataFrame) -> DataFrame:
        sums = chunks.withColumns({"n": F.sum("n").over(totals), "flagged": F.sum("flagged").over(totals)})
        return sums.withColumn("label", F.col("_k.label")).where(_discard_reason(F.col("n"), F.col("flagged"), p).isNull()).drop("label")

    quiet = ~F.col("is_outlier") & _level(p.max_bearing_change)
    return _each_piece(_pieces(flagged, every, order, quiet, chunk, kept), order, flagged.schema, change)


def funnel(points: DataFrame, keys: list[str], mode: str = "balanced") -> DataFrame:
    """Segments and points before and after cleaning, with the rates (0 of none)."""
    v = verdicts(points, keys, mode)
    kept = F.col("discard_reason").isNull()
    sums = v.agg(
        F.count(F.lit(1)).alias("segments"), F.count(F.when(kept, 1)).alias("kept_segments"), F.coalesce(F.sum("n_points"), F.lit(0)).alias("points"),
        F.coalesce(F.sum(F.when(kept, F.col("n_points"))), F.lit(0)).alias("kept_points"), F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("outliers"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return sums.withColumns({"retention_rate": rate("kept_segments", "segments"), "outlier_rate": rate("outliers", "points")})


def fill_gaps(points: DataFrame, keys: list[str], columns: tuple[str, ...] = ("lat", "lon"), step: float = 10.0, longest: float = 60.0) -> DataFrame:
    """Opt-in: points between two that are more than step and at most longest seconds apart, on the line between them."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq")
    gap = (F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")) / 1e6
    n = F.when((gap > step) & (gap <= longest), F.least(F.floor(gap / step), F.lit(5)).cast("int")).otherwise(1)
    ahead = points.select(*keys, "seq", "ts", *columns, gap.alias("_gap"), F.greatest(n, F.lit(1)).alias("_n"), *(F.lead(c).over(w).alias(f"_{c}") for c in columns))
    filled = ahead.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    share = F.col("_k") / F.col("_n")
    return filled.select(
        *keys, "seq", F.timestamp_micros(F.unix_micros("ts") + F.coalesce((share * F.col("_gap") * 1e6).cast("long"), F.lit(0))).alias("ts"),
        *((F.col(c) + F.when(F.col("_k") > 0, share * (F.col(f"_{c}") - F.col(c))).otherwise(0.0)).alias(c) for c in columns), (F.col("_k") > 0).alias("filled"))
