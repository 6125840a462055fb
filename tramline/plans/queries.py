"""The registered queries: each operator over the derived tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline import schemas
from tramline.functions import scalar
from tramline.operators import cells, cleaning, kinematics, learning, models, nearest, resample, segments, spatial, weather
from tramline.plans import dashboards, fixtures
from tramline.plans.oracles import CTES, MODE_SQL, OUTLIER_SQL, sql
from tramline.session import working_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ["segment_id"]


def query(name: str, oracle: str | None = None, *needs: str):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle, *needs)
        return f

    return register


def r(column: str | Column, digits: int = 4) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits)


def add(name: str, make: Callable[[SparkSession, str], DataFrame], oracle: str | None = None, *needs: str) -> None:
    query(name, oracle, *needs)(make)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that sums in another order still compare."""
    return df.select(*(F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


# --- flagship: the travel mode of each track
def user_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = fixtures.features(spark, sf_dir).groupBy("user_id").agg(
        F.avg("speed").alias("avg_speed"), F.max("speed").alias("max_speed"), F.avg((F.col("speed") < 0.5).cast("double")).alias("stop_ratio"), F.count(F.lit(1)).alias("n_points"))
    return rounded(sums.withColumn("mode", learning.rule_mode(F.col("avg_speed"), F.col("max_speed"), F.col("stop_ratio"))))


add("entry_user_modes", user_modes, """select user_id, round(avg_speed,4) as avg_speed, round(max_speed,4) as max_speed, round(stop_ratio,4) as stop_ratio, n_points,
  case when max_speed > 45 then 'train' when avg_speed > 16 then 'car' when avg_speed > 7 then case when stop_ratio > 0.15 then 'bus' else 'car' end when avg_speed > 3.5 then 'bike' else 'walk' end as mode
  from (select user_id, avg(speed) as avg_speed, max(speed) as max_speed, avg(case when speed < 0.5 then 1.0 else 0.0 end) as stop_ratio, count(*) as n_points from kin group by user_id)""", "kin")

# --- projections
add("prj1_timestamp", lambda s, d: fixtures.points(s, d).select("seq", F.to_timestamp(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("ts")), "select seq, ts from pts", "pts")
add("prj2_label", lambda s, d: fixtures.mode_labels(s, d).select("user_id", F.unix_seconds("start_ts").alias("start_t"), scalar.normal_mode(F.col("raw_mode")).alias("label")), f"select user_id, start_t, {MODE_SQL} as label from mlab", "mlab")
add("prj3_api_mode", lambda s, d: fixtures.mode_labels(s, d).select(scalar.normal_mode(F.col("raw_mode")).alias("label")).distinct().select("label", scalar.api_mode(F.col("label")).alias("api")),
    f"select distinct label, case when label = 'Car & taxi' then 'car' else lower(label) end as api from (select {MODE_SQL} as label from mlab)", "mlab")
add("prj5_segment_id", lambda s, d: fixtures.segment_points(s, d).select("segment_id", "user_id", "label").distinct(), "select distinct segment_id, user_id, label from seg", "seg")
add("prj6_missing_feature", lambda s, d: fixtures.points(s, d).select("seq", *(F.col(c) if c in ("lat", "lon") else F.lit(0.0).alias(c) for c in ("lat", "lon", "altitude"))), "select seq, lat, lon, 0.0::double as altitude from pts", "pts")
add("prj7_geo_text", lambda s, d: fixtures.points(s, d).select("seq", "lat", "lon", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time")), "select seq, lat, lon, strftime(ts, '%Y-%m-%d %H:%M:%S') as time from pts", "pts")
BUCKET_SQL = "case when hour(ts) between 7 and 9 then 'morning' when hour(ts) between 11 and 13 then 'noon' when hour(ts) between 17 and 19 then 'evening' when hour(ts) >= 22 or hour(ts) <= 5 then 'night' else 'other' end"
add("prj8_time_bucket", lambda s, d: fixtures.points(s, d).groupBy(scalar.time_bucket(F.col("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), f"select {BUCKET_SQL} as bucket, count(*) as n from pts group by 1", "pts")
add("prj9_hour_date", lambda s, d: fixtures.points(s, d).select("seq", F.hour("ts").alias("hour"), F.to_date("ts").alias("date")), "select seq, hour(ts) as hour, cast(ts as date) as date from pts", "pts")
add("prj11_history_view", lambda s, d: history(s, d).select("trajectory_id", F.coalesce("mode", F.lit("unknown")).alias("mode"), F.format_string("%d%%", F.floor(F.col("confidence") * 100 + 0.5)).alias("confidence")),
    "select trajectory_id, mode, cast(cast(floor(confidence*100+0.5) as bigint) as varchar) || '%' as confidence from (select segment_id as trajectory_id, pred_label as mode, confidence from pred)", "pred")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.predictions(spark, sf_dir)
    return p.select("user_id", F.col("segment_id").alias("trajectory_id"), F.col("pred_label").alias("mode"), "confidence", (F.col("length") * 500.0).alias("distance"), F.col("start_ts").alias("created_at"))


HISTORY_SQL = "(select user_id, segment_id as trajectory_id, pred_label as mode, confidence, length*500.0 as distance, make_timestamp(start_t*1000000) as created_at from pred)"

# --- filters
add("flt1_valid_points", lambda s, d: kinematics.valid_points(fixtures.points(s, d).withColumn("lat", F.col("lat") + F.when(F.col("seq") % 50 == 0, 90.0).otherwise(0.0))).select("seq"),
    "select seq from pts where lat + case when seq % 50 = 0 then 90.0 else 0.0 end between -90 and 90 and lon between -180 and 180", "pts")
add("flt2_long_tracks", lambda s, d: kinematics.long_tracks(fixtures.points(s, d), 65).select("track_id", "seq"), "select track_id, seq from (select *, count(*) over (partition by track_id) as n from pts) where n >= 65", "pts")
add("flt3_long_segments", lambda s, d: fixtures.segment_points(s, d).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")), "select segment_id, count(*) as n from seg group by 1", "seg")
add("flt4_valid_labels", lambda s, d: fixtures.segment_points(s, d).where(F.col("label").isin(*schemas.MODES)).select("segment_id", "label").distinct(), "select distinct segment_id, label from seg where label in ('Bike','Bus','Car & taxi','Subway','Train','Walk')", "seg")


def finite_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.segment_points(spark, sf_dir).withColumn("speed", F.when(F.col("seq") % 301 == 0, float("nan")).otherwise(F.col("speed")))
    return p.groupBy("segment_id").agg(F.bool_or(cleaning.not_finite(F.col("speed"))).alias("bad")).where("not bad").select("segment_id")


add("flt5_finite_segments", finite_segments, "select segment_id from seg group by segment_id having not bool_or(seq % 301 = 0)", "seg")
add("flt7_green", lambda s, d: fixtures.predictions(s, d).select("segment_id", scalar.green(F.col("pred_label")).alias("green"), scalar.green(F.col("pred_label"), True).alias("green_transit")),
    "select segment_id, pred_label in ('Walk','Bike') as green, pred_label in ('Walk','Bike','Bus','Subway') as green_transit from pred", "pred")
add("flt8_bounding_box", lambda s, d: fixtures.points(s, d).where(F.col("lat").between(39.85, 39.95) & F.col("lon").between(116.3, 116.5)).select("seq"), "select seq from pts where lat between 39.85 and 39.95 and lon between 116.3 and 116.5", "pts")
add("flt9_rare_classes", lambda s, d: fixtures.predictions(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pred_label"))).where("n >= 2").select("segment_id", "pred_label"),
    "select segment_id, pred_label from (select *, count(*) over (partition by pred_label) as n from pred) where n >= 2", "pred")
add("flt10_misclassified", lambda s, d: fixtures.predictions(s, d).where("true_label != pred_label").select("segment_id", "true_label", "pred_label", r("confidence").alias("confidence")), "select segment_id, true_label, pred_label, round(confidence,4) as confidence from pred where true_label <> pred_label", "pred")
add("flt11_valid_roads", lambda s, d: fixtures.roads(s, d).where(F.col("road_type").isin(*schemas.VALID_ROADS)).select("node_id", "road_type"), "select node_id, road_type from rds where road_type in ('primary','secondary','tertiary','residential','footway','cycleway','bus_stop','station')", "rds")
add("flt12_drawable", lambda s, d: fixtures.points(s, d).withColumn("lat", F.when(F.col("seq") % 40 == 0, 0.0).otherwise(F.col("lat"))).where("lat is not null and lat != 0 and lon is not null and lon != 0").select("seq"), "select seq from pts where seq % 40 <> 0", "pts")

# --- point features
for _n, _c in enumerate(("time_diff", "distance", "speed", "acceleration", "bearing", "bearing_change", "total_distance", "total_time"), 2):
    add(f"win{_n}_{_c}", lambda s, d, c=_c: fixtures.features(s, d).select("seq", "step", r(c, 3).alias(c)), f"select seq, step, round({_c},3) as {_c} from kin", "kin")
add("win1_time_order", lambda s, d: fixtures.features(s, d).select("track_id", "seq", "step"), "select track_id, seq, step from kin", "kin")
add("win10_trip_summary", lambda s, d: rounded(kinematics.trip_summary(fixtures.features(s, d)), 3),
    "select track_id, round(sum(distance),3) as distance, sum(time_diff) as duration, round(sum(distance)/(sum(time_diff)+1e-6),3) as avg_speed, round(max(speed),3) as max_speed, count(*) as n_points from kin group by track_id", "kin")
add("win11_time_features", lambda s, d: rounded(kinematics.time_features(fixtures.features(s, d)), 3),
    """select track_id, seq, round(lat,3) as f0, round(lon,3) as f1, round(speed,3) as f2, round(acceleration,3) as f3, round(h,3) as f4, round(w,3) as f5, round(sin(2*pi()*h),3)+0.0 as f6, round(cos(2*pi()*h),3)+0.0 as f7,
      round(sin(2*pi()*w),3)+0.0 as f8, round(cos(2*pi()*w),3)+0.0 as f9, round(speed/(top+1e-6),3) as f10, round(least(1.0, speed/15.0),3) as f11
      from (select *, hour(ts)/24.0 as h, (isodow(ts)-1)/6.0 as w, max(speed) over (partition by track_id) as top from kin)""", "kin")

# --- segments and their statistics
add("seg1_label_join", lambda s, d: fixtures.segment_points(s, d).select("segment_id", "label", "seq", "length"), "select segment_id, label, seq, length from seg", "seg")
add("seg3_length_summary", lambda s, d: rounded(segments.length_summary(fixtures.segment_points(s, d).select("segment_id", "label", "length").distinct())),
    """select label, count(*) as n, min(length) as min_length, max(length) as max_length, round(avg(length),4) as mean_length, round(median(length),4) as median_length, round(count(*)*100.0/sum(count(*)) over (),4) as share
      from (select distinct segment_id, label, length from seg) group by label""", "seg")
for _n, _c in enumerate(schemas.STATS, 1):
    add(f"agg{_n}_{_c}", lambda s, d, c=_c: fixtures.segment_stats(s, d).select("segment_id", "label", r(c, 3).alias(c)), f"select segment_id, label, round({_c},3) as {_c} from stats", "stats")

# --- cleaning
_W = "(partition by segment_id order by step)"
_A = "(partition by segment_id order by step rows between unbounded preceding and unbounded following)"
add("cln1_outliers", lambda s, d: cleaning.flag_outliers(fixtures.segment_points(s, d)).select("segment_id", "seq", "is_outlier"), f"select segment_id, seq, {OUTLIER_SQL} as is_outlier from seg", "seg")
add("cln2_repair", lambda s, d: rounded(cleaning.repair(cleaning.flag_outliers(fixtures.segment_points(s, d)), KEYS).select("segment_id", "seq", "speed", "acceleration", "bearing_change"), 3))
_MOTION = ("speed", "acceleration", "bearing_change")


def _repair_sql(source: str, name: str) -> str:
    """CTEs that walk through all segments of a source at once, row by row; each row knows its two repaired predecessors."""
    ahead = ", ".join(f"lead({c},{k}) over {_W} as {c}{k}" for c in _MOTION for k in (1, 2))
    fixed = lambda c, before: f"case when {before}bad then list_aggregate([{{0}}n.{c}1, n.{c}2], 'median') else n.{c} end"
    first = ", ".join(f"{fixed(c, 'n.').format('')} as {c}, cast(null as double) as {c}_b" for c in _MOTION)
    then = ", ".join(f"{fixed(c, 'n.').format(f'o.{c}_b, o.{c}, ')}, o.{c}" for c in _MOTION)
    return f"""{name}_n as materialized (select *, row_number() over {_W} as r, {OUTLIER_SQL} as bad, {ahead} from {source}),
      {name}_r as (select n.segment_id, n.seq, n.r, {first} from {name}_n n where r = 1
        union all select n.segment_id, n.seq, n.r, {then} from {name}_r o join {name}_n n on n.segment_id = o.segment_id and n.r = o.r + 1)"""


def _settle_sql(source: str, name: str) -> str:
    """The same for bearing changes over 150, or 120 on foot and by bike."""
    return f"""{name}_n as materialized (select *, row_number() over {_W} as r, lead(bearing_change) over {_W} as b1, bearing_change > case when label in ('Walk', 'Bike') then 120 else 150 end as over from {source}),
      {name}_r as (select segment_id, seq, r, bearing_change from {name}_n where r = 1
        union all select n.segment_id, n.seq, n.r, case when n.over and n.b1 is not null then (o.bearing_change + n.bearing_change + n.b1)/3 else n.bearing_change end from {name}_r o join {name}_n n on n.segment_id = o.segment_id and n.r = o.r + 1)"""


def _walk(ctes: str, picks: str, *needs: str) -> str:
    """SQL with recursive CTEs after those that it needs."""
    return sql("\x00", *needs).replace("with ", "with recursive ", 1).replace("\n\x00", f",\n{ctes}\n{picks}")


ORACLES["cln2_repair"] = _walk(_repair_sql("seg", "fix"), "select segment_id, seq, round(speed,3) as speed, round(acceleration,3) as acceleration, round(bearing_change,3) as bearing_change from fix_r", "seg")
add("cln3_outlier_share", lambda s, d: rounded(cleaning.outlier_share(cleaning.flag_outliers(fixtures.segment_points(s, d)), KEYS, 0.25)),
    f"select segment_id, round(avg(case when {OUTLIER_SQL} then 1.0 else 0.0 end),4) as outlier_share, count(*) as n_points, avg(case when {OUTLIER_SQL} then 1.0 else 0.0 end) > 0.25 as discarded from seg group by segment_id", "seg")
add("cln4_too_short", lambda s, d: fixtures.segment_points(s, d).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < schemas.preset("strict").min_length), "select segment_id, count(*) as n from seg group by 1 having count(*) < 15", "seg")


def _smooth_sql(c: str, weights: tuple[int, ...], total: int) -> str:
    half = len(weights) // 2
    at = lambda k: c if k == 0 else f"coalesce(lag({c},{-k}) over {_W}, first_value({c}) over {_A})" if k < 0 else f"coalesce(lead({c},{k}) over {_W}, last_value({c}) over {_A})"
    return f"case when count(*) over (partition by segment_id) < {len(weights)} then {c} else ({' + '.join(f'({x})*{at(k - half)}' for k, x in enumerate(weights))})/{total}.0 end"


for _k, (_weights, _total) in cleaning.SMOOTHING.items():
    add(f"cln6_smooth_{_k}", lambda s, d, k=_k: rounded(cleaning.smooth(fixtures.segment_points(s, d).select("segment_id", "seq", "step", "speed", "acceleration"), KEYS, k), 3),
        f"select segment_id, seq, step, round({_smooth_sql('speed', _weights, _total)},3) as speed, round({_smooth_sql('acceleration', _weights, _total)},3) as acceleration from seg", "seg")
add("cln7_bearing", lambda s, d: rounded(cleaning.smooth_bearing(fixtures.segment_points(s, d), KEYS, 150.0).select("segment_id", "seq", "bearing_change"), 3))
ORACLES["cln7_bearing"] = _walk(_settle_sql("seg", "fix"), "select segment_id, seq, round(bearing_change,3) as bearing_change from fix_r", "seg")
VERDICT_SQL = f"""(select segment_id, label, count(*) as n_points, sum(case when {OUTLIER_SQL} then 1 else 0 end) as n_outliers,
  case when label not in ('Bike','Bus','Car & taxi','Subway','Train','Walk') then 'other_label' when count(*) < 10 then 'too_short' when avg(case when {OUTLIER_SQL} then 1.0 else 0.0 end) > 0.25 then 'too_many_outliers' end as discard_reason
  from seg group by segment_id, label)"""
add("cln8_verdicts", lambda s, d: cleaning.verdicts(fixtures.segment_points(s, d), KEYS), f"select segment_id, label, n_points, cast(n_outliers as bigint) as n_outliers, discard_reason from {VERDICT_SQL}", "seg")
add("cln9_cln10_funnel", lambda s, d: rounded(cleaning.funnel(fixtures.segment_points(s, d), KEYS)),
    f"""select count(*) as segments, count(*) filter (discard_reason is null) as kept_segments, cast(sum(n_points) as bigint) as points, cast(coalesce(sum(n_points) filter (discard_reason is null),0) as bigint) as kept_points,
      cast(sum(n_outliers) as bigint) as outliers, round(count(*) filter (discard_reason is null)/cast(count(*) as double),4) as retention_rate, round(sum(n_outliers)/cast(sum(n_points) as double),4) as outlier_rate from {VERDICT_SQL}""", "seg")

# --- resampling
_PLACES = """slots as (select segment_id, n, i as slot, case when i = 49 then n-1.0 else i*((n-1)/49.0::double) end as place from (select segment_id, count(*) as n from seg group by 1), range(50) g(i)),
  num as (select *, row_number() over (partition by segment_id order by step) - 1 as rr from seg)"""
_RES = lambda picks: sql(f"select s.segment_id, cast(s.slot as int) as slot, {picks}", "seg").replace("\nselect s.segment_id", ",\n" + _PLACES + "\nselect s.segment_id", 1)
add("res1_res2_resample", lambda s, d: rounded(resample.resample(fixtures.segment_points(s, d), KEYS, ["speed", "total_distance"]), 3))
ORACLES["res1_res2_resample"] = _RES("""round(a.speed + f*(coalesce(b.speed,a.speed)-a.speed),3) as speed, round(a.total_distance + f*(coalesce(b.total_distance,a.total_distance)-a.total_distance),3) as total_distance
  from (select *, case when n > 50 then 0.0 else place-floor(place) end as f from slots) s join num a on a.segment_id = s.segment_id and a.rr = floor(s.place) left join num b on b.segment_id = s.segment_id and b.rr = floor(s.place)+1""")
add("res3_pad", lambda s, d: rounded(resample.pad(fixtures.segment_points(s, d), KEYS, ["speed"]), 3))
ORACLES["res3_pad"] = _RES("round(coalesce(a.speed,0.0),3) as speed from slots s left join num a on a.segment_id = s.segment_id and a.rr = case when n > 50 then floor(place) else slot end")
add("res4_times", lambda s, d: resample.resample_times(fixtures.segment_points(s, d), KEYS).select("segment_id", "slot", F.unix_seconds("ts").alias("t")))
ORACLES["res4_times"] = _RES("a.t from slots s join num a on a.segment_id = s.segment_id and a.rr = case when n > 50 then floor(place) else least(slot, n-1) end")


def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, bring to 50 points, and take the statistics of these."""
    columns = ["lat", "lon", "speed", "acceleration", "bearing_change", "distance", "time_diff", "total_distance", "total_time"]
    cleaned = cleaning.clean(fixtures.segment_points(spark, sf_dir), KEYS)
    return rounded(segments.statistics(resample.resample(cleaned, KEYS, columns), KEYS, "slot"), 3)


add("res6_two_stage", two_stage)


def _two_stage_sql() -> str:
    """Kept segments, repaired, smoothed, settled, drawn on 50 slots, and their statistics."""
    columns = ("lat", "lon", "speed", "acceleration", "bearing_change", "distance", "time_diff", "total_distance", "total_time")
    weights, total = cleaning.SMOOTHING[5]
    ctes = [
        f"kept as materialized (select * from seg where segment_id in (select segment_id from {VERDICT_SQL} where discard_reason is null))",
        _repair_sql("kept", "fix"),
        "mended as materialized (select k.* replace (f.speed as speed, f.acceleration as acceleration, f.bearing_change as bearing_change) from kept k join fix_r f on k.segment_id = f.segment_id and k.seq = f.seq)",
        f"smoothed as materialized (select * replace ({_smooth_sql('speed', weights, total)} as speed, {_smooth_sql('acceleration', weights, total)} as acceleration) from mended)",
        _settle_sql("smoothed", "flat"),
        f"cleaned as materialized (select s.* replace (f.bearing_change as bearing_change), row_number() over {_W.replace('segment_id', 's.segment_id')} - 1 as rr, count(*) over (partition by s.segment_id) as n from smoothed s join flat_r f on s.segment_id = f.segment_id and s.seq = f.seq)",
        "places as (select distinct segment_id, label, n, i as slot, case when i = 49 then n-1.0 else i*((n-1)/49.0::double) end as place from cleaned, range(50) g(i))",
        "slotted as materialized (select p.segment_id, p.label, p.slot as step, " + ", ".join(f"a.{c} + case when p.n > 50 then 0.0 else place-floor(place) end*(coalesce(b.{c},a.{c})-a.{c}) as {c}" for c in columns)
        + " from places p join cleaned a on a.segment_id = p.segment_id and a.rr = floor(p.place) left join cleaned b on b.segment_id = p.segment_id and b.rr = floor(p.place)+1)",
        *(f"{name} as ({CTES[name][1].replace(' from seg', ' from slotted') if name == 'segb1' else CTES[name][1]})" for name in ("segb1", "segb2", "segrun", "segent", "stats"))]
    picks = ", ".join(f"round({c},3) as {c}" for c in schemas.STATS)
    return _walk(",\n".join(ctes), f"select segment_id, n_points, {picks} from stats", "seg")


ORACLES["res6_two_stage"] = _two_stage_sql()
_FIT = sql("""select p.segment_id, cast(p.slot as int) as slot, round(coalesce(a.speed,0.0),3) as speed from (
    select segment_id, i as slot, case when n > 2*20 then cast(floor(case when i = 19 then n-1.0 else i*((n-1)/19.0::double) end) as bigint) when n > 20 then i + cast(('0x' || md5(segment_id || '|42')[1:8]) as bigint) % (n-20+1) else i end as r
    from (select segment_id, count(*) as n from seg group by 1), range(20) g(i)) p
  left join (select *, row_number() over (partition by segment_id order by step) - 1 as rr from seg) a on a.segment_id = p.segment_id and a.rr = p.r""", "seg")
add("res5_fit_length", lambda s, d: rounded(resample.fit_length(fixtures.segment_points(s, d), KEYS, ["speed"], 20), 3))
ORACLES["res5_fit_length"] = _FIT


def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and the series of 50 rows of each segment; its length and its last speed tell the series."""
    series = resample.resample(fixtures.segment_points(spark, sf_dir), KEYS, ["speed", "acceleration"])
    both = resample.model_input(fixtures.segment_stats(spark, sf_dir), KEYS, series)
    return both.select("segment_id", r("speed_mean", 3).alias("speed_mean"), F.size("series").cast("long").alias("n_slots"), r(F.element_at("series", -1)["speed"], 3).alias("last_speed"))


add("res7_model_input", model_inputs, "select t.segment_id, round(t.speed_mean,3) as speed_mean, cast(50 as bigint) as n_slots, round(l.speed,3) as last_speed from stats t join (select segment_id, arg_max(speed, step) as speed from seg group by 1) l on t.segment_id = l.segment_id", "stats", "seg")


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 slots of each segment with a series that has but a point for each of its own rows, and none for segments of Walk."""
    points = fixtures.segment_points(spark, sf_dir)
    slots = resample.resample(points, KEYS, ["speed"]).select("segment_id", "slot")
    own = points.where("label != 'Walk'").select("segment_id", (F.row_number().over(Window.partitionBy("segment_id").orderBy("step")) - 1).alias("slot"), F.col("speed").alias("other"))
    return rounded(resample.reconcile(slots, own, KEYS, ["other"]), 3)


add("res8_reconcile", reconciled, """select p.segment_id, cast(p.slot as int) as slot, round(coalesce(a.speed,0.0),3) as other from (select distinct segment_id, i as slot from seg, range(50) g(i)) p
  left join (select *, row_number() over (partition by segment_id order by step) - 1 as rr from seg where label <> 'Walk') a on a.segment_id = p.segment_id and a.rr = p.slot""", "seg")

# --- spatial
add("geo7_road_class", lambda s, d: fixtures.roads(s, d).groupBy(spatial.road_class(F.col("road_type")).alias("road_class")).agg(F.count(F.lit(1)).alias("n")),
    "select case road_type when 'footway' then 'walk' when 'cycleway' then 'bike' when 'primary' then 'car' when 'secondary' then 'car' when 'residential' then 'car' when 'rail' then 'train' when 'subway' then 'subway' else 'unknown' end as road_class, count(*) as n from rds group by 1", "rds")
add("geo8_nearest_road", lambda s, d: spatial.nearest(fixtures.points(s, d), fixtures.roads(s, d), "seq", "node_id", 150.0).select("seq", "node_id", r("distance", 3).alias("distance")), "select seq, node_id, round(d,3) as distance from near", "near")
add("geo9_road_features", lambda s, d: spatial.road_features(fixtures.points(s, d), fixtures.roads(s, d), fixtures.pois(s, d), "seq"), "select seq, near_class, at_stop, road_class from roadf", "roadf")
add("geo10_geo11_poi_features", lambda s, d: rounded(spatial.poi_features(fixtures.points(s, d), fixtures.pois(s, d), "seq")), "select seq, has_bus_stop, has_station, has_parking, round(poi_distance,4) as poi_distance from poif", "poif")
add("geo12_road_density", lambda s, d: rounded(spatial.road_density(fixtures.points(s, d), fixtures.roads(s, d), "seq")), "select seq, round(road_density,4) as road_density from dens", "dens")
_HOT = ", ".join(f"cast(cast(road_class = '{c}' as int) as double) as road_{c}" for c in schemas.ROAD_CLASS_ORDER)
_FLAGS = ", ".join(f"cast(has_{t} as double) as has_{t}" for t in ("bus_stop", "station", "parking"))
VECTOR_SQL = f"select f.seq, {_HOT}, {_FLAGS}, round(poi_distance,4) as poi_distance, round(road_density,4) as road_density from roadf f join poif q on f.seq = q.seq join dens n on f.seq = n.seq"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.spatial_vector(fixtures.points(spark, sf_dir), fixtures.roads(spark, sf_dir), fixtures.pois(spark, sf_dir), "seq"))


add("geo13_spatial_vector", vectors, VECTOR_SQL, "roadf", "poif", "dens")
add("geo14_cell_shared", lambda s, d: spatial.cell_shared(vectors(s, d), fixtures.points(s, d), "seq").select("seq", "road_walk", "road_car", "poi_distance"),
    f"""select p.seq, v.road_walk, v.road_car, v.poi_distance from (select *, min(seq) over (partition by round_even(lat/0.001,0), round_even(lon/0.001,0)) as first_seq from pts) p join ({VECTOR_SQL}) v on v.seq = p.first_seq""", "pts", "roadf", "poif", "dens")
def cached_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points by a store that a run over the points of odd number has filled."""
    tables, path = [f(spark, sf_dir) for f in (fixtures.points, fixtures.roads, fixtures.pois)], f"{working_folder(spark)}/cells-{uuid.uuid4().hex}"
    cells.cached_vectors(tables[0].where("seq % 2 = 1"), *tables[1:], "seq", path)
    return rounded(cells.cached_vectors(*tables, "seq", path)).select("seq", "road_walk", "road_car", "poi_distance")


add("geo18_cached_cells", cached_cells,
    f"""select p.seq, v.road_walk, v.road_car, v.poi_distance from (select *, coalesce(min(case when seq % 2 = 1 then seq end) over cell, min(seq) over cell) as first_seq from pts window cell as (partition by round_even(lat/0.001,0), round_even(lon/0.001,0))) p
      join ({VECTOR_SQL}) v on v.seq = p.first_seq""", "pts", "roadf", "poif", "dens")
add("geo15_coverage", lambda s, d: spatial.road_features(fixtures.points(s, d), fixtures.roads(s, d), fixtures.pois(s, d), "seq").groupBy("road_class").agg(F.count(F.lit(1)).alias("n")), "select road_class, count(*) as n from roadf group by 1", "roadf")
add("geo16_poi_links", lambda s, d: rounded(spatial.poi_links(fixtures.pois(s, d), fixtures.roads(s, d)), 3),
    """, c as (select p.poi_id, r.node_id, 2*6371000.0*asin(sqrt(least(1.0, sin(radians(r.lat-p.lat)/2)*sin(radians(r.lat-p.lat)/2) + cos(radians(p.lat))*cos(radians(r.lat))*sin(radians(r.lon-p.lon)/2)*sin(radians(r.lon-p.lon)/2)))) as metres
        from poi p join rds r on abs(p.lat-r.lat) < 0.001 and abs(p.lon-r.lon) < 0.001 where sqrt((p.lat-r.lat)*(p.lat-r.lat)+(p.lon-r.lon)*(p.lon-r.lon))*111300 <= 100),
      b as (select * from (select *, row_number() over (partition by poi_id order by metres, node_id) as n from c) where n = 1)
    select 'poi_' || poi_id as src, 'road_' || node_id as dst, 'nearby_road' as kind, round(metres,3) as metres from b union all select 'road_' || node_id, 'poi_' || poi_id, 'has_poi', round(metres,3) from b""", "poi", "rds")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.road_edges(fixtures.roads(spark, sf_dir).select(F.floor(F.col("node_id") / 10).alias("road_id"), F.col("node_id").alias("pos"), "node_id", "lat", "lon"))


add("geo5_road_edges", lambda s, d: rounded(edges(s, d), 2),
    """select road_id, src, dst, round(2*6371000.0*asin(sqrt(least(1.0, sin(radians(lat2-lat)/2)*sin(radians(lat2-lat)/2) + cos(radians(lat))*cos(radians(lat2))*sin(radians(lon2-lon)/2)*sin(radians(lon2-lon)/2)))),2) as metres from (
      select node_id // 10 as road_id, node_id as src, lead(node_id) over w as dst, lat, lon, lead(lat) over w as lat2, lead(lon) over w as lon2 from rds window w as (partition by node_id // 10 order by node_id)) where dst is not null""", "rds")
add("geo17_graph_counts", lambda s, d: edges(s, d).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("road_id").alias("roads")), "select sum(n-1)::bigint as edges, count(*) filter (n > 1) as roads from (select count(*) as n from rds group by node_id // 10)", "rds")
GREEN = "pred_label in ('Walk','Bike')"


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of segments with what was predicted for them."""
    return fixtures.segment_points(spark, sf_dir).select("segment_id", "seq", "ts", "lat", "lon").join(fixtures.predictions(spark, sf_dir), "segment_id")


LOC = "(select s.segment_id, s.seq, s.ts, s.lat, s.lon, p.true_label, p.pred_label, p.confidence from seg s join pred p on s.segment_id = p.segment_id)"
add("geo20_green_grid", lambda s, d: rounded(spatial.grid_green(located(s, d), scalar.green(F.col("pred_label")))),
    f"""select cell_y, cell_x, n, n_green, round(n_green/cast(n as double),4) as green_ratio, round(cast(39.7+(cell_y+0.5)*0.005 as double),4) as lat, round(cast(116.1+(cell_x+0.5)*0.005 as double),4) as lon from (
      select cast(floor((lat-39.7)/0.005) as bigint) as cell_y, cast(floor((lon-116.1)/0.005) as bigint) as cell_x, count(*) as n, cast(sum(cast({GREEN} as int)) as bigint) as n_green from {LOC} group by 1, 2)""", "seg", "pred")
add("geo21_intensity", lambda s, d: rounded(spatial.grid_intensity(fixtures.points(s, d), 39.6, 116.2, 0.01, 60, 40)),
    """select cell_y, cell_x, n, round((n-lo)/(hi-lo+1e-6),4) as value from (select *, max(n) over () as hi, case when count(*) over () = 2400 then min(n) over () else 0 end as lo from (
      select cast(floor((lat-39.6)/0.01) as bigint) as cell_y, cast(floor((lon-116.2)/0.01) as bigint) as cell_x, count(*) as n from pts group by 1, 2) where cell_y between 0 and 59 and cell_x between 0 and 39) where (n-lo)/(hi-lo+1e-6) > 0.01""", "pts")
add("geo22_green_total", lambda s, d: rounded(dashboards.green_summary(fixtures.predictions(s, d), False)), f"select count(*) as n, cast(sum(cast({GREEN} as int)) as bigint) as n_green, round(avg(cast({GREEN} as int)),4) as green_share, round(avg(confidence),4) as mean_confidence from pred", "pred")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir).groupBy((F.floor((F.col("lat") - 39) * 20)).cast("string").alias("region")).agg(F.avg(scalar.green(F.col("pred_label")).cast("double")).alias("ratio"))


REGION = f"(select cast(cast(floor((lat-39)*20) as bigint) as varchar) as region, avg(cast({GREEN} as int)::double) as ratio from {LOC} group by 1)"
add("geo24_compare_regions", lambda s, d: rounded(dashboards.compare_regions(regions(s, d))),
    f"select region, round(ratio,4) as ratio, round(m,4) as mean_ratio, case when ratio-m > 0.05 then 'higher' when ratio-m < -0.05 then 'lower' else 'equal' end as verdict from (select *, avg(ratio) over () as m from {REGION})", "seg", "pred")
add("geo25_top_regions", lambda s, d: rounded(dashboards.top_regions(regions(s, d))), f"select region, round(ratio,4) as ratio from {REGION} z order by z.ratio desc, region limit 5", "seg", "pred")

# --- weather
add("wx1_defaults", lambda s, d: weather.fill_defaults(fixtures.weather(s, d)), "select date, temp, tmin, tmax, prcp, wspd from wxf", "wxf")
add("wx2_flags", lambda s, d: weather.with_flags(weather.fill_defaults(fixtures.weather(s, d))), "select * from wxf", "wxf")
add("wx3_nearest_day", lambda s, d: weather.nearest_day(fixtures.points(s, d).select(F.to_date("ts").alias("date")).distinct(), weather.with_flags(weather.fill_defaults(fixtures.weather(s, d)))), "select * from wxn", "wxn")
add("wx4_point_weather", lambda s, d: weather.point_weather(fixtures.points(s, d), fixtures.weather(s, d), "seq"),
    "select seq, " + ", ".join(f"coalesce({c}, 0.0) as {c}" for c in weather.FEATURES) + " from pts p join wxn w on cast(p.ts as date) = w.date", "pts", "wxn")
add("wx5_wx10_climate", lambda s, d: rounded(weather.climate_summary(weather.fill_defaults(fixtures.weather(s, d)))), "select count(*) as days, min(date) as first_day, max(date) as last_day, round(avg(temp),4) as mean_temp, sum(is_rainy) as rainy_days, sum(is_snowy) as snowy_days, sum(is_cold) as cold_days, sum(is_hot) as hot_days from wxf", "wxf")
_DAYS = "days as (select cast(unnest(generate_series((select min(date) from wx), (select max(date) from wx), interval 1 day)) as date) as date), cal as (select d.date, w.temp, w.prcp, w.wspd from days d left join wx w on d.date = w.date)"
add("wx6_calendar", lambda s, d: weather.calendar(fixtures.weather(s, d)), ", " + _DAYS + " select * from cal", "wx")
add("wx7_interpolate", lambda s, d: weather.interpolate(weather.calendar(fixtures.weather(s, d)), "temp", 13.5).select("date", r("temp").alias("temp")),
    ", " + _DAYS + """, k as (select *, last_value(temp ignore nulls) over a as v0, last_value(case when temp is not null then date end ignore nulls) over a as d0,
        first_value(temp ignore nulls) over b as v1, first_value(case when temp is not null then date end ignore nulls) over b as d1
      from cal window a as (order by date rows between unbounded preceding and current row), b as (order by date rows between current row and unbounded following))
    select date, round(coalesce(temp, case when date - d0 <= 7 then coalesce(v0 + (v1-v0)*(date-d0)/nullif(d1-d0,0), v0) end, 13.5),4) as temp from k""", "wx")
add("wx8_missing_rates", lambda s, d: rounded(weather.missing_rates(weather.calendar(fixtures.weather(s, d)), ["temp", "prcp", "wspd"])),
    ", " + _DAYS + " select 'temp' as \"column\", round(avg(cast(temp is null as int)),4) as missing_rate from cal union all select 'prcp', round(avg(cast(prcp is null as int)),4) from cal union all select 'wspd', round(avg(cast(wspd is null as int)),4) from cal", "wx")
add("wx9_station_features", lambda s, d: weather.station_features(fixtures.weather(s, d).withColumn("tavg", F.col("temp")).drop("temp")).select("date", "temp", "is_rainy", "is_windy", r("temp_norm").alias("temp_norm"), "month", "season"),
    "select date, temp, coalesce(cast(prcp > 0.5 as int),0)::double as is_rainy, cast(wspd > 6 as int)::double as is_windy, round(greatest(0.0, least(1.0,(temp+20)/60.0)),4) as temp_norm, cast(month(date) as int) as month, cast((month(date) % 12)//3 as int) as season from wx", "wx")
add("wx11_stand_in", lambda s, d: rounded(weather.stand_in(fixtures.points(s, d), "seq").select("seq", "w0", "w1", "w3", "w7"), 3),
    """select seq, cast(cast(h between 6 and 17 as int) as double) as w0, round(case when h between 6 and 17 then 18.0+7.0*sin((t-6)*pi()/12) else 12.0+5.0*sin((t-18)*pi()/12) end,3) as w1, round(1013.25+4.0*sin(t*pi()/6),3) as w3,
      cast(cast(h in (7,8,17,18) as int) as double) as w7 from (select seq, hour(ts) as h, hour(ts)+minute(ts)/60.0 as t from pts)""", "pts")
add("wx12_rain_join", lambda s, d: weather.rain_by_day(fixtures.points(s, d), fixtures.weather(s, d)).select("seq", "is_rainy"), "select seq, coalesce(cast(prcp > 0 as int),0) as is_rainy from pts p left join wx w on cast(p.ts as date) = w.date", "pts", "wx")

# --- dashboards
_SHARE = lambda v: f"round(count(*) filter (pred_label = '{v}')*100.0/count(*),2) as \"{v}\""
_SHARES = ", ".join(map(_SHARE, schemas.MODES))
add("dsh1_mode_by_bucket", lambda s, d: dashboards.shares(located(s, d).withColumn("bucket", scalar.time_bucket(F.col("ts"))), "bucket", "pred_label"), f"select {BUCKET_SQL} as bucket, {_SHARES} from {LOC} group by 1", "seg", "pred")
add("dsh2_mode_by_rain", lambda s, d: dashboards.distribution(weather.rain_by_day(located(s, d), fixtures.weather(s, d)), "pred_label", ["is_rainy"]),
    f"select is_rainy, pred_label, count(*) as n, round(count(*)*100.0/sum(count(*)) over (partition by is_rainy),2) as percent from (select pred_label, coalesce(cast(prcp > 0 as int),0) as is_rainy from {LOC} l left join wx w on cast(l.ts as date) = w.date) group by 1, 2", "seg", "pred", "wx")
add("dsh3_car_share_by_hour", lambda s, d: dashboards.hourly_share(located(s, d), "Car & taxi", "pred_label"),
    f"select cast(g.h as int) as hour, round(coalesce(x.share,0.0),2) as share from range(24) g(h) left join (select hour(ts) as hour, avg(cast(pred_label = 'Car & taxi' as int))*100.0 as share from {LOC} group by 1) x on g.h = x.hour", "seg", "pred")
add("dsh4_mode_by_road", lambda s, d: dashboards.shares(located(s, d).join(spatial.road_features(fixtures.points(s, d), fixtures.roads(s, d), fixtures.pois(s, d), "seq"), "seq"), "road_class", "pred_label"),
    f"select road_class, {_SHARES} from {LOC} l join roadf f on l.seq = f.seq group by 1", "seg", "pred", "roadf")
add("dsh5_predicted_shares", lambda s, d: dashboards.distribution(fixtures.predictions(s, d), "pred_label"), "select pred_label, count(*) as n, round(count(*)*100.0/sum(count(*)) over (),2) as percent from pred group by 1", "pred")
add("dsh7_top_errors", lambda s, d: dashboards.top_errors(fixtures.predictions(s, d)), "select true_label, count(*) as n_errors from pred where true_label <> pred_label group by 1 order by 2 desc, 1 limit 5", "pred")
add("dsh11_carbon", lambda s, d: rounded(dashboards.carbon(fixtures.predictions(s, d))), "select n as n_green, round(n*2*0.08::double,4) as carbon_kg, round(n*2*0.08::double/18,4) as trees from (select count(*) filter (true_label = pred_label and true_label in ('Walk','Bike','Bus','Subway')) as n from pred)", "pred")
add("dsh12_green_summary", lambda s, d: rounded(dashboards.green_summary(fixtures.predictions(s, d))), "select count(*) as n, cast(sum(cast(g as int)) as bigint) as n_green, round(avg(cast(g as int)),4) as green_share, round(avg(confidence),4) as mean_confidence from (select *, pred_label in ('Walk','Bike','Bus','Subway') as g from pred)", "pred")
add("dsh14_dataset_stats", lambda s, d: rounded(dashboards.dataset_stats(fixtures.predictions(s, d))), "select count(*) as segments, count(distinct user_id) as users, count(distinct true_label) as modes, round(avg(length),4) as mean_length from pred", "pred")
add("dsh15_mode_distribution", lambda s, d: dashboards.distribution(fixtures.predictions(s, d), "true_label"), "select true_label, count(*) as n, round(count(*)*100.0/sum(count(*)) over (),2) as percent from pred group by 1", "pred")
add("dsh16_cleaning_reasons", lambda s, d: cleaning.verdicts(fixtures.segment_points(s, d), KEYS, "strict").groupBy("discard_reason").agg(F.count(F.lit(1)).alias("n")),
    f"""select case when label not in ('Bike','Bus','Car & taxi','Subway','Train','Walk') then 'other_label' when n_points < 15 then 'too_short' when n_outliers/cast(n_points as double) > 0.15 then 'too_many_outliers' end as discard_reason, count(*) as n from {VERDICT_SQL} group by 1""", "seg")
add("dsh17_prediction_summary", lambda s, d: rounded(dashboards.prediction_summary(fixtures.predictions(s, d))), "select count(*) as total, cast(sum(cast(true_label = pred_label as int)) as bigint) as correct, cast(sum(cast(true_label <> pred_label as int)) as bigint) as wrong, round(avg(cast(true_label = pred_label as int)),4) as accuracy from pred", "pred")
add("dsh18_error_rows", lambda s, d: fixtures.predictions(s, d).where("true_label != pred_label").select("segment_id", "true_label", "pred_label"), "select segment_id, true_label, pred_label from pred where true_label <> pred_label", "pred")
add("dsh19_user_history", lambda s, d: dashboards.user_history(history(s, d), 7).select("trajectory_id", "mode", "distance"), f"select trajectory_id, mode, distance::double as distance from {HISTORY_SQL} where user_id = 7", "pred")
add("dsh20_page", lambda s, d: dashboards.page(history(s, d), 2, 10).select("trajectory_id", "mode"), f"select trajectory_id, mode from {HISTORY_SQL} order by created_at desc, trajectory_id limit 10 offset 10", "pred")
add("dsh21_dsh22_profile", lambda s, d: rounded(dashboards.user_profile(history(s, d))),
    f"""select user_id, count(*) as trips, round(avg(cast(mode in ('Walk','Bike') as int)),4) as slow_share, round(avg(cast(mode in ('Walk','Bike','Bus','Subway') as int)),4) as green_share, cast(floor(count(*)/10) as bigint)+1 as level,
      round(sum(round(case mode when 'Walk' then 0.15 when 'Bike' then 0.10 when 'Bus' then 0.05 when 'Subway' then 0.05 else 0 end::double*distance/1000.0,6)),4) as carbon_kg from {HISTORY_SQL} group by 1""", "pred")
add("dsh23_trip_carbon", lambda s, d: rounded(dashboards.trip_carbon(history(s, d))),
    f"""select trajectory_id, mode, round(kg,4) as carbon_kg, round(kg*0.05::double,4) as trees from (select trajectory_id, mode,
      case when mode in ('Walk','Bike','Bus','Subway') then greatest(0.0::double, (0.24::double - case mode when 'Walk' then 0.0 when 'Bike' then 0.0 when 'Bus' then 0.06 when 'Subway' then 0.04 else 0.24 end::double)*distance::double/1000) else 0.0::double end as kg from {HISTORY_SQL})""", "pred")
add("dsh24_confusion_pivot", lambda s, d: dashboards.pivoted_confusion(fixtures.predictions(s, d)), "select true_label, " + ", ".join(f"count(*) filter (pred_label = '{v}') as \"{v}\"" for v in schemas.MODES) + " from pred group by 1", "pred")
add("dsh25_five_numbers", lambda s, d: rounded(dashboards.five_numbers(fixtures.predictions(s, d))),
    "select pred_label, " + ", ".join(f"round(quantile_cont(confidence, {p}),4) as {n}" for n, p in (("minimum", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("maximum", 1.0))) + " from pred group by 1", "pred")
add("dsh26_report_classes", lambda s, d: learning.report(fixtures.predictions(s, d)).where(F.col("label").isin(*schemas.MODES)).select("label", r("f1").alias("f1"), "support"),
    "select label, round(coalesce(f1,0.0),4) as f1, support from rep where label in ('Bike','Bus','Car & taxi','Subway','Train','Walk')", "rep")
_RULE = lambda fast: f"case when max_speed > 45 then 'train' when avg_speed > 16 then '{fast}' when avg_speed > 7 then case when stop_ratio > 0.15 then 'bus' else 'car' end when avg_speed > 3.5 then 'bike' else 'walk' end"
add("dsh27_two_rules", lambda s, d: two_rules(s, d), f"select segment_id, {_RULE('car')} as base, {_RULE('subway')} as spatial from (select segment_id, avg(speed) as avg_speed, max(speed) as max_speed, avg(case when speed < 0.5 then 1.0 else 0.0 end) as stop_ratio from seg group by 1)", "seg")
add("dsh30_modes", lambda s, d: dashboards.mode_list(fixtures.segment_points(s, d)),
    "select m.label, m.api, coalesce(n, 0) as n_segments from (values " + ", ".join(f"('{k}', '{v}')" for k, v in schemas.API_MODES.items()) + ") m(label, api) left join (select label, count(distinct segment_id) as n from seg group by 1) c on c.label = m.label", "seg")


def two_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = fixtures.segment_points(spark, sf_dir).groupBy("segment_id").agg(F.avg("speed").alias("a"), F.max("speed").alias("m"), F.avg((F.col("speed") < 0.5).cast("double")).alias("q"))
    rule = lambda spatial_features: learning.rule_mode(F.col("a"), F.col("m"), F.col("q"), spatial_features)
    return sums.select("segment_id", rule(False).alias("base"), rule(True).alias("spatial"))


# --- learning
add("ml1_label_ids", lambda s, d: learning.encode_labels(fixtures.predictions(s, d), "true_label").select("true_label", "label_id"), "select true_label, cast(row_number() over (order by true_label) - 1 as int) as label_id from (select distinct true_label from pred)", "pred")
add("ml2_split", lambda s, d: learning.split(fixtures.predictions(s, d), "segment_id", "true_label").select("segment_id", "split"),
    """select segment_id, case when spot < 0.7 then 'train' when spot < 0.8::double - 1e-12 then 'valid' else 'test' end as split from (select segment_id, cast(('0x' || md5(true_label || '|' || segment_id || '|42')[1:8])::bigint as double)/4294967296.0 as spot from pred)""", "pred")
add("ml3_scaling", lambda s, d: rounded(learning.scaling(fixtures.segment_stats(s, d), ["speed_mean", "accel_mean", "linearity"]), 3),
    " union all ".join(f"select '{c}' as \"column\", round(avg({c}),3) as mean, round(case when stddev_pop({c}) < 1e-6 then 1.0 else stddev_pop({c}) end,3) as divisor from stats" for c in ("speed_mean", "accel_mean", "linearity")), "stats")
_N = "(select true_label as label, cast(count(*) as double) as n from pred group by 1)"
for _m, _e in (("inverse", "tot/(c*n)"), ("sqrt_inverse", "sqrt(tot/(c*n))"), ("effective", "(1.0-0.9999::double)/(1.0-pow(0.9999::double,n))")):
    add(f"ml4_weights_{_m}", lambda s, d, m=_m: rounded(learning.class_weights(fixtures.predictions(s, d), m, "true_label")),
        f"select label as true_label, cast(n as bigint) as n, round(raw/avg(raw) over (),4) as weight from (select *, {_e} as raw from (select *, sum(n) over () as tot, count(*) over () as c from {_N}))", "pred")
add("ml7_rules", lambda s, d: fixtures.predictions(s, d).select("segment_id", "pred_label"), "select segment_id, pred_label from pred", "pred")
add("ml13_softmax", lambda s, d: fixtures.segment_stats(s, d).select("segment_id", F.array("speed_mean", "accel_mean", F.lit(1.0)).alias("z")).select("segment_id", learning.argmax(F.col("z")).alias("best"), F.round(F.array_max(learning.softmax(F.col("z"))), 4).alias("confidence")),
    "select segment_id, cast(case when a >= b and a >= 1 then 0 when b >= 1 then 1 else 2 end as int) as best, round(1.0/(exp(a-m)+exp(b-m)+exp(1-m)),4) as confidence from (select segment_id, speed_mean as a, accel_mean as b, greatest(speed_mean, accel_mean, 1.0) as m from stats)", "stats")
add("ml11_focal_loss", lambda s, d: fixtures.predictions(s, d).select("segment_id", r(learning.focal_loss(F.array(F.col("confidence"), 1 - F.col("confidence")), F.lit(0), 2)).alias("loss")),
    "select segment_id, round(-pow(1-confidence,2)*0.95*ln(confidence+1e-8) - pow(confidence,2)*0.05*ln(1-confidence+1e-8),4) as loss from pred", "pred")
add("ml11_cross_entropy", lambda s, d: fixtures.predictions(s, d).select("segment_id", r(learning.weighted_cross_entropy(F.array(F.col("confidence"), 1 - F.col("confidence")), F.lit(0), F.array(F.lit(2.0), F.lit(1.0)))).alias("loss")),
    "select segment_id, round(-2.0*ln(confidence+1e-8),4) as loss from pred", "pred")
add("ml15_report", lambda s, d: rounded(learning.report(fixtures.predictions(s, d))),
    """select label, round(precision,4) as precision, round(recall,4) as recall, round(f1,4) as f1, support from rep
    union all select 'macro avg', round(avg(precision),4), round(avg(recall),4), round(avg(f1),4), cast(sum(support) as bigint) from rep
    union all select 'weighted avg', round(sum(precision*support)/sum(support),4), round(sum(recall*support)/sum(support),4), round(sum(f1*support)/sum(support),4), cast(sum(support) as bigint) from rep
    union all select 'accuracy', round(avg(h),4), round(avg(h),4), round(avg(h),4), count(*) from (select cast(true_label = pred_label as int) as h from pred)""", "rep")
add("ml16_confusion", lambda s, d: learning.confusion(fixtures.predictions(s, d)), "select true_label, pred_label, count(*) as n from pred group by 1, 2", "pred")
add("ml17_point_predictions", lambda s, d: located(s, d).select("segment_id", "seq", "lat", "true_label", "pred_label", r("confidence").alias("confidence")), f"select segment_id, seq, lat, true_label, pred_label, round(confidence,4) as confidence from {LOC}", "seg", "pred")
add("dsh29_report_maps", lambda s, d: dashboards.reshape_report(rounded(learning.report(fixtures.predictions(s, d)))).select(F.element_at("f1", "Walk").alias("walk_f1"), F.size("recall").cast("long").alias("labels")),
    "select max(case when label = 'Walk' then round(f1,4) end) as walk_f1, count(*) as labels from rep", "rep")
add("dsh31_summary", lambda s, d: rounded(learning.report(fixtures.predictions(s, d)).where(F.col("label").isin("macro avg", "weighted avg")).select("label", "f1", "support")),
    "select 'macro avg' as label, round(avg(f1),4) as f1, cast(sum(support) as bigint) as support from rep union all select 'weighted avg', round(sum(f1*support)/sum(support),4), cast(sum(support) as bigint) from rep", "rep")


# --- more projections, checks and dashboards
DISPLAY = {"Walk": "步行", "Bike": "骑行", "Bus": "公交", "Subway": "地铁", "Train": "火车", "Car & taxi": "小汽车"}  # fixed values
add("prj4_display_name", lambda s, d: fixtures.predictions(s, d).select("segment_id", scalar.mapped(F.col("pred_label"), DISPLAY, F.col("pred_label")).alias("name")),
    "select segment_id, case pred_label " + " ".join(f"when '{k}' then '{v}'" for k, v in DISPLAY.items()) + " else pred_label end as name from pred", "pred")
_NINE = ("lat", "lon", "speed", "acceleration", "bearing_change", "distance", "time_diff", "total_distance", "total_time")
add("prj10_point_features", lambda s, d: rounded(fixtures.features(s, d).select("seq", *_NINE), 3).join(vectors(s, d), "seq"),
    "select k.seq, " + ", ".join(f"round(k.{c},3) as {c}" for c in _NINE) + f", v.* exclude (seq) from kin k join ({VECTOR_SQL}) v on k.seq = v.seq", "kin", "roadf", "poif", "dens")
add("cln5_time_gaps", lambda s, d: cleaning.fill_gaps(fixtures.points(s, d), ["track_id"], step=10.0, longest=5.0).select("track_id", "seq", "lat", "lon", "filled"), "select track_id, seq, lat, lon, false as filled from pts", "pts")
add("geo23_green_colour", lambda s, d: spatial.grid_green(located(s, d), scalar.green(F.col("pred_label"))).select("cell_y", "cell_x", dashboards.ramp(F.col("green_ratio")).alias("c")).select("cell_y", "cell_x", "c.*"),
    f"""select cell_y, cell_x, cast(floor(255*(1-g)) as bigint) as red, cast(floor(255*g+100*(1-g)) as bigint) as green, cast(floor(50*(1-g)) as bigint) as blue from (
      select cast(floor((lat-39.7)/0.005) as bigint) as cell_y, cast(floor((lon-116.1)/0.005) as bigint) as cell_x, sum(cast({GREEN} as int))/cast(count(*) as double) as g from {LOC} group by 1, 2)""", "seg", "pred")
add("geo25_map_scale", lambda s, d: rounded(dashboards.map_scale(regions(s, d))), f"select round(ratio,4) as scale from (select ratio, row_number() over (order by ratio) as n, count(*) over () as c from {REGION} where ratio > 0) where n = floor(c*0.8)+1", "seg", "pred")


def all_road_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight pieces between road nodes of one group of ten."""
    nodes = fixtures.roads(spark, sf_dir)
    w = Window.partitionBy(F.floor(F.col("node_id") / 10)).orderBy("node_id")
    ahead = nodes.select(F.col("node_id").alias("road_id"), "road_type", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    return ahead.where("lat2 is not null")


_LINES = "(select node_id as road_id, lat as lat1, lon as lon1, lead(lat) over w as lat2, lead(lon) over w as lon2 from rds window w as (partition by node_id // 10 order by node_id))"


def _line_sql(lines: str, near: str, limit: str) -> str:
    """The nearest piece of each point: the distance to the foot of the perpendicular, or to the nearer end."""
    return f""", ln as (select * from {_LINES} where {lines}),
    a as (select p.seq, l.road_id, p.lat, p.lon, lat1, lon1, lat2-lat1 as dy, lon2-lon1 as dx, greatest(0.0, least(1.0, coalesce(((p.lat-lat1)*(lat2-lat1)+(p.lon-lon1)*(lon2-lon1))/nullif((lat2-lat1)*(lat2-lat1)+(lon2-lon1)*(lon2-lon1),0),0.0))) as f
      from pts p join ln l on {near}),
    b as (select seq, road_id, sqrt(pow(lat-(lat1+f*dy),2)+pow(lon-(lon1+f*dx),2))*111300 as d from a),
    c as (select seq, min(struct_pack(d := d, road_id := road_id)) as m from b where {limit} group by seq)
    select seq, m.road_id as road_id, round(m.d,3) as distance from c"""


# All pieces and no threshold; the SQL compares all pairs.
add("geo19_nearest_line", lambda s, d: nearest.nearest_line(fixtures.points(s, d), all_road_lines(s, d), "seq").select("seq", "road_id", r("distance", 3).alias("distance")),
    _line_sql("lat2 is not null", "true", "true"), "pts", "rds")
# The same job under the name that it had first, on all points.
add("geo19_nearest_any_line", lambda s, d: nearest.nearest_line(fixtures.points(s, d), all_road_lines(s, d), "seq").select("seq", "road_id", r("distance", 3).alias("distance")),
    _line_sql("lat2 is not null", "true", "true"), "pts", "rds")
# The road that each POI stands at.
add("geo19_poi_line", lambda s, d: nearest.nearest_line(fixtures.pois(s, d), all_road_lines(s, d), "poi_id").select("poi_id", "road_id", r("distance", 3).alias("distance")),
    _line_sql("lat2 is not null", "true", "true").replace("p.seq", "p.poi_id").replace("select seq", "select poi_id").replace("group by seq", "group by poi_id").replace("from pts p", "from poi p"), "poi", "rds")
# A search within a radius, as maps ask for it: all pieces, points without one within 300 m have no row.
add("geo19_line_within_300m", lambda s, d: spatial.nearest_segment(fixtures.points(s, d), all_road_lines(s, d), "seq", 300.0, 1).select("seq", "road_id", r("distance", 3).alias("distance")),
    _line_sql("lat2 is not null", "p.lat between least(lat1,lat2)-0.003 and greatest(lat1,lat2)+0.003 and p.lon between least(lon1,lon2)-0.003 and greatest(lon1,lon2)+0.003", "d <= 300"), "pts", "rds")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two classifiers: rules without and with spatial features."""
    p = fixtures.predictions(spark, sf_dir)
    plain = p.withColumn("pred_label", F.when(F.col("pred_label") == "Subway", "Car & taxi").otherwise(F.col("pred_label")))
    return learning.report(plain).withColumn("experiment", F.lit("exp1")).union(learning.report(p).withColumn("experiment", F.lit("exp2")))


def _report_sql(guess: str) -> str:
    """Per-label rows of a report over pred with another guess."""
    return f"""(select label, coalesce(hits/nullif(cast(support as double),0),0.0) as recall, coalesce(2.0*hits/nullif(guesses+support,0),0.0) as f1 from (
      select l.label, (select count(*) from pred where true_label = l.label) as support, (select count(*) from pred where {guess} = l.label) as guesses, (select count(*) from pred where true_label = l.label and {guess} = l.label) as hits
      from (select true_label as label from pred union select {guess} from pred) l))"""


_PLAIN = "case when pred_label = 'Subway' then 'Car & taxi' else pred_label end"
_TREND = " union all ".join(f"select '{e}' as experiment, (select avg(cast(true_label = {g} as int)) from pred) as accuracy, (select avg(f1) from {_report_sql(g)} z) as macro_f1" for e, g in (("exp1", _PLAIN), ("exp2", "pred_label")))
add("dsh6_experiment_trend", lambda s, d: rounded(dashboards.experiment_trend(reports(s, d))), f"select experiment, round(accuracy,4) as accuracy, round(macro_f1,4) as macro_f1 from ({_TREND})", "pred")
add("dsh8_gain_shares", lambda s, d: rounded(dashboards.gain_shares(dashboards.experiment_trend(reports(s, d)))),
    f"select 'exp2' as experiment, round(b-a,4) as gain, case when b > a then 1.0::double end as share from (select max(case when experiment = 'exp1' then macro_f1 end) as a, max(case when experiment = 'exp2' then macro_f1 end) as b from ({_TREND}))", "pred")
add("dsh9_top_three", lambda s, d: dashboards.top_errors(fixtures.predictions(s, d), 3), "select true_label, count(*) as n_errors from pred where true_label <> pred_label group by 1 order by 2 desc, 1 limit 3", "pred")
add("dsh10_recall_series", lambda s, d: rounded(dashboards.recall_series(reports(s, d))),
    " union all ".join(f"select '{e}' as experiment, label, round(recall,4) as recall from {_report_sql(g)} z where label in ('Bike','Bus')" for e, g in (("exp1", _PLAIN), ("exp2", "pred_label"))), "pred")
add("dsh32_total", lambda s, d: dashboards.distribution(fixtures.predictions(s, d), "pred_label").agg(F.sum("n").alias("total")), "select count(*) as total from pred", "pred")
def _unit_sql(*parts: str) -> str:
    return f"((cast(('0x' || md5({' || chr(124) || '.join(parts)})[1:8]) as bigint) + 0.5::double)/4294967296.0::double)"


add("ml5_scaled_copies", lambda s, d: rounded(learning.augment(fixtures.segment_points(s, d), "scale", KEYS).select("segment_id", "seq", "speed", "acceleration"), 3),
    f"select segment_id, seq, round(speed*f,3) as speed, round(acceleration*f,3) as acceleration from (select *, 0.85::double + 0.3::double*{_unit_sql('segment_id', chr(39) + 'scale' + chr(39), chr(39) + '42' + chr(39))} as f from seg)", "seg")
_NOISE = ("speed", "acceleration", "bearing_change", "distance", "time_diff")
_NORMAL = lambda c: (
    f"sqrt(-2*ln({_unit_sql('segment_id', 'step', repr(c), repr('1'), repr('42'))}))*cos(6.283185307179586::double*{_unit_sql('segment_id', 'step', repr(c), repr('2'), repr('42'))})")
add("ml5_noisy_copies", lambda s, d: rounded(learning.augment(fixtures.segment_points(s, d), "noise", KEYS).select("segment_id", "seq", *_NOISE), 3),
    "select segment_id, seq, " + ", ".join(f"round({c} + 0.05::double*{_NORMAL(c)},3) as {c}" for c in _NOISE) + " from seg", "seg")
add("ml5_warped_copies", lambda s, d: rounded(learning.augment(fixtures.segment_points(s, d), "time_warp", KEYS).select("segment_id", "seq", *_MOTION), 3),
    f""", num as (select *, row_number() over {_W} - 1 as i, count(*) over (partition by segment_id) as n from seg),
    m as (select *, greatest(cast(floor(n*(0.8::double + 0.4::double*{_unit_sql('segment_id', repr('warp'), repr('42'))})) as bigint), 10) as m from num),
    q as (select segment_id, seq, i, n, m, coalesce(i*(m-1.0::double)/nullif(n-1.0::double,0),0.0) as spot from m),
    p as (select segment_id, seq, floor(spot) as k, 1-(spot-floor(spot)) as share, n, m from q union all select segment_id, seq, least(floor(spot)+1, m-1), spot-floor(spot), n, m from q),
    o as (select *, k*(n-1.0::double)/(m-1.0::double) as place from p)
    select o.segment_id, o.seq, {', '.join(f"round(sum(share*(a.{c} + (place-floor(place))*(coalesce(b.{c},a.{c})-a.{c}))),3) as {c}" for c in _MOTION)}
    from o join num a on a.segment_id = o.segment_id and a.i = floor(place) left join num b on b.segment_id = o.segment_id and b.i = floor(place)+1 group by o.segment_id, o.seq""", "seg")
add("ml5_flipped_copies", lambda s, d: learning.augment(fixtures.segment_points(s, d).select("segment_id", "seq", "step"), "flip", KEYS), "select segment_id, seq, max(step) over (partition by segment_id) + min(step) over (partition by segment_id) - step as step from seg", "seg")
add("ml6_oversample", lambda s, d: learning.oversample(fixtures.predictions(s, d), "segment_id", "pred_label", 0.5).groupBy("pred_label").agg(F.count(F.lit(1)).alias("copies")),
    "select pred_label, cast(floor(top*0.5) as bigint)-n as copies from (select pred_label, count(*) as n, max(count(*)) over () as top from pred group by 1) where floor(top*0.5) > n", "pred")


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows of a forest trained on the statistics of the training segments."""
    rows = learning.split(fixtures.segment_stats(spark, sf_dir).where(F.col("label").isin(*schemas.MODES)), "segment_id")
    model = learning.train_classifier(rows.where("split = 'train'"))
    return model.transform(rows.where("split = 'test'")).select("segment_id", F.col("label").alias("true_label"), "pred_label")


add("ml12_ml14_trained", trained)


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table, for what is read often and costs more than reading."""
    path = f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _labelled_stats(points: DataFrame) -> DataFrame:
    """Label, 18 statistics and split of each segment of a known mode."""
    stats = segments.statistics(points, ["segment_id", "label"]).where(F.col("label").isin(*schemas.MODES))
    return learning.split(stats.select("segment_id", "label", F.array(*schemas.STATS).alias("features")), "segment_id")


def _labelled_series(points: DataFrame) -> DataFrame:
    """50 slots of the nine point features of each segment."""
    columns = list(schemas.POINT_FEATURES)
    slots = resample.resample(points, KEYS, columns)
    return slots.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("slot", F.array(*columns).alias("v")))).alias("s")).select("segment_id", F.col("s.v").alias("series"))


def _weights_of(rows: DataFrame) -> dict[str, float]:
    return {x.label: x.weight for x in learning.class_weights(rows.where("split = 'train'"), "sqrt_inverse").collect()}


def _predicted(spark: SparkSession, ready: DataFrame, name: str, settings: models.Settings) -> DataFrame:
    """Held-out rows with the guesses of a model trained on the others, stored and read back. ready: segment_id, label, split, features; read often."""
    part = lambda p: ready.where(F.col("split") == p)
    store = f"{working_folder(spark)}/models-{uuid.uuid4().hex}"
    models.fit(part("train"), part("valid"), "segment_id", store, name, settings, class_weights=_weights_of(ready))
    guesses = models.restore(spark, store, name).predict(part("test"), "segment_id")
    return guesses.join(part("test").select("segment_id", F.col("label").alias("true_label")), "segment_id").select("segment_id", "true_label", "pred_label", r("confidence").alias("confidence"))


def softmax_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics alone, by the smoothed focal loss."""
    rows = _written(spark, _labelled_stats(fixtures.segment_points(spark, sf_dir)), "statistics")
    return _predicted(spark, rows, "statistics", models.Settings(epochs=12, patience=4, loss="focal"))


def sequence_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series and statistics: the recurrent layers keep the weights drawn from their seed, the layer behind them is trained."""
    seen = _written(spark, fixtures.segment_points(spark, sf_dir), "points")
    rows = _written(spark, _labelled_stats(seen).join(_labelled_series(seen), "segment_id"), "inputs")
    width = len(schemas.POINT_FEATURES)
    # Standardised by the training rows, feature by feature.
    points = rows.where("split = 'train'").select(F.explode("series").alias("v")).select(*(F.get("v", F.lit(k)).alias(f"c{k}") for k in range(width)))
    by = {x.column: x for x in learning.scaling(points, [f"c{k}" for k in range(width)]).collect()}
    number = lambda f: F.array(*(F.lit(float(getattr(by[f"c{k}"], f) or 0.0)) for k in range(width)))
    scaled = F.transform("series", lambda row: F.zip_with(F.zip_with(row, number("mean"), lambda v, m: F.coalesce(v, m) - m), number("divisor"), lambda v, d: v / d))
    weights = models.sequence_weights([width], len(schemas.STATS), len(schemas.MODES), 16, 32, 1)
    features = models.apply_sequence(rows.select("segment_id", scaled.alias("series"), "features"), "segment_id", ["series"], weights, "features", features=True)
    # The recurrent layers are the costly part: each series goes through them once.
    ready = _written(spark, rows.select("segment_id", "label", "split").join(features, "segment_id"), "represented")
    return _predicted(spark, ready, "sequence", models.Settings(epochs=12, patience=4))


add("ml12_softmax_trained", softmax_trained)
add("ml8_ml14_sequence_trained", sequence_trained)


def four_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode and confidence of four rule classifiers for each segment: by speed, with rails, with rain (nobody cycles on a wet day), with both."""
    sums = fixtures.segment_points(spark, sf_dir).groupBy("segment_id").agg(
        F.avg("speed").alias("a"), F.max("speed").alias("m"), F.avg((F.col("speed") < 0.5).cast("double")).alias("q"), F.to_date(F.min("ts")).alias("date"))
    days = weather.nearest_day(sums.select("date").distinct(), weather.with_flags(weather.fill_defaults(fixtures.weather(spark, sf_dir)))).select("date", F.coalesce(F.col("is_rainy") > 0, F.lit(False)).alias("wet"))
    numbers = [F.col("a"), F.col("m"), F.col("q")]

    def model(name: str, rails: bool, rain: bool) -> Column:
        mode = learning.rule_mode(*numbers, rails)
        return F.struct(F.lit(name).alias("model"), (F.when(F.col("wet") & (mode == "bike"), "bus").otherwise(mode) if rain else mode).alias("mode"), learning.rule_confidence(*numbers, rails).alias("confidence"))

    each = F.array(*(model(f"exp{k}", k % 2 == 0, k > 2) for k in range(1, 5)))
    return sums.join(days, "date").select("segment_id", F.explode(each).alias("x")).select("segment_id", "x.*")


def _four_sql() -> str:
    sides = []
    for k in range(1, 5):
        rails, mode = k % 2 == 0, _RULE("subway" if k % 2 == 0 else "car")
        sure = f"case when max_speed > 45 then 0.92 when avg_speed > 16 then {0.91 if rails else 0.81} when avg_speed > 7 then case when stop_ratio > 0.15 then 0.82 else 0.84 end when avg_speed > 3.5 then 0.86 else 0.94 end"
        sides.append(f"select segment_id, 'exp{k}' as model, {f'case when wet and {mode} = {chr(39)}bike{chr(39)} then {chr(39)}bus{chr(39)} else {mode} end' if k > 2 else mode} as mode, cast({sure} as double) as confidence from f")
    return """, f as (select s.*, coalesce(w.is_rainy > 0, false) as wet from (select segment_id, avg(speed) as avg_speed, max(speed) as max_speed, avg(case when speed < 0.5 then 1.0 else 0.0 end) as stop_ratio, cast(min(ts) as date) as date from seg group by 1) s
      join wxn w on s.date = w.date) """ + " union all ".join(sides)


add("dsh27_four_models", four_models, _four_sql(), "seg", "wxn")


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each experiment with its status: one without a report is not trained yet."""
    planned = spark.createDataFrame([(f"exp{k}",) for k in range(1, 5)], "experiment string")
    done = reports(spark, sf_dir).select("experiment").distinct().withColumn("status", F.lit("completed"))
    return planned.join(done, "experiment", "left").na.fill("not_trained", ["status"])


add("dsh28_completed", lambda s, d: dashboards.with_status(experiments(s, d), "completed"), "select * from (values ('exp1', 'completed'), ('exp2', 'completed')) e(experiment, status)")
add("dsh28_not_trained", lambda s, d: dashboards.with_status(experiments(s, d), "not_trained"), "select * from (values ('exp3', 'not_trained'), ('exp4', 'not_trained')) e(experiment, status)")


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all segments by mean and deviation of those that the split trains on."""
    rows = learning.split(fixtures.segment_stats(spark, sf_dir), "segment_id")
    return rounded(learning.standardise(rows.select("segment_id", "speed_mean", "accel_mean"), rows.where("split = 'train'"), ["speed_mean", "accel_mean"]), 3)


add("ml14_normalised", normalised, """, t as (select *, cast(('0x' || md5(label || '|' || segment_id || '|42')[1:8])::bigint as double)/4294967296.0 < 0.7 as train from stats),
  n as (select avg(speed_mean) as m1, stddev_pop(speed_mean) as s1, avg(accel_mean) as m2, stddev_pop(accel_mean) as s2 from t where train)
  select segment_id, round((speed_mean-m1)/case when s1 < 1e-6 then 1.0 else s1 end,3) as speed_mean, round((accel_mean-m2)/case when s2 < 1e-6 then 1.0 else s2 end,3) as accel_mean from t, n""", "stats")
