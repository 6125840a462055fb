"""DuckDB SQL for the derived tables, as common table expressions that build on each other."""

from __future__ import annotations

from tramline import schemas


def _case(column: str, values: dict[str, object], otherwise: str) -> str:
    text = " ".join(f"when {column} = '{k}' then {v if not isinstance(v, str) else chr(39) + v + chr(39)}" for k, v in values.items())
    return f"case {text} else {otherwise} end"


_HAV = "2*6371000.0*asin(sqrt(least(1.0, sin(radians({b}lat-{a}lat)/2)*sin(radians({b}lat-{a}lat)/2) + cos(radians({a}lat))*cos(radians({b}lat))*sin(radians({b}lon-{a}lon)/2)*sin(radians({b}lon-{a}lon)/2))))"
_EPS = "1e-8"
MODE_SQL = _case("lower(trim(raw_mode))", schemas.RAW_MODES, "upper(substr(lower(trim(raw_mode)),1,1)) || substr(lower(trim(raw_mode)),2)")
ROAD_SQL = _case("road_type", schemas.ROAD_CLASSES, "'unknown'")
RULE_SQL = "case when max_speed > 45 then 'Train' when avg_speed > 16 then 'Subway' when avg_speed > 7 then case when stop_ratio > 0.15 then 'Bus' else 'Car & taxi' end when avg_speed > 3.5 then 'Bike' else 'Walk' end"
OUTLIER_SQL = (
    f"(speed < 0 or speed > ({_case('label', schemas.SPEED_LIMITS, '50.0')})*1.2 or abs(acceleration) > ({_case('label', schemas.ACCEL_LIMITS, '10.0')})*1.5)"
)

#: Name -> (what it builds on, its query).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "pts": ((), """
      select user_id, cast(user_id as varchar) as track_id, event_id as seq, t, make_timestamp(t*1000000) as ts, cast(lat6 as double)/1000000 as lat, cast(lon6 as double)/1000000 as lon from (
        select event_id, user_id,
          cast(1704067200 + (user_id % 60)*86400 + ((user_id*7) % 24)*3600 + sum(case when event_id % 997 = 0 then 1 else 30 + event_id % 61 end) over w as bigint) as t,
          39900000 + sum((((event_id*7919) % 2001)-1000)*(1+user_id % 40)) over w as lat6, 116400000 + sum((((event_id*104729) % 2001)-1000)*(1+user_id % 40)) over w as lon6
        from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row))"""),
    "kin1": (("pts",), f"""
      select a.*, row_number() over w as step, coalesce(cast(t - lag(t) over w as double), 0.0) as time_diff, lag(lat) over w as plat, lag(lon) over w as plon
      from pts a window w as (partition by track_id order by ts, seq)"""),
    "kin2": (("kin1",), f"""
      select *, case when plat is null then 0.0 else {_HAV.replace('{a}lat', 'plat').replace('{a}lon', 'plon').replace('{b}', '')} end as distance,
        case when plat is null then 0.0 else (degrees(atan2(sin(radians(lon-plon))*cos(radians(lat)), cos(radians(plat))*sin(radians(lat)) - sin(radians(plat))*cos(radians(lat))*cos(radians(lon-plon)))) + 360.0) % 360.0 end as bearing,
        case when time_diff = 0 then 1e-6 else time_diff end as span from kin1"""),
    "kin3": (("kin2",), "select *, distance/span as speed from kin2"),
    "kin": (("kin3",), """
      select *, coalesce((speed - lag(speed) over w)/span, 0.0) as acceleration,
        coalesce(case when abs(bearing - lag(bearing) over w) > 180 then 360 - abs(bearing - lag(bearing) over w) else abs(bearing - lag(bearing) over w) end, 0.0) as bearing_change,
        sum(distance) over (partition by track_id order by ts, seq rows between unbounded preceding and current row) as total_distance,
        sum(time_diff) over (partition by track_id order by ts, seq rows between unbounded preceding and current row) as total_time
      from kin3 window w as (partition by track_id order by ts, seq)"""),
    "mlab": (("pts",), """
      select user_id, t0 as start_t, t0 + 1199 as end_t, case m when 0 then 'walk' when 1 then 'bike' when 2 then 'bus' when 3 then 'taxi' when 4 then 'subway' when 5 then 'railway' when 6 then 'airplane' else 'boat' end as raw_mode from (
        select user_id, k, min(t) as t0, (user_id*3 + k) % 8 as m from (select user_id, t, cast(floor((t - 1704067200)/1800.0) as bigint) as k from pts) group by user_id, k)"""),
    "segall": (("kin", "mlab"), f"""
      select k.*, l.start_t, {MODE_SQL} as label, k.user_id || '_' || k.track_id || '_' || strftime(make_timestamp(start_t*1000000), '%Y%m%d%H%M%S') || '_' || strftime(make_timestamp(end_t*1000000), '%Y%m%d%H%M%S') as segment_id
      from kin k join mlab l on k.user_id = l.user_id and k.t between l.start_t and l.end_t"""),
    "seg": (("segall",), "select * from (select *, count(*) over (partition by segment_id) as length from segall) where length >= 10"),
    "segb1": (("seg",), """
      select *, greatest(speed, 0.0) as v, abs(acceleration) as a, row_number() over (partition by segment_id order by step) as r,
        max(greatest(speed, 0.0)) over (partition by segment_id) as top,
        case when sign(acceleration) <> lag(sign(acceleration)) over (partition by segment_id order by step) then 1 else 0 end as flip from seg"""),
    "segb2": (("segb1",), "select *, r - row_number() over (partition by segment_id, v > 10 order by step) as island, least(cast(floor(v/(top+1e-8)*10) as int), 9) as bin from segb1"),
    "segrun": (("segb2",), "select segment_id, max(n) as fast from (select segment_id, count(*) as n from segb2 where v > 10 group by segment_id, island) group by segment_id"),
    "segent": (("segb2",), """
      select segment_id, sum(-(n/(total+1e-8))*ln(n/(total+1e-8)+1e-8)) as entropy from (
        select segment_id, bin, cast(count(*) as double) as n, sum(count(*)) over (partition by segment_id) as total from segb2 group by segment_id, bin) group by segment_id"""),
    "stats": (("segb2", "segrun", "segent"), """
      select s.segment_id, label, n_points, speed_mean, speed_std, speed_max, speed_std/(speed_mean+1e-8) as speed_cv, accel_mean, accel_std, accel_max, bearing_mean, bearing_std, stop_ratio, high_speed_ratio,
        case when total_distance <= 1e-8 then 0.0 else least(sqrt(pow((lat1-lat0)*111300.0,2)+pow((lon1-lon0)*111300.0*cos(radians(lat0)),2))/(total_distance+1e-8),1.0) end as linearity,
        total_distance, total_time, total_distance/(total_time+1e-8) as avg_segment_speed, case when speed_max <= 1e-8 then 0.0 else entropy end as speed_entropy,
        cast(flips as double)/(n_points-1) as accel_sign_changes, coalesce(cast(fast as double),0.0)/n_points as max_sustained_speed
      from (select segment_id, label, count(*) as n_points, avg(v) as speed_mean, stddev_pop(v) as speed_std, max(v) as speed_max, avg(a) as accel_mean, stddev_pop(a) as accel_std, max(a) as accel_max,
          avg(bearing_change) as bearing_mean, stddev_pop(bearing_change) as bearing_std, avg(case when v < 0.5 then 1.0 else 0.0 end) as stop_ratio, avg(case when v > 15 then 1.0 else 0.0 end) as high_speed_ratio,
          arg_min(lat, r) as lat0, arg_min(lon, r) as lon0, arg_max(lat, r) as lat1, arg_max(lon, r) as lon1,
          case when arg_max(total_distance, r) > 0 then arg_max(total_distance, r) else sum(distance) end as total_distance,
          case when arg_max(total_time, r) > 0 then arg_max(total_time, r) else sum(time_diff) end as total_time, sum(flip) as flips
        from segb2 group by segment_id, label) s left join segrun r on s.segment_id = r.segment_id left join segent e on s.segment_id = e.segment_id"""),
    "rds": ((), """
      select p_partkey as node_id, 39.9 + cast((p_partkey*7919) % 4001 - 2000 as double)/(case when p_partkey % 2 = 0 then 100000 else 20000 end) as lat,
        116.4 + cast((p_partkey*104729) % 4001 - 2000 as double)/(case when p_partkey % 2 = 0 then 100000 else 20000 end) as lon,
        case p_size % 8 when 0 then 'footway' when 1 then 'cycleway' when 2 then 'primary' when 3 then 'secondary' when 4 then 'rail' when 5 then 'subway' when 6 then 'residential' else 'service' end as road_type from part"""),
    "poi": ((), """
      select s_suppkey as poi_id, 39.9 + cast((s_suppkey*7907) % 4001 - 2000 as double)/20000 as lat, 116.4 + cast((s_suppkey*10007) % 4001 - 2000 as double)/20000 as lon,
        case s_nationkey % 5 when 0 then 'bus_stop' when 1 then 'station' when 2 then 'parking' when 3 then 'taxi' else 'subway_entrance' end as poi_type from supplier"""),
    # All nodes and POIs of a point within 300 m: cells of that size, the eight around as well.
    "pcell": (("pts",), "select seq, lat, lon, cast(floor(lat/0.0027) as bigint)+dy as cy, cast(floor(lon/0.0027) as bigint)+dx as cx from pts, (values (-1),(0),(1)) a(dy), (values (-1),(0),(1)) b(dx)"),
    "proad": (("pcell", "rds"), "select * from (select p.seq, r.node_id, r.road_type, sqrt((p.lat-r.lat)*(p.lat-r.lat)+(p.lon-r.lon)*(p.lon-r.lon))*111300 as d from pcell p join rds r on p.cy = cast(floor(r.lat/0.0027) as bigint) and p.cx = cast(floor(r.lon/0.0027) as bigint)) where d <= 300"),
    "ppoi": (("pcell", "poi"), "select * from (select p.seq, r.poi_id, r.poi_type, sqrt((p.lat-r.lat)*(p.lat-r.lat)+(p.lon-r.lon)*(p.lon-r.lon))*111300 as d from pcell p join poi r on p.cy = cast(floor(r.lat/0.0027) as bigint) and p.cx = cast(floor(r.lon/0.0027) as bigint)) where d <= 300"),
    "near": (("proad",), f"select seq, node_id, {ROAD_SQL} as near_class, d from (select *, row_number() over (partition by seq order by d, node_id) as n from proad where d < 150) where n = 1"),
    "roadf": (("pts", "near", "ppoi"), """
      select p.seq, coalesce(n.near_class, 'unknown') as near_class, s.seq is not null as at_stop, case when n.near_class = 'car' and s.seq is not null then 'bus' else coalesce(n.near_class, 'unknown') end as road_class
      from pts p left join near n on p.seq = n.seq left join (select distinct seq from ppoi where poi_type = 'bus_stop' and d <= 50) s on p.seq = s.seq"""),
    "poif": (("pts", "ppoi"), """
      select p.seq, coalesce(max(cast(poi_type = 'bus_stop' as int)),0) as has_bus_stop, coalesce(max(cast(poi_type = 'station' as int)),0) as has_station, coalesce(max(cast(poi_type = 'parking' as int)),0) as has_parking,
        coalesce(min(d)/200.0, 0.0) as poi_distance from pts p left join ppoi q on p.seq = q.seq group by p.seq"""),
    "dens": (("pts", "proad"), "select p.seq, least(count(r.seq)/50.0, 1.0) as road_density from pts p left join (select seq from proad where d <= 100) r on p.seq = r.seq group by p.seq"),
    "wx": ((), """
      select date '2024-01-01' + cast(i as integer) as date, cast(k % 45 - 10 as double) as temp, case when (n+k) % 5 = 0 then cast(null as double) else cast(s % 24 as double)/2 end as prcp, cast(4 + k % 20 as double) as wspd
      from (select datediff('day', date '1995-01-01', cast(o_orderdate as date)) as i, count(*) as n, cast(sum(o_custkey) as bigint) as k, cast(sum(o_orderkey) as bigint) as s from orders group by 1) o where i not between 20 and 36 and i % 9 <> 4"""),
    "wxf": (("wx",), """
      select *, cast(prcp > 0.5 as int)::double as is_rainy, cast(prcp > 10 as int)::double as is_heavy_rain, cast(prcp > 0.5 and temp < 2 as int)::double as is_snowy, cast(temp < 0 as int)::double as is_cold, cast(temp > 30 as int)::double as is_hot
      from (select date, temp, 8.0::double as tmin, 19.0::double as tmax, coalesce(prcp, 0.0) as prcp, wspd from wx)"""),
    "pdays": (("pts",), "select distinct cast(ts as date) as date from pts"),
    "wxn": (("pdays", "wxf"), """
      select date, weather_date, temp, tmin, tmax, prcp, wspd, is_rainy, is_heavy_rain, is_snowy, is_cold, is_hot from (
        select p.date, w.date as weather_date, w.* exclude (date), row_number() over (partition by p.date order by abs(datediff('day', p.date, w.date)), w.date) as n
        from pdays p left join wxf w on abs(datediff('day', p.date, w.date)) <= 7) where n = 1"""),
    "pred": (("seg",), f"""
      select segment_id, user_id, start_t, length, label as true_label, {RULE_SQL} as pred_label, 0.5 + ((user_id*31 + start_t*17) % 500)/1000.0 as confidence
      from (select segment_id, user_id, start_t, label, any_value(length) as length, avg(speed) as avg_speed, max(speed) as max_speed, avg(case when speed < 0.5 then 1.0 else 0.0 end) as stop_ratio from seg group by segment_id, user_id, start_t, label)"""),
    "rep": (("pred",), """
      select label, coalesce(hits/nullif(cast(guesses as double),0),0.0) as precision, coalesce(hits/nullif(cast(support as double),0),0.0) as recall, coalesce(2.0*hits/nullif(guesses+support,0),0.0) as f1, support from (
        select l.label, (select count(*) from pred where true_label = l.label) as support, (select count(*) from pred where pred_label = l.label) as guesses, (select count(*) from pred where true_label = l.label and pred_label = l.label) as hits
        from (select true_label as label from pred union select pred_label from pred) l)"""),
}


def sql(query: str, *needs: str) -> str:
    """The query after the expressions that it needs, each once, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in CTES[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    return ("with " + ",\n".join(f"{n} as ({CTES[n][1]})" for n in order) + "\n" if order else "") + query
