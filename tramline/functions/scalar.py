"""Column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline import schemas

EARTH_RADIUS = 6371000.0
#: Metres of one degree in the planar distance of spatial look-ups.
DEGREE = 111300.0


def mapped(key: Column, values: Mapping[str, object], otherwise: Column | None = None) -> Column:
    """A constant map as CASE; stays inside generated code."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if otherwise is None else out.otherwise(otherwise)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere; null where a coordinate is null."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, degrees in [0, 360)."""
    p1, p2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def turned(a: Column, b: Column) -> Column:
    """The smaller angle between two bearings."""
    d = F.abs(a - b)
    return F.when(d > 180, 360 - d).otherwise(d)


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres in degrees times DEGREE, without shrinking by latitude."""
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)) * DEGREE


def normal_mode(raw: Column) -> Column:
    """Canonical travel mode of a raw label; unknown ones are capitalised."""
    key = F.lower(F.trim(raw))
    return mapped(key, schemas.RAW_MODES, F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 1 << 30)))


def api_mode(label: Column) -> Column:
    return mapped(label, schemas.API_MODES, F.lower(label))


def time_bucket(ts: Column) -> Column:
    """Part of the day: rush hours, noon, night; the hours between are other."""
    h = F.hour(ts)
    return (
        F.when(h.between(7, 9), "morning").when(h.between(11, 13), "noon").when(h.between(17, 19), "evening")
        .when((h >= 22) | (h <= 5), "night").otherwise("other")
    )


def green(label: Column, transit: bool = False) -> Column:
    return label.isin(*(schemas.GREEN_TRANSIT if transit else schemas.GREEN_STRICT))


def carbon_kg(label: Column, km: Column) -> Column:
    """Saved by a green trip, by kilometres."""
    return F.round(mapped(label, schemas.CARBON_FACTORS, F.lit(0.0)) * km, 6)


def stable_id(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(1_000_000))
