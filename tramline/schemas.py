"""Schemas and fixed values of the mobility engine."""

from __future__ import annotations

from dataclasses import dataclass

POINTS = "track_id string, seq long, ts timestamp, lat double, lon double"
WEATHER = "date date, temp double, tmin double, tmax double, prcp double, wspd double"
PREDICTIONS = "segment_id string, true_label string, pred_label string, confidence double"

# Label names, limits by travel mode, presets, tags. They must equal what users' data holds.
RAW_MODES = {
    "taxi": "Car & taxi", "car": "Car & taxi", "drive": "Car & taxi", "bus": "Bus", "walk": "Walk", "bike": "Bike",
    "train": "Train", "subway": "Subway", "railway": "Train", "airplane": "Airplane",
}
MODES = ("Bike", "Bus", "Car & taxi", "Subway", "Train", "Walk")
API_MODES = {"Walk": "walk", "Bike": "bike", "Bus": "bus", "Car & taxi": "car", "Subway": "subway", "Train": "train"}
SPEED_LIMITS = {"Walk": 2.5, "Bike": 8.0, "Bus": 22.0, "Car & taxi": 35.0, "Train": 45.0, "Subway": 30.0, "Airplane": 150.0}
ACCEL_LIMITS = {"Walk": 2.0, "Bike": 3.0, "Bus": 4.0, "Car & taxi": 5.0, "Train": 2.0, "Subway": 3.0, "Airplane": 8.0}
OTHER_SPEED_LIMIT, OTHER_ACCEL_LIMIT = 50.0, 10.0
ROAD_CLASSES = {
    "footway": "walk", "cycleway": "bike", "primary": "car", "secondary": "car", "tertiary": "car", "residential": "car",
    "bus_stop": "bus", "station": "train", "subway_entrance": "subway", "rail": "train", "subway": "subway", "parking": "car", "taxi": "car",
}
ROAD_CLASS_ORDER = ("walk", "bike", "car", "bus", "train", "subway", "unknown")
VALID_ROADS = ("primary", "secondary", "tertiary", "residential", "footway", "cycleway", "bus_stop", "station")
GREEN_STRICT, GREEN_TRANSIT = ("Walk", "Bike"), ("Walk", "Bike", "Bus", "Subway")
CARBON_FACTORS = {"Walk": 0.15, "Bike": 0.10, "Bus": 0.05, "Subway": 0.05}
WEATHER_DEFAULTS = {"temp": 13.5, "tmin": 8.0, "tmax": 19.0, "prcp": 0.0, "wspd": 10.0}
POINT_FEATURES = ("lat", "lon", "speed", "acceleration", "bearing_change", "distance", "time_diff", "total_distance", "total_time")
STATS = (
    "speed_mean", "speed_std", "speed_max", "speed_cv", "accel_mean", "accel_std", "accel_max", "bearing_mean", "bearing_std",
    "stop_ratio", "high_speed_ratio", "linearity", "total_distance", "total_time", "avg_segment_speed", "speed_entropy",
    "accel_sign_changes", "max_sustained_speed",
)
SEGMENT_LENGTH = 50


@dataclass(frozen=True)
class Preset:
    """How a segment is cleaned."""

    max_time_gap: float
    max_bearing_change: float
    min_length: int
    max_outlier_ratio: float
    window: int | None


PRESETS = {
    "strict": Preset(180.0, 120.0, 15, 0.15, 7),
    "balanced": Preset(300.0, 150.0, 10, 0.25, 5),
    "gentle": Preset(600.0, 180.0, 8, 0.35, None),
}


def preset(name: str) -> Preset:
    """An unknown name means balanced."""
    return PRESETS.get(name, PRESETS["balanced"])
