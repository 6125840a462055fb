"""Registered queries against their SQL, on the smallest tables."""

import datetime as dt
import decimal
import importlib.util
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tramline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or more of each family; the driver runs all of them.
CHOSEN = [
    "entry_user_modes", "prj2_label", "prj5_segment_id", "flt2_long_tracks", "flt5_finite_segments", "win4_speed", "win7_bearing_change", "win10_trip_summary", "seg1_label_join", "seg3_length_summary",
    "agg12_linearity", "agg16_speed_entropy", "agg18_max_sustained_speed", "cln1_outliers", "cln6_smooth_5", "cln8_verdicts", "res1_res2_resample", "res4_times", "geo8_nearest_road", "geo13_spatial_vector",
    "geo20_green_grid", "geo21_intensity", "wx3_nearest_day", "wx7_interpolate", "dsh1_mode_by_bucket", "dsh3_car_share_by_hour", "dsh25_five_numbers", "ml2_split", "ml4_weights_inverse", "ml15_report",
    "cln2_repair", "cln7_bearing", "res5_fit_length", "res6_two_stage", "res7_model_input", "res8_reconcile", "geo19_nearest_line", "geo19_line_within_300m", "ml5_scaled_copies", "ml5_noisy_copies", "ml5_warped_copies",
    "dsh27_four_models", "dsh28_completed", "dsh28_not_trained", "ml14_normalised",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_sql(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.HAS_LLM == (importlib.util.find_spec("tramline.llm") is not None)


def test_two_stage_gives_fifty_point_statistics(spark, sf_dir):
    rows = plans.QUERIES["res6_two_stage"](spark, sf_dir).collect()
    assert rows and all(r.n_points == 50 for r in rows)


def test_trained_forest_has_the_operators_defaults(spark, sf_dir, monkeypatch):
    from tramline.operators import learning

    made, train = [], learning.train_classifier
    monkeypatch.setattr(learning, "train_classifier", lambda *a, **k: made.append((k, train(*a, **k))) or made[-1][1])
    assert plans.QUERIES["ml12_ml14_trained"](spark, sf_dir).count() > 0
    assert made[0][0] == {}
