"""Implausible readings: small series with known cases, and the cases that must not be flagged."""

import datetime as dt

import numpy as np
import pytest

from millrace.operators import implausible
from millrace.operators.implausible import excursions, implausible_readings, stuck_runs

SCHEMA = "reading_id long, equipment_tag string, parameter string, value double, unit string, measured_at timestamp, received_at timestamp, confidence double"
T0 = dt.datetime(2024, 4, 1)


def series(n, level=50.0, noise=0.5, seed=1):
    return level + noise * np.random.default_rng(seed).standard_normal(n)


def frame(spark, values, tag="P-1", parameter="flow_m3_h", unit="m3/h", start=1):
    rows = [(start + k, tag, parameter, float(v) if v is not None else None, unit, T0 + dt.timedelta(hours=k), T0, None) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df, **options):
    return {r.reading_id: r.kind for r in implausible_readings(df, **options).collect()}


def test_spikes_of_one_to_three_readings(spark):
    v = series(300)
    v[[40, 100, 101, 200, 201, 202]] += 15
    assert set(found(frame(spark, v))) == {41, 101, 102, 201, 202, 203}


def test_level_shift_trend_and_swing_are_no_cases():
    n = np.arange(400)
    shift = series(400)
    shift[200:] += 20
    assert not excursions(shift).any()
    assert not excursions(series(400) + 0.2 * n).any()
    assert not excursions(series(400) + 4 * np.sin(2 * np.pi * n / 24)).any()


def test_restless_and_coarse_sources_are_judged_by_their_own_tails():
    rng = np.random.default_rng(3)
    restless = 50 + np.where(rng.random(600) < 0.08, rng.uniform(-8, 8, 600), rng.standard_normal(600))
    assert not excursions(restless).any()
    coarse = np.where(rng.random(600) < 0.3, 40.0, 45.0)
    assert not excursions(coarse).any() and not stuck_runs(coarse).any()
    coarse[300] = 90
    assert np.flatnonzero(excursions(coarse)).tolist() == [300]


@pytest.mark.parametrize(("n", "spikes"), [(22, 1), (50, 2), (262, 9), (400, 40)])
def test_many_spikes_do_not_hide_each_other(n, spikes):
    v = series(n)
    at = np.linspace(5, n - 6, spikes).astype(int)
    v[at] += 20
    assert np.flatnonzero(excursions(v)).tolist() == at.tolist()


def test_rounds_go_on_until_nothing_changes():
    rng = np.random.default_rng(1777)
    n = int(rng.integers(60, 300))
    v = rng.standard_normal(n) * np.where(rng.random(n) < 0.05, 10 ** rng.uniform(0.5, 1.5, n), 1)
    assert excursions(v).sum() == 8  # four of them are uncovered after the fourth round only


def test_stuck_runs_need_eight_and_may_jitter():
    v = series(200)
    v[50:58] = v[50]
    v[100:107] = v[100]
    v[150:170] = v[150] + 1e-5 * np.random.default_rng(2).standard_normal(20)
    assert np.flatnonzero(stuck_runs(v)).tolist() == [*range(50, 58), *range(150, 170)]


def test_limits_units_and_repeats(spark):
    t = series(60, 100.0, 1.0)
    df = frame(spark, t, parameter="temperature_c", unit="degC")
    other = frame(spark, [212.0, -400.0], parameter="temperature_c", unit="degF", start=100)
    assert set(found(df.unionByName(other).unionByName(other))) == {101}
    assert found(frame(spark, [-0.5, 101.0, 50.0], parameter="level_pct")) == {1: "impossible", 2: "impossible"}


def test_nulls_empty_ties_and_clashing_columns(spark):
    v = [None if k % 7 == 0 else x for k, x in enumerate(series(80))]
    df = frame(spark, v)
    nulls = spark.createDataFrame([(900, None, "flow_m3_h", 1e9, None, T0, None, None), (901, "P-1", None, 1e9, None, T0, None, None), (902, "P-1", "flow_m3_h", 1e9, None, None, None, None), (903, " ", "flow_m3_h", -1.0, None, T0, None, None)], SCHEMA)
    clash = df.unionByName(nulls).selectExpr("*", "1 AS tag", "2 AS chunk", "3 AS n", "4 AS bad", "5 AS core")
    assert found(clash) == {}
    assert found(df.limit(0)) == {}
    same_time = df.selectExpr("reading_id", "equipment_tag", "parameter", "value", "unit", "timestamp'2024-04-01' AS measured_at")
    assert found(same_time) == {}


def test_spellings_of_a_tag_are_one_source(spark):
    v = series(100)
    v[50] += 30
    df = frame(spark, v).selectExpr("reading_id", "CASE WHEN reading_id % 2 = 0 THEN ' p-1' ELSE equipment_tag END AS equipment_tag", "parameter", "value", "unit", "measured_at")
    assert set(found(df)) == {51}


def test_a_burst_is_cut_by_number(spark):
    v = series(2000, seed=4)
    v[[300, 1500]] += 20
    # Nine readings in ten come within a day and a half, a minute apart; the rest once in six hours.
    at = [T0 + (dt.timedelta(minutes=k) if k < 1800 else dt.timedelta(hours=6 * (k - 1790))) for k in range(2000)]
    rows = [(k, "P-1", "flow_m3_h", float(x), "m3/h", t, T0, None) for k, (x, t) in enumerate(zip(v, at))]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = implausible._chunked(df.selectExpr("equipment_tag AS tag", "parameter", "reading_id", "unix_micros(measured_at) AS at", "value", "false AS bad"), 200).where("core").groupBy("chunk").count().collect()
    assert sum(r["count"] for r in sizes) == 2000 and max(r["count"] for r in sizes) <= 210
    assert found(df, rows_a_chunk=200) == found(df) == {300: "excursion", 1500: "excursion"}


@pytest.mark.parametrize("rows_a_chunk", [100, 333])
def test_chunks_give_what_the_whole_source_gives(spark, rows_a_chunk):
    v = series(3000, seed=9)
    v[[100, 999, 1000, 1001, 2000]] += 20
    v[1490:1510] = v[1490]
    df = frame(spark, v)
    assert found(df, rows_a_chunk=rows_a_chunk) == found(df)
    assert len(found(df)) == 25
