"""Significance against tabulated values; throttle timing, scores and verdicts against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.functions.statistics import incomplete_beta, log_gamma, t_p_value
from lapforge.operators import metric_validation as MV


def t_series(t, v):
    """Two-sided p-value for whole degrees of freedom by the finite series."""
    th = np.arctan(abs(t) / np.sqrt(v))
    total, term = 0.0, 1.0
    if v % 2 == 0:
        for j in range(v // 2):
            total += term
            term *= (2 * j + 1) / (2 * j + 2) * np.cos(th) ** 2
        return 1 - np.sin(th) * total
    for j in range((v - 1) // 2):
        total += term
        term *= (2 * j + 2) / (2 * j + 3) * np.cos(th) ** 2
    return 1 - 2 / np.pi * (th + np.sin(th) * np.cos(th) * total)


def test_t_p_value(spark):
    # critical values of the printed tables, and the series
    cases = [(12.7062047362, 1, 0.05), (4.3026527297, 2, 0.05), (2.2281388520, 10, 0.05), (3.1692726726, 10, 0.01), (1.9839715185, 100, 0.05), (2.0, 5, t_series(2.0, 5))]
    cases += [(float(t), v, t_series(t, v)) for t in (-3.0, 0.0, 0.3, 1.0, 2.5, 8.0) for v in (1, 2, 3, 8, 23, 51, 400, 5000)]
    table = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(cases)], "i int, t double, v int")
    got = {r["i"]: r["p"] for r in table.select("i", t_p_value(F.col("t"), F.col("v")).alias("p")).collect()}
    for i, (_, v, want) in enumerate(cases):
        assert got[i] == pytest.approx(want, abs=1e-9 if v < 5000 else 1e-8)
    assert spark.range(1).select(t_p_value(F.lit(1.0), F.lit(0)).alias("p")).first()["p"] is None


def test_beta_and_gamma(spark):
    row = spark.range(1).select(
        log_gamma(F.lit(0.5)).alias("half"), log_gamma(F.lit(11.0)).alias("ten"), incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(0.4)).alias("b"), incomplete_beta(F.lit(1.0), F.lit(1.0), F.lit(0.3)).alias("u"),
        incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(0.0)).alias("zero"), incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(1.0)).alias("one"),
    ).first()
    assert row["half"] == pytest.approx(np.log(np.sqrt(np.pi)), abs=1e-12) and row["ten"] == pytest.approx(np.log(3628800.0), abs=1e-11)
    assert row["b"] == pytest.approx(0.5248, abs=1e-12) and row["u"] == pytest.approx(0.3, abs=1e-12) and (row["zero"], row["one"]) == (0.0, 1.0)


def timing_by_hand(rows, apart, least_rows=100):
    """rows: (ts_us, speed, throttle) of one vehicle."""
    rows = sorted(rows)
    if len(rows) < least_rows:
        return None
    speed = [r[1] for r in rows]
    soft = [np.mean(speed[i - 2 : i + 3]) if 2 <= i < len(rows) - 2 else speed[i] for i in range(len(rows))]
    span = max(soft) - min(soft)
    if span < 10:
        return []
    lows = [i for i in range(1, len(rows) - 1) if soft[i] < soft[i - 1] and soft[i] < soft[i + 1] and -soft[i] >= -max(soft) + 0.3 * span]
    kept = []
    for i in sorted(lows, key=lambda i: soft[i]):
        if all(abs(i - j) >= apart for j in kept):
            kept.append(i)
    waits = []
    for i in kept:
        hit = next((j for j in range(i, min(i + 200, len(rows))) if rows[j][2] >= 95), None)
        if hit is not None and 0 < (rows[hit][0] - rows[i][0]) / 1e6 < 10:
            waits.append((rows[hit][0] - rows[i][0]) / 1e6)
    return waits


def test_throttle_timing_brute(spark):
    rng = np.random.default_rng(4)
    cars = {}
    for car in range(5):
        n = 60 if car == 3 else 700
        speed = 100 + (3 if car == 4 else 40) * np.sin(np.arange(n) / 23 + car) + rng.normal(0, 0.5, n)
        cars[car] = [(int(i * 40_000), float(s), float(rng.choice([20, 60, 96, 100], p=[0.4, 0.4, 0.1, 0.1]))) for i, s in enumerate(speed)]
    rows = [(0, car, i, *r) for car, some in cars.items() for i, r in enumerate(some)] + [(0, 9, 0, 0, None, None)]
    t = spark.createDataFrame(rows, "race bigint, vehicle_number bigint, n bigint, ts_us bigint, speed double, throttle double")
    got = {r["vehicle_number"]: r for r in MV.throttle_timing(t).collect()}
    assert len(got) == 6
    for car, some in cars.items():
        want = timing_by_hand(some, 50)
        assert got[car]["full_throttle_pct"] == pytest.approx(100 * np.mean([r[2] >= 95 for r in some]))
        assert got[car]["n_corners"] == (None if want is None else len(want))
        if want:
            assert got[car]["mean_time_to_full"] == pytest.approx(np.mean(want)) and got[car]["median_time_to_full"] == pytest.approx(np.median(want))
    assert got[9]["full_throttle_pct"] is None


def test_direction_check(spark):
    scores = spark.createDataFrame([(0, 1, 1.0, 2.0, None, 4.0, 9.0), (0, 2, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 3, 2.0, 3.0, 1.0, 5.0, 8.0), (1, 1, 1.0, 1.0, 1.0, 1.0, 1.0), (1, 2, 1.0, 1.0, 2.0, 2.0, 0.0)], ["race", "vehicle_number", *MV.DIRECTIONS])
    places = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 1), (1, 2, 2)], "race bigint, vehicle_number bigint, final_position int")
    got = {r["race"]: (r["wins"], r["n_metrics"], r["verdict"]) for r in MV.direction_check(scores, places).collect()}
    assert got == {0: (4, 4, "SUCCESS"), 1: (3, 5, "PARTIAL")}


def test_correlations_survive_constants(spark):
    rows = [(0, car, float(lap + car), float(car), 1.0, float(lap), float(-lap), 0.5) for car in range(6) for lap in range(6)]
    t = spark.createDataFrame(rows, ["race", "vehicle_number", "lap_time", *MV.SIGNS])
    got = {r["metric"]: r for r in MV.correlation_tests(t).collect()}
    assert got["coasting_pct"]["mean_r"] is None and got["coasting_pct"]["rho"] == pytest.approx(1) and got["coasting_pct"]["p_value"] == 0.0
    assert got["brake_cv"]["rho"] is None and got["brake_cv"]["p_value"] is None
    assert got["mean_combined_g"]["mean_r"] == pytest.approx(1) and got["mean_combined_g"]["sign_ok"] is False
    assert got["lift_off_count"]["mean_r"] == pytest.approx(-1) and got["full_throttle_pct"]["mean_r"] is None
    assert MV.generalisation(MV.correlation_tests(t)).first()["verdict"] == "FAIL"
