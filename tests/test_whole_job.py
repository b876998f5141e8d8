"""Queries that once returned a part: each case fails on the cut form."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from lapforge.operators import counterfactual
from lapforge.plans import adapter, catalog, model_queries, quality_queries

DATA = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
X = ["degradation", "consistency", "traffic_laps"]


def least_squares(rows):
    """intercept and coefficients over rows of (degradation, consistency, traffic_laps, delta): centred, of least norm."""
    x, y = np.array([r[:3] for r in rows], dtype=float), np.array([r[3] for r in rows])
    slope = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-10)[0]
    return [y.mean() - slope @ x.mean(0), *slope]


def test_each_race_has_its_fit(spark):
    rng = np.random.default_rng(3)
    truth = {4: (0.5, 30.0, 0.4, 0.05), 9: (-1.0, 12.0, -0.7, 0.2)}
    rows = []
    for race, n in ((4, 12), (9, 25), (11, 9)):
        for v in range(n):
            x = (float(rng.normal(0, 0.02)), float(rng.normal(2, 0.5)), int(rng.integers(0, 20)))
            b = truth.get(race, (0, 0, 0, 0))
            rows.append((race, v, *x, float(b[0] + b[1] * x[0] + b[2] * x[1] + b[3] * x[2])))
    rows.append((4, 99, None, 1.0, 3, 500.0))  # no value, so no part of the fit
    f = spark.createDataFrame(rows, "race long, vehicle_number long, degradation double, consistency double, traffic_laps long, lap_time_delta double")
    got = {r["race"]: r for r in counterfactual.race_fits(f).collect()}
    assert {k: r["n"] for k, r in got.items()} == {4: 12, 9: 25}
    for race, want in truth.items():
        assert [got[race][c] for c in ("intercept", *X)] == pytest.approx(want, abs=1e-6)
        assert got[race]["r2"] == pytest.approx(1)


def test_a_column_without_spread_has_coefficient_0(spark):
    rows = [(1, v, 0.01 * v, float(v * v % 7), 5, 2.0 * v) for v in range(12)]
    f = spark.createDataFrame(rows, "race long, vehicle_number long, degradation double, consistency double, traffic_laps long, lap_time_delta double")
    r = counterfactual.race_fits(f).first()
    assert [r[c] for c in ("intercept", *X)] == pytest.approx([0, 200, 0, 0], abs=1e-6)


@tables
def test_interventions_use_the_fit_of_their_race(spark):
    rows = quality_queries.x_features(spark, DATA).collect()
    races = {r["race"] for r in rows}
    fits = {race: least_squares([[r[c] for c in X] + [r["lap_time_delta"]] for r in rows if r["race"] == race]) for race in races}
    got = {r["race"]: r for r in catalog.queries()["ols_normal_eq"](spark, DATA).collect()}
    assert set(got) == races and len(races) > 1
    for race, want in fits.items():
        assert [got[race][c] for c in ("intercept", *X)] == pytest.approx(want, rel=1e-5, abs=2e-5)
    want, total = {}, {}
    for r in rows:
        field = [o for o in rows if o["race"] == r["race"]]
        goal = [np.quantile([o[c] for o in field], 0.25) for c in X[:2]] + [min(o["traffic_laps"] for o in field)]
        total[r["race"], r["vehicle_number"]] = 0.0
        for i, c in enumerate(X):
            if r[c] > goal[i]:
                at = [goal[j] if j == i else r[x] for j, x in enumerate(X)]
                saving = 20 * (r["lap_time_delta"] - fits[r["race"]][0] - np.dot(fits[r["race"]][1:], at))
                want[r["race"], r["vehicle_number"], c] = saving
                total[r["race"], r["vehicle_number"]] += saving
    got = {(r["race"], r["vehicle_number"], r["feature"]): r["savings"] for r in catalog.queries()["interventions"](spark, DATA).collect()}
    assert got == pytest.approx(want, rel=1e-5, abs=1e-4)
    got = {(r["race"], r["vehicle_number"]): r["total_savings"] for r in catalog.queries()["scenarios"](spark, DATA).collect()}
    assert got == pytest.approx(total, rel=1e-5, abs=1e-4)


def validated(spark):
    """The whole validation table, from positions and relative times, in plain loops."""
    cars = {}
    for r in model_queries.relative_positions(spark, DATA).collect():
        cars.setdefault((r["race"], r["vehicle_number"]), {})[r["lap"]] = (r["position"], r["relative_time"])
    for key, laps in cars.items():
        for k in laps:
            past = np.mean([laps[x][1] for x in laps if x <= k])
            for h in (1, 2, 3, 5):
                if k + h in laps:
                    error = laps[k + h][1] - (0.3 * laps[k + h - 1][1] + 0.7 * past)
                    yield from ((*key, w, k, h, laps[k + h][0], error) for w in (3, 5, 8, 10, 15) if w <= k)


@tables
def test_errors_cover_all_warmups_and_horizons(spark):
    rows = list(validated(spark))
    got = catalog.queries()["expanding_validation"](spark, DATA).collect()
    assert {(r["race"], r["vehicle_number"], r["warmup_laps"], r["prediction_lap"], r["horizon"]): r["error"] for r in got} == pytest.approx({r[:5]: r[6] for r in rows}, abs=2e-6)
    assert len(got) == len(rows)
    cars, cells = {}, {}
    for r in rows:
        cars.setdefault(r[:2], []).append(r)
        cells.setdefault((r[2], r[4]), []).append(r)
    got = {(r["race"], r["vehicle_number"]): r for r in catalog.queries()["driver_stats"](spark, DATA).collect()}
    assert set(got) == set(cars)
    for key, own in cars.items():
        e, r = np.array([x[6] for x in own]), got[key]
        assert r["n"] == len(own)
        worst = min(own, key=lambda x: (-round(abs(x[6]), 9), x[3] + x[4]))
        assert r["worst_lap"] == worst[3] + worst[4]
        assert [r[c] for c in ("rmse", "mae", "avg_position", "worst_error")] == pytest.approx([np.sqrt((e**2).mean()), abs(e).mean(), np.mean([x[5] for x in own]), abs(e).max()], abs=2e-6)
    got = {(r["warmup_laps"], r["horizon"]): r for r in catalog.queries()["evaluate_errors"](spark, DATA).collect()}
    assert set(got) == set(cells) and len(cells) == 20
    for key, own in cells.items():
        e, w, r = np.array([x[6] for x in own]), np.maximum(0.1, 1 - 0.05 * (np.array([x[5] for x in own]) - 1)), got[key]
        assert r["n"] == len(own)
        assert [r[c] for c in ("rmse", "mae", "bias", "std", "weighted_rmse")] == pytest.approx([np.sqrt((e**2).mean()), abs(e).mean(), e.mean(), e.std(), np.sqrt((w * e**2).mean())], abs=2e-6)


@tables
def test_throttle_looks_200_rows_ahead(spark):
    cars, want, far = {}, {}, 0
    for r in adapter.telemetry(spark, DATA).collect():
        cars.setdefault((r["race"], r["vehicle_number"]), []).append((r["n"], r["ts_us"], r["throttle"]))
    for key, rows in cars.items():
        rows.sort()
        for i, (n, ts, _) in enumerate(rows):
            full = [(j, t) for j, (_, t, x) in enumerate(rows[i : i + 200]) if x >= 95]
            want[(*key, n)] = (min(t for _, t in full) - ts) / 1e6 if full else None
            far += bool(full) and full[0][0] >= 20
    assert far > 0
    got = {(r["race"], r["vehicle_number"], r["n"]): r["seconds_to_full"] for r in catalog.queries()["throttle_lookahead"](spark, DATA).collect()}
    assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, abs=2e-6)
