"""Least squares by sums, walk-forward validation, folds and leave-one-out against numpy refits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.operators import counterfactual as X
from lapforge.operators import fold_models as FM
from lapforge.operators import least_squares as LS
from lapforge.operators import walk_forward as W
from lapforge.operators.models import least_norm


def laps_of(seed, races=2, cars=6, laps=14, skip=()):
    rng = np.random.default_rng(seed)
    return [
        (r, 10 * r + c, lap, int(rng.integers(1, cars + 1)), float(rng.normal(50, 300)), float(rng.gamma(2, 9)), float(rng.normal(0, 3)), float(rng.normal(90, 4)))
        for r in range(races)
        for c in range(cars)
        for lap in range(1, laps + 1)
        if (c, lap) not in skip
    ]


SCHEMA = "race bigint, vehicle_number bigint, lap bigint, position bigint, gap_to_ahead double, gap_to_behind double, relative_time double, lap_time double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def fit(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(x, y, rcond=None)[0]


def relative_by_hand(rows, least, horizons):
    out = {}
    for race in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == race)
        by_car = {}
        for r in mine:
            by_car.setdefault(r[1], []).append(r)
        base = {c: np.mean([r[6] for r in v if 3 <= r[2] <= 5]) if any(3 <= r[2] <= 5 for r in v) else 0.0 for c, v in by_car.items()}
        for end in range(least, max(r[2] for r in mine)):
            x, y = [], []
            for c, v in by_car.items():
                for before, r in zip([None, *v], v, strict=False):
                    if r[2] <= end:
                        x.append([r[3], r[4], r[5], base[c], before[6] if before else base[c]])
                        y.append(r[6])
            beta = fit(np.array(x), np.array(y))
            for r in mine:
                if r[2] - end in horizons:
                    out[race, r[1], end, r[2] - end] = float(beta @ [1, r[3], r[4], r[5], base[r[1]], base[r[1]]])
    return out


def test_expanding_relative_brute(spark):
    rows = laps_of(1, skip={(0, 4), (2, 9), (3, 3), (3, 4), (3, 5), *((c, 7) for c in range(6))})
    got = {(r["race"], r["vehicle_number"], r["train_end"], r["horizon"]): r["predicted"] for r in W.expanding_relative(frame(spark, rows), horizons=(1, 3)).collect()}
    want = relative_by_hand(rows, 5, (1, 3))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-7)


def test_expanding_relative_sees_no_later_lap(spark):
    rows = laps_of(2)
    changed = [r if r[2] <= 9 else (*r[:4], r[4] + 1000, r[5], r[6] * -7 + 3, r[7]) for r in rows]
    a, b = (
        {(r["race"], r["vehicle_number"], r["train_end"]): r["predicted"] for r in W.expanding_relative(frame(spark, x)).filter("target_lap <= 9").collect()}
        for x in (rows, changed)
    )
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    with pytest.raises(ValueError):
        W.expanding_relative(frame(spark, rows), least=4)


def test_expanding_baseline_brute(spark):
    rows = laps_of(3, skip={*((4, lap) for lap in range(1, 11)), (1, 3)})
    rows = [(*r[:3], r[2] + 2, *r[4:]) if r[1] % 10 == 5 else r for r in rows]  # position is a line in lap
    got = {(r["race"], r["vehicle_number"], r["train_end"], r["horizon"]): (r["predicted"], r["own_model"]) for r in W.expanding_baseline(frame(spark, rows), horizons=(1, 5)).collect()}
    seen = set()
    for race in (0, 1):
        for r in (r for r in rows if r[0] == race):
            for h in (1, 5):
                end = r[2] - h
                if end < 5:
                    continue
                own = [q for q in rows if q[0] == race and q[1] == r[1] and q[2] <= end]
                mine = len(own) >= 3
                train = own if mine else [q for q in rows if q[0] == race and q[2] <= end]
                x = np.array([[q[2], q[3], 20 - q[2]] for q in train], float)
                at, beta = least_norm(x, np.array([q[7] for q in train]))
                key = (race, r[1], end, h)
                seen.add(key)
                assert got[key][0] == pytest.approx(at + beta @ [r[2], r[3], 20 - r[2]], abs=1e-7) and got[key][1] == mine
    assert seen == got.keys() and any(not own for _, own in got.values())


def test_solve_matches_lstsq_and_drops_dependent_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) * [1, 1e4, 1e-3] + [5, 1e6, 0]
    x = np.column_stack([x, 2 * x[:, 0] - 7, np.ones(40)])  # the last two depend on the others
    y = x[:, 0] - 3e-4 * x[:, 1] + rng.normal(size=40)
    table = spark.createDataFrame([(0, *map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "k int, a double, b double, c double, d double, e double, y double")
    cols = [table[c] for c in "abcde"]
    row = LS.solve(table.groupBy("k").agg(*LS.sums(cols, table["y"])), 5, inverse=True).first()
    want = fit(x[:, :3], y)
    assert [row[f"b{i}"] for i in range(4)] == pytest.approx(want.tolist(), rel=1e-6) and row["b4"] == row["b5"] == 0 and row["rank"] == 3
    assert row["rss"] == pytest.approx(float(((y - np.column_stack([np.ones(40), x[:, :3]]) @ want) ** 2).sum()), rel=1e-6)


def test_leave_one_out_equals_refits(spark):
    rng = np.random.default_rng(5)
    rows = [(r, c, float(rng.normal()), float(rng.gamma(2)), int(rng.integers(0, 9)), float(rng.normal(0, 3))) for r in range(2) for c in range(12)]
    rows += [(3, c, 1.0, 1.0, 1, 1.0) for c in range(4)]  # too few drivers for a fit
    table = spark.createDataFrame(rows, "race bigint, vehicle_number bigint, degradation double, consistency double, traffic_laps bigint, lap_time_delta double")
    got = {r["race"]: r for r in X.model_validation(table, X.race_fits(table)).collect()}
    assert got.keys() == {0, 1}
    for race in (0, 1):
        x = np.array([r[2:5] for r in rows if r[0] == race], float)
        y = np.array([r[5] for r in rows if r[0] == race])
        left = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            left.append(y[i] - fit(x[keep], y[keep]) @ [1, *x[i]])
        beta = fit(x, y)
        assert got[race]["loo_mae"] == pytest.approx(np.mean(np.abs(left)), rel=1e-8)
        assert got[race]["loo_r2"] == pytest.approx(1 - np.sum(np.square(left)) / ((y - y.mean()) ** 2).sum(), rel=1e-8)
        assert [got[race][f"{c}_positive"] for c in X.FEATURES] == [b > 0 for b in beta[1:]]


def test_linear_folds_brute(spark):
    rows = laps_of(6, races=4)
    columns = ["lap", "position", "gap_to_ahead"]
    got = FM.linear_folds(frame(spark, rows), columns, "race").collect()
    assert len(got) == len(rows)
    for r in got:
        train = [q for q in rows if q[0] != r["race"]]
        beta = fit(np.array([[q[2], q[3], q[4]] for q in train], float), np.array([q[7] for q in train]))
        assert r["predicted"] == pytest.approx(float(beta @ [1, r["lap"], r["position"], r["gap_to_ahead"]]), abs=1e-7)
    assert FM.linear_folds(frame(spark, rows[:20]), columns, "race").collect() == []  # a lone race


def test_boosted_folds_are_seeded(spark):
    table = frame(spark, laps_of(7, races=3))
    sets = {"short": ("lap", "position"), "long": ("lap", "position", "gap_to_ahead", "gap_to_behind")}
    runs = [FM.boosted_folds(table, sets, "race", trees=3, depth=2) for _ in range(2)]
    a, b = (sorted((r["feature_set"], r["race"], r["vehicle_number"], r["lap"], round(r["predicted"], 9)) for r in scored.collect()) for scored, _ in runs)
    assert a == b and len(a) == 2 * table.count()
    weights = runs[0][1].groupBy("feature_set", "fold").sum("importance").collect()
    assert len(weights) == 6 and all(r[2] == pytest.approx(1) for r in weights)
    with pytest.raises(ValueError):
        FM.boosted_folds(table, sets, "vehicle_number", max_folds=5)


def test_winner_accuracy_by_hand(spark):
    rows = [(0, 1, 1, 10.0, 10.0, 9.0), (0, 1, 2, 30.0, 40.0, 10.0), (0, 2, 1, 12.0, 12.0, 9.0), (0, 2, 2, 10.0, 22.0, 11.0), (0, 3, 2, 1.0, 1.0, 50.0)]
    table = spark.createDataFrame(rows, "race bigint, vehicle_number bigint, lap bigint, lap_time double, cumulative_time double, predicted double")
    got = FM.winner_accuracy(table, (1, 2)).collect()
    assert [(r["from_lap"], r["predicted_winner"], r["actual_winner"], r["correct"], r["predicted_margin"]) for r in got] == [(1, 1, 3, False, 3.0)]


def test_trees_are_fitted_on_few_parts(spark, monkeypatch):
    """Every tree passes over all parts once a level, so their number follows the rows and not what came before."""
    from pyspark.ml.regression import GBTRegressor

    from lapforge.operators import models

    table, parts, fit = frame(spark, laps_of(7, races=3)), [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows, params=None: (parts.append(rows.rdd.getNumPartitions()), fit(self, rows, params))[1])
    fits = [models.boosted_laps(rows, ("lap", "position"), trees=3, depth=2) for rows in (table.repartition(40), table.orderBy("lap_time"))]
    assert parts == [1, 1]
    one, other = (sorted((r["race"], r["vehicle_number"], r["lap"], r["prediction"]) for r in m.transform(table).collect()) for m in fits)
    assert one == other
    monkeypatch.setattr(models, "ROWS_PER_TASK", -(-table.count() // 3), raising=False)
    models.boosted_laps(table, ("lap", "position"), trees=1, depth=1)
    assert parts[2:] == [3]


def test_rows_of_folds_are_computed_once(spark):
    table = frame(spark, laps_of(7, races=3)).repartition(2, "race")
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return float(x)

    looked = table.withColumn("looked", F.udf(look, "double")("lap"))
    scored, _ = FM.boosted_folds(looked, {"one": ("looked", "position")}, "race", trees=2, depth=2)
    assert scored.count() == table.count() == len(scored.collect())
    assert seen.value == table.count()
