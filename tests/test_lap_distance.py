"""The distance axis, line clusters and corner variants against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lapforge.operators import lap_distance as D
from lapforge.operators import spatial as G


def test_line_clusters_equal_plane_clusters(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(8):
        at = np.round(np.concatenate([rng.normal(c, 8, rng.integers(1, 20)) for c in (50, 120, 300)] + [rng.uniform(0, 400, 5)]), 0 if g % 2 else 3)
        eps, least = float(rng.uniform(2, 15)), int(rng.integers(2, 6))
        rows += [(g, i, float(a), eps, least) for i, a in enumerate(at)]
        # the same rule in numpy: cores by count, runs of cores, nearest core for the rest
        near = np.abs(at[:, None] - at[None, :]) / eps <= 1 + 1e-12
        core = near.sum(1) >= least
        cores = np.sort(at[core])
        number = np.concatenate([[0], np.cumsum(np.diff(cores) / eps > 1 + 1e-12)]) if len(cores) else []
        for i, a in enumerate(at):
            gap = np.abs(cores - a) / eps if len(cores) else np.array([2.0])
            best = int(np.argmin(gap)) if len(gap) else 0
            want[g, i] = int(number[best]) if len(cores) and gap[best] <= 1 + 1e-12 else None
        plane = G.density_labels(np.column_stack([at, np.zeros(len(at))]), eps, least)
        assert len(set(plane[plane >= 0])) == (number[-1] + 1 if len(cores) else 0)
        assert [(want[g, i] is None) for i in range(len(at))] == (plane < 0).tolist()
    table = spark.createDataFrame(rows, "g int, i int, at double, eps double, least int").repartition(5)
    got = {(r["g"], r["i"]): r["cluster"] for r in D.line_clusters(table, "at", "eps", "least", ["g"]).collect()}
    assert got == want


def test_resampled_laps(spark):
    laps = {1: [(0.0, 10.0), (25.0, 20.0), (60.0, None), (70.0, 50.0)], 2: [(3.0, 1.0), (4.0, 2.0)], 3: [(50.0, 8.0), (50.0, 10.0), (None, 99.0)]}
    rows = [(0, 7, lap, d, v) for lap, some in laps.items() for d, v in some]
    table = spark.createDataFrame(rows, "race bigint, vehicle_number bigint, lap bigint, lap_distance double, speed double")
    got = {(r["lap"], r["distance"]): r["speed"] for r in D.resampled(table, ["speed"], 10.0).collect()}
    want = {(1, float(x)): float(np.interp(x, [0, 25, 70], [10, 20, 50])) for x in range(0, 80, 10)} | {(3, 50.0): 9.0}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert D.resampled(table.limit(0), ["speed"], 10.0).collect() == []


def test_samples_at_one_distance_are_ordered_by_their_ties(spark):
    """A standing vehicle's samples share a distance; whichever way the rows come, the lap runs as they were taken."""
    brake = [5.0, 30.0, 60.0, 90.0, 10.0, 0.0, 70.0, 20.0]
    rows = [(0, 7, 1, n, 40.0 if 1 <= n <= 5 else 40.0 + n - 3, float(n), 0.0, b) for n, b in enumerate(brake)]
    names = "race bigint, vehicle_number bigint, lap bigint, n bigint, lap_distance double, latitude double, longitude double, brake double"
    for some in (rows, rows[::-1], rows[3:] + rows[:3]):
        places = D.braking_places(spark.createDataFrame(some, names).coalesce(1), apart=1, prominence=0.0, least_rows=5, width=3, ties=["n"]).collect()
        assert [(r["latitude"], r["level"]) for r in places] == [(2.0, 60.0), (6.0, 70.0)]


def test_distance_corners_narrow_when_few(spark):
    rows = [(0, float(c * 30 + o), 0.0, 0.0, 20.0 + 30 * (c % 3)) for c in range(10) for o in (-4, 0, 4)]
    places = spark.createDataFrame(rows, "race bigint, lap_distance double, latitude double, longitude double, level double")
    laps = spark.createDataFrame([(0, 8, 1200.0)], "race bigint, n_laps bigint, track_length double")
    wide = D.distance_corners(places, laps, fewest=1, most=16).collect()
    assert len(wide) == 1 and not wide[0]["narrowed"]  # 25 m from one place to the next corner's
    narrow = sorted(D.distance_corners(places, laps, fewest=12, most=16).collect(), key=lambda r: r["corner_id"])
    assert [r["distance"] for r in narrow] == [c * 30.0 for c in range(10)] and all(r["narrowed"] and r["n_observations"] == 3 for r in narrow)
    assert [r["corner_type"] for r in narrow[:3]] == ["light", "medium", "heavy"]


def test_tuned_and_final_corners(spark):
    rng = np.random.default_rng(2)
    rows = []
    for lap in range(1, 6):
        for i in range(200):
            level = sum(h * np.exp(-(((i - c) / 6) ** 2)) for c, h in ((40, 25), (90, 55), (150, 90)))
            rows.append((0, 1, lap, i, float(level), 0.001 * i + float(rng.normal(0, 1e-6)), 0.5 - 0.001 * i))
    table = spark.createDataFrame(rows, "race bigint, vehicle_number bigint, lap bigint, ts_us bigint, brake double, latitude double, longitude double")
    for rule in (G.TUNED_CORNERS, G.FINAL_CORNERS):
        found = sorted(G.corners(table, rule).collect(), key=lambda r: r["latitude"])
        assert [round(r["latitude"], 3) for r in found] == [0.04, 0.09, 0.15] and [r["corner_type"] for r in found] == ["light", "medium", "heavy"]
        order = [r["corner_id"] for r in found]
        assert order == ([3, 2, 1] if rule.number_by == "longitude" else [3, 2, 1] if order[0] == 3 else [1, 2, 3])


def test_centred_mean():
    x = np.array([1.0, 2.0, 3.0, 10.0, 5.0, 6.0])
    assert G.centred_mean(x, 5).tolist() == [1.0, 2.0, 4.2, 5.2, 5.0, 6.0]
    assert G.centred_mean(x[:3], 5).tolist() == [1.0, 2.0, 3.0]


def test_braking_places_brute(spark):
    rng = np.random.default_rng(5)
    laps = {(0, v, lap): (rng.integers(0, 60, 30 if v else 8).astype(float), lap == 3) for v in (0, 1, 2) for lap in (1, 2, 3)}
    rows = [(r, v, lap, float(i * 10), 0.1 * i, 0.2 * i, 0.0 if blank else float(x)) for (r, v, lap), (some, blank) in laps.items() for i, x in enumerate(some)]
    rng.shuffle(rows)
    rows = [(int(r), int(v), int(lap), float(d), float(a), float(b), float(x)) for r, v, lap, d, a, b, x in rows] + [(0, 1, 1, None, 0.0, 0.0, 99.0)]
    table = spark.createDataFrame(rows, "race bigint, vehicle_number bigint, lap bigint, lap_distance double, latitude double, longitude double, brake double")
    got = sorted((r["vehicle_number"], r["lap"], r["lap_distance"], r["level"]) for r in D.braking_places(table, apart=4, prominence=3.0, least_rows=20, width=5).collect())
    want = []
    for (_, v, lap), (some, blank) in laps.items():
        if len(some) < 20 or blank:
            continue
        soft = G.centred_mean(some, 5)
        limit = np.percentile(soft[soft > 0], 40)
        want += [(v, lap, float(i * 10), float(some[i])) for i in G.peaks(soft, float(limit), 4, 3.0)]
    assert got == sorted(want) and want
    assert D.braking_places(table.limit(0)).collect() == []
