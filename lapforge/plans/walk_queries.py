"""Queries of regression models that walk forward, cross races or leave one out, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.operators import counterfactual as X
from lapforge.operators import fold_models as FM
from lapforge.operators import least_squares as LS
from lapforge.operators import race as R
from lapforge.operators import walk_forward as W
from lapforge.plans.adapter import CARS_PER_RACE
from lapforge.plans.metric_queries import r, rounded
from lapforge.plans.quality_queries import FIT_SQL, x_features
from lapforge.plans.race_queries import FEATURES_SQL, features

# laps without a yellow flag and within three deviations of their vehicle's mean
CLEAN_FEATURES_SQL = (
    FEATURES_SQL
    + """,
fr AS (SELECT *, lap_time - median(lap_time) OVER (PARTITION BY race, lap) AS relative_time FROM features),
fg AS (SELECT *, stddev_samp(lap_time) OVER w AS s, avg(lap_time) OVER w AS a FROM fr WHERE is_under_yellow = 0 WINDOW w AS (PARTITION BY race, vehicle_number)),
cf AS (SELECT * EXCLUDE (s, a) FROM fg WHERE s IS NULL OR s <= 0 OR abs(lap_time - a) <= 3 * s)"""
)
RELATIVE_WALK_SQL = (
    CLEAN_FEATURES_SQL
    + """,
fb AS (SELECT race, vehicle_number, lap, position, gap_to_ahead, gap_to_behind, relative_time, coalesce(avg(relative_time) FILTER (lap BETWEEN 3 AND 5) OVER (PARTITION BY race, vehicle_number), 0.0) AS driver_baseline,
  lag(relative_time) OVER (PARTITION BY race, vehicle_number ORDER BY lap) AS previous FROM cf),
ends AS (SELECT race, unnest(range(5, max(lap))) AS train_end FROM fb GROUP BY race),
ex AS (SELECT fb.race, train_end, vehicle_number, lap, position, gap_to_ahead, gap_to_behind, driver_baseline, lap <= train_end AS train, relative_time,
  CASE WHEN lap <= train_end THEN coalesce(previous, driver_baseline) ELSE driver_baseline END AS prev_relative
  FROM fb JOIN ends ON ends.race = fb.race AND (lap <= train_end OR lap - train_end IN (1, 3, 5, 10))),
"""
    + LS.residual_sql("ex", ["race", "train_end"], W.RELATIVE_FEATURES, "relative_time")
)
BASELINE_WALK_SQL = (
    CLEAN_FEATURES_SQL
    + """,
ends AS (SELECT race, unnest(range(5, max(lap))) AS train_end FROM cf GROUP BY race),
tests AS (SELECT cf.*, train_end FROM cf JOIN ends ON ends.race = cf.race AND lap - train_end IN (1, 3, 5, 10)),
sums AS (SELECT t.race, t.vehicle_number, t.train_end, t.lap, t.position, t.lap_time, u.own,
  count(*) AS n, avg(u.lap) AS ml, avg(u.position) AS mp, avg(u.lap_time) AS my, covar_pop(u.lap, u.lap) AS ll, covar_pop(u.position, u.position) AS pp, covar_pop(u.lap, u.position) AS lp,
  covar_pop(u.lap, u.lap_time) AS ly, covar_pop(u.position, u.lap_time) AS py
  FROM tests t JOIN (SELECT *, unnest([true, false]) AS own FROM cf) u ON u.race = t.race AND u.lap <= t.train_end AND (NOT u.own OR u.vehicle_number = t.vehicle_number) GROUP BY ALL),
slopes AS (SELECT *, CASE WHEN ll * pp - lp * lp > 1e-9 * ll * pp THEN (ly * pp - py * lp) / (ll * pp - lp * lp) WHEN ll > 0 THEN (ly / ll) / (1 + pow(lp / ll, 2) / 2) ELSE 0 END AS bl,
  CASE WHEN ll * pp - lp * lp > 1e-9 * ll * pp THEN (py * ll - ly * lp) / (ll * pp - lp * lp) WHEN ll > 0 THEN (ly / ll) / (1 + pow(lp / ll, 2) / 2) * (lp / ll) / 2 ELSE 0 END AS bp FROM sums),
walk AS (SELECT race, vehicle_number, train_end, lap, lap_time, arg_max(lap_time - (my + bl * (lap - ml) + bp * (position - mp)), own::INT) AS error, bool_or(own) AS own_model FROM slopes WHERE NOT own OR n >= 3 GROUP BY ALL)"""
)
# even races train, the odd race after each is its test; cars are numbered within their race
CROSS_SQL = (
    FEATURES_SQL
    + f""",
xr AS (SELECT race // 2 AS track, race % 2 AS heat, vehicle_number % {CARS_PER_RACE} AS car, lap, position, lap_time FROM features),
xs AS (SELECT t.track, t.car, t.lap, t.position, t.lap_time, u.own, count(*) AS n, avg(u.lap) AS ml, avg(u.position) AS mp, avg(u.lap_time) AS my, covar_pop(u.lap, u.lap) AS ll, covar_pop(u.position, u.position) AS pp,
  covar_pop(u.lap, u.position) AS lp, covar_pop(u.lap, u.lap_time) AS ly, covar_pop(u.position, u.lap_time) AS py
  FROM xr t JOIN (SELECT *, unnest([true, false]) AS own FROM xr WHERE heat = 0) u ON u.track = t.track AND (NOT u.own OR u.car = t.car) WHERE t.heat = 1 GROUP BY ALL),
xp AS (SELECT *, CASE WHEN ll * pp - lp * lp > 1e-9 * ll * pp THEN (ly * pp - py * lp) / (ll * pp - lp * lp) WHEN ll > 0 THEN (ly / ll) / (1 + pow(lp / ll, 2) / 2) ELSE 0 END AS bl,
  CASE WHEN ll * pp - lp * lp > 1e-9 * ll * pp THEN (py * ll - ly * lp) / (ll * pp - lp * lp) WHEN ll > 0 THEN (ly / ll) / (1 + pow(lp / ll, 2) / 2) * (lp / ll) / 2 ELSE 0 END AS bp FROM xs),
xe AS (SELECT track, car, lap, arg_max(lap_time - (my + bl * (lap - ml) + bp * (position - mp)), own::INT) AS error, bool_or(own) AS own_model FROM xp WHERE NOT own OR n >= 3 GROUP BY track, car, lap)"""
)
FEATURE_SETS = {
    "base": ("lap", "position", "gap_to_leader", "gap_to_ahead", "gap_to_behind", "gap_delta_ahead", "gap_delta_behind", "race_progress", "fuel_load_estimate"),
}
FEATURE_SETS["lag"] = (*FEATURE_SETS["base"], "prev_lap_time", "rolling_avg_3")


def fold_sql(name: str) -> str:
    """CTEs ending in e_<name>: every row's residual for each race left out; needs FEATURES_SQL before it."""
    columns = FEATURE_SETS[name]
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    swept = LS.residual_sql(f"f_{name}", ["fold"], columns, "lap_time")
    for i in range(len(columns), -1, -1):  # each feature set has its own CTEs
        swept = swept.replace(f"q{i} ", f"{name}_q{i} ").replace(f"FROM q{i})", f"FROM {name}_q{i})").replace(f"m{i} ", f"{name}_m{i} ").replace(f"FROM m{i})", f"FROM {name}_m{i})")
    return f"""
f_{name} AS (SELECT fold, race <> fold AS train, race, lap_time, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)} FROM features, (SELECT DISTINCT race AS fold FROM features) WHERE {known}),
{swept},
e_{name} AS (SELECT '{name}' AS feature_set, fold AS race, sqrt(avg(y * y) FILTER (train)) AS train_rmse, sqrt(avg(y * y) FILTER (NOT train)) AS test_rmse, avg(abs(y)) FILTER (NOT train) AS mae,
  avg(lap_time) FILTER (NOT train) AS mean_target, count(*) FILTER (NOT train) AS n, count(*) FILTER (train) AS trained FROM {name}_q{len(columns)} GROUP BY fold)"""


LEFT_OUT_SQL = (
    FIT_SQL
    + """,
fu AS (SELECT race, vehicle_number, CAST(degradation AS DOUBLE) AS degradation, CAST(consistency AS DOUBLE) AS consistency, CAST(traffic_laps AS DOUBLE) AS traffic_laps, lap_time_delta FROM xf
  WHERE degradation IS NOT NULL AND consistency IS NOT NULL AND traffic_laps IS NOT NULL AND lap_time_delta IS NOT NULL),
lo AS (SELECT a.*, b.vehicle_number AS left_out, a.vehicle_number <> b.vehicle_number AS train FROM fu a JOIN fu b ON a.race = b.race),
"""
    + LS.residual_sql("lo", ["race", "left_out"], X.FEATURES, "lap_time_delta")
)


def clean_features(s, d):
    return R.within_sigma(R.green_laps(R.relative_time(features(s, d))), "lap_time", 3.0)


def relative_walk(s, d):
    return W.expanding_relative(clean_features(s, d), horizons=W.STEPS)


def baseline_walk(s, d):
    return W.expanding_baseline(clean_features(s, d))


def cross_races(s, d):
    """Races 2k train, races 2k + 1 test; cars are numbered within their race."""
    f = features(s, d).select(F.expr("race div 2").alias("track"), (F.col("race") % 2).alias("heat"), (F.col("vehicle_number") % CARS_PER_RACE).alias("vehicle_number"), "lap", "position", "lap_time")
    return W.cross_race(f.filter("heat = 0").drop("heat"), f.filter("heat = 1").drop("heat"), ["track"])


def left_out(s, d):
    f = x_features(s, d)
    return X.model_validation(f, X.race_fits(f))


STEP = "round(sqrt(avg({e} * {e})) + 1.7e-10, 5) AS rmse, round(avg(abs({e})) + 1.7e-10, 5) AS mae, count(*) AS n"


def race_folds(s, d):
    """Each race predicted by least squares over all other races, for two sets of features."""
    f = features(s, d)
    some = [FM.fold_errors(FM.linear_folds(f, columns, "race"), ["race"]).withColumn("feature_set", F.lit(name)) for name, columns in FEATURE_SETS.items()]
    return some[0].unionByName(some[1])


def boosted(s, d, sets=FEATURE_SETS):
    """Boosted trees over the same sets, even races left out and odd ones: (scored rows, importances)."""
    return FM.boosted_folds(features(s, d).withColumn("heat", F.col("race") % 2), sets, "heat")


def boosted_errors(s, d):
    return FM.fold_errors(boosted(s, d)[0], ["feature_set", "heat"])


def winners(s, d):
    """Winners of the odd races by the times that the fit of the even race before predicts."""
    f = features(s, d).select(F.expr("race div 2").alias("track"), (F.col("race") % 2).alias("heat"), (F.col("vehicle_number") % CARS_PER_RACE).alias("vehicle_number"), "lap", "position", "lap_time", "cumulative_time")
    return FM.winner_accuracy(W.cross_race(f.filter("heat = 0").drop("heat"), f.filter("heat = 1").drop("heat"), ["track"]), race=["track"])


R5 = lambda c: F.round(F.col(c) + 1.7e-10, 5).alias(c)

QUERIES = {
    "expanding_relative_model": (
        lambda s, d: W.step_errors(relative_walk(s, d), ["race", "train_end", "horizon"]).select("race", "train_end", "horizon", R5("rmse"), R5("mae"), "n"),
        f"WITH {RELATIVE_WALK_SQL} SELECT race, train_end, lap - train_end AS horizon, {STEP.format(e='y')} FROM q5 WHERE NOT train GROUP BY race, train_end, lap - train_end",
    ),
    "expanding_baseline_model": (
        lambda s, d: W.step_errors(baseline_walk(s, d), ["race", "train_end", "horizon", "own_model"]).select("race", "train_end", "horizon", "own_model", R5("rmse"), R5("mae"), "n"),
        f"WITH {BASELINE_WALK_SQL} SELECT race, train_end, lap - train_end AS horizon, own_model, {STEP.format(e='error')} FROM walk GROUP BY race, train_end, lap - train_end, own_model",
    ),
    "cross_race_baseline": (
        lambda s, d: W.step_errors(cross_races(s, d), ["track", "vehicle_number"]).select("track", "vehicle_number", R5("rmse"), R5("mae"), "n"),
        f"WITH {CROSS_SQL} SELECT track, car AS vehicle_number, {STEP.format(e='error')} FROM xe GROUP BY track, car",
    ),
    "leave_one_race_out_sets": (
        lambda s, d: race_folds(s, d).select("feature_set", "race", R5("train_rmse"), R5("test_rmse"), R5("mae"), R5("mean_target"), R5("pct_error"), "n"),
        f"""WITH {FEATURES_SQL},{fold_sql('base')},{fold_sql('lag')}, u AS (SELECT * FROM e_base UNION ALL SELECT * FROM e_lag)
SELECT feature_set, race, {', '.join(f'round({c} + 1.7e-10, 5) AS {c}' for c in ('train_rmse', 'test_rmse', 'mae', 'mean_target'))}, round(100 * test_rmse / nullif(mean_target, 0) + 1.7e-10, 5) AS pct_error, n FROM u WHERE trained > 0""",
    ),
    "winner_accuracy": (
        lambda s, d: winners(s, d).select("track", "from_lap", "predicted_winner", "actual_winner", "correct", R5("predicted_margin")),
        f"""WITH {CROSS_SQL}, c AS (SELECT xe.track, xe.car, features.lap, lap_time, cumulative_time, lap_time - error AS predicted FROM features JOIN xe ON xe.track = race // 2 AND xe.car = vehicle_number % {CARS_PER_RACE} AND xe.lap = features.lap WHERE race % 2 = 1),
w AS (SELECT track, from_lap, car, coalesce(max(cumulative_time) FILTER (lap = from_lap), 0) AS so_far, sum(predicted) FILTER (lap > from_lap) AS p, sum(lap_time) FILTER (lap > from_lap) AS a FROM c, (SELECT unnest([5, 10, 15, 20]) AS from_lap) GROUP BY track, from_lap, car),
k AS (SELECT *, row_number() OVER (PARTITION BY track, from_lap ORDER BY so_far + p, car) AS kp, row_number() OVER (PARTITION BY track, from_lap ORDER BY so_far + a, car) AS ka FROM w WHERE p IS NOT NULL)
SELECT track, from_lap, max(car) FILTER (kp = 1) AS predicted_winner, max(car) FILTER (ka = 1) AS actual_winner, max(car) FILTER (kp = 1) = max(car) FILTER (ka = 1) AS correct,
round(coalesce(max(so_far + p) FILTER (kp = 2) - min(so_far + p), 0) + 1.7e-10, 5) AS predicted_margin FROM k GROUP BY track, from_lap""",
    ),
    "boosted_left_out": (boosted_errors, None),
    "boosted_importances": (lambda s, d: boosted(s, d, {"lag": FEATURE_SETS["lag"]})[1], None),
    "ols_validation": (
        lambda s, d: rounded(left_out(s, d), "r2", "mae", "loo_r2", "loo_mae"),
        f"""WITH {LEFT_OUT_SQL}, own AS (SELECT race, sum(y * y) AS press, avg(abs(y)) AS loo_mae, var_pop(lap_time_delta) * count(*) AS tss FROM q3 WHERE NOT train GROUP BY race),
ins AS (SELECT fu.race, avg(abs(lap_time_delta - (intercept + b1 * degradation + b2 * consistency + b3 * traffic_laps))) AS mae FROM fu JOIN fits ON fits.race = fu.race GROUP BY fu.race)
SELECT fits.race, {r('r2', 'mae', 'loo_mae')}, round(1 - press / nullif(tss, 0) + 1.7e-10, 6) AS loo_r2, b1 > 0 AS degradation_positive, b2 > 0 AS consistency_positive, b3 > 0 AS traffic_laps_positive,
fits.n, b1 > 0 AND b2 > 0 AND b3 > 0 AS passed FROM fits JOIN own ON own.race = fits.race JOIN ins ON ins.race = fits.race""",
    ),
}
