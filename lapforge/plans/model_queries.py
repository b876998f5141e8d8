"""Queries of the models and their validation, with their SQL."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.operators import models as L
from lapforge.operators import race as R
from lapforge.operators import validation as VAL
from lapforge.operators import views
from lapforge.operators.compare import standings
from lapforge.plans.adapter import LAPS_SQL, TOTAL_LAPS, laps, telemetry
from lapforge.plans.compare_queries import PER_LAP_SQL, STANDINGS_SQL, per_lap_metrics
from lapforge.plans.metric_queries import r, rounded
from lapforge.plans.race_queries import DELTAS_SQL, FEATURES_SQL, KEY, POSITION_SQL, R6, RELATIVE_SQL, features, positioned
from lapforge.sources.session import kept

V = ["race", "vehicle_number"]

FIT_SQL = (
    RELATIVE_SQL
    + """,
ml AS (SELECT DISTINCT race, lap, field_median FROM relative),
base AS (SELECT race, median(field_median) AS baseline FROM ml GROUP BY race),
fit AS (SELECT race, vehicle_number, avg(relative_time) AS mean_relative, arg_max(relative_time, lap) AS last_relative, any_value(baseline) AS baseline FROM relative JOIN base USING (race) GROUP BY race, vehicle_number)"""
)
REGIME_SQL = (
    LAPS_SQL
    + """,
rl AS (SELECT race, lap, median(lap_time) AS field_median, stddev_samp(lap_time) AS field_std, max(is_under_yellow) AS is_yellow, count(*) AS n_cars FROM laps GROUP BY race, lap),
rb AS (SELECT *, median(field_median) FILTER (lap <= 10) OVER (PARTITION BY race) AS baseline FROM rl),
regimes AS (SELECT *, CASE WHEN is_yellow > 0 THEN 'yellow' WHEN field_median > baseline + 20 THEN 'restart' WHEN field_median > baseline + 5 THEN 'yellow' ELSE 'green' END AS regime FROM rb)"""
)
REL_POS_SQL = (
    POSITION_SQL
    + """,
rp AS (SELECT *, lap_time - median(lap_time) OVER (PARTITION BY race, lap) AS relative_time FROM pos)"""
)
VAL_SQL = (
    REL_POS_SQL
    + """,
vb AS (SELECT *, avg(relative_time) OVER (PARTITION BY race, vehicle_number ORDER BY lap) AS mean_past, lag(relative_time) OVER (PARTITION BY race, vehicle_number ORDER BY lap) AS prev FROM rp),
vj AS (SELECT a.race, a.vehicle_number, a.lap AS prediction_lap, b.lap AS target_lap, h AS horizon, b.position, b.relative_time AS actual, 0.3 * b.prev + 0.7 * a.mean_past AS predicted
  FROM vb a CROSS JOIN (SELECT unnest([1, 2, 3, 5]) AS h) JOIN vb b ON b.race = a.race AND b.vehicle_number = a.vehicle_number AND b.lap = a.lap + h),
val AS (SELECT vj.*, actual - predicted AS error, warmup_laps FROM vj JOIN (SELECT unnest([3, 5, 8, 10, 15]) AS warmup_laps) ON warmup_laps <= prediction_lap)"""
)
STRATEGIC_SQL = (
    DELTAS_SQL
    + """,
sr AS (SELECT *, lap_time - median(lap_time) OVER (PARTITION BY race, lap) AS relative_time FROM deltas),
sfit AS (SELECT race, vehicle_number, avg(relative_time) AS base_pace, count(*) FILTER (gap_delta_ahead < -0.3) / CAST(count(*) AS DOUBLE) AS aggression,
  avg(least(greatest(gap_to_ahead, 0.0), 30.0)) AS mean_gap_ahead, arg_max(relative_time, lap) AS last_relative FROM sr GROUP BY race, vehicle_number),
sc AS (SELECT race, vehicle_number, lap, last_relative, 0.7 * base_pace - 0.05 * least(greatest(gap_to_ahead - mean_gap_ahead, -5.0), 5.0)
  + CASE WHEN gap_to_behind < 5 THEN 0.05 * (5 - gap_to_behind) / 5 ELSE 0.0 END + CASE WHEN position > 5 THEN 0.05 * (position - 5) * 0.1 ELSE 0.0 END AS c,
  CASE WHEN gap_to_ahead < 1 THEN 'close_battle' WHEN gap_to_behind < 2 THEN 'pressure' ELSE 'green' END AS regime FROM sr JOIN sfit USING (race, vehicle_number))"""
)
VALIDATED_LAPS = (10, 15, 20)


def overtake_sql(at: int) -> str:
    """CTE ov{at}: predicted positions from lap `at`; needs DELTAS_SQL before it."""
    return f"""
orr{at} AS (SELECT *, lap_time - median(lap_time) OVER (PARTITION BY race, lap) AS relative_time FROM deltas WHERE lap <= {at}),
op{at} AS (SELECT race, vehicle_number, coalesce(avg(relative_time) FILTER (lap > {at - 5}), avg(relative_time)) AS pace, stddev_samp(relative_time) FILTER (lap > {at - 5}) AS std, count(*) FILTER (lap > {at - 5}) AS n FROM orr{at} GROUP BY race, vehicle_number),
onow{at} AS (SELECT d.race, d.vehicle_number, d.position, d.gap_to_ahead, pace, std, n, pace - lag(pace) OVER (PARTITION BY d.race ORDER BY d.position) AS dl FROM deltas d JOIN op{at} USING (race, vehicle_number) WHERE d.lap = {at}),
oc{at} AS (SELECT *, coalesce(dl < -0.1 AND gap_to_ahead / abs(dl) < {TOTAL_LAPS - at}, false) AS can FROM onow{at}),
ov{at} AS (SELECT race, vehicle_number, position AS current_position, greatest(1, position - CASE WHEN can THEN 1 ELSE 0 END) AS predicted_position, CASE WHEN can THEN CAST(ceil(gap_to_ahead / abs(dl)) AS BIGINT) END AS laps_to_overtake,
  CASE WHEN n > 1 THEN greatest(0.3, 1 - std / 3) ELSE 0.5 END AS confidence FROM oc{at})"""


OVERTAKE_SQL = DELTAS_SQL + "," + overtake_sql(30)
IDEAL = sum((5 - i) / math.log2(i + 2) for i in range(5))


def relative_positions(s, d):
    return R.relative_time(positioned(s, d))


def validation(s, d):
    return VAL.expanding_validation(relative_positions(s, d))


def strategic(s, d):
    f = features(s, d)
    return L.strategic_predict(L.strategic_fit(f), f)


def overtakes(s, d):
    return L.overtakes(features(s, d), 30, TOTAL_LAPS)


def position_validation(s, d):
    """Errors of the positions predicted from laps 10, 15 and 20."""
    f, final = features(s, d), standings(laps(s, d))
    scored = [VAL.position_errors(L.overtakes(f, at, TOTAL_LAPS), final).withColumn("from_lap", F.lit(at).cast("bigint")) for at in VALIDATED_LAPS]
    return rounded(functools.reduce(DataFrame.unionByName, scored), "mean_error")


def yellow_model(s, d):
    """Probabilities of a yellow flag next lap in the odd races by a forest of the even ones, null where no model can be fitted."""
    from pyspark.ml.functions import vector_to_array

    rows = L.field_statistics(laps(s, d), R.position_churn(positioned(s, d)), R.yellow_laps(laps(s, d))).withColumn("next_yellow", F.col("next_yellow").cast("double"))
    known, rows = rows.filter("race % 2 = 0"), rows.filter("race % 2 = 1")
    model = L.yellow_forest(known, ["field_median", "field_std", "field_min", "field_max", "n_cars", "position_churn"])
    if model is None:
        return rows.select("race", "lap", "next_yellow", F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("prediction"))
    return model.transform(rows).select("race", "lap", "next_yellow", vector_to_array("probability")[1].alias("probability"), "prediction")


def boosted(s, d):
    """Train on even races, test on odd ones."""
    f = kept(features(s, d).select(*KEY, "position", "laps_remaining", "prev_lap_time", "rolling_avg_3", "lap_time").dropna())
    model = L.boosted_laps(f.filter("race % 2 = 0"), ["lap", "position", "prev_lap_time", "rolling_avg_3"])
    tested = model.transform(f.filter("race % 2 = 1")).withColumn("error", F.col("lap_time") - F.col("prediction"))
    return L.evaluate(tested, ["race"])


def leave_one_race_out(s, d):
    """Two-feature least squares on all other races, by subtracting each race's sums from the total. A lone race has no others and no row."""
    x, y = F.col("lap").cast("double"), F.col("lap_time")
    per = laps(s, d).groupBy("race").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    total = per.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "x", "y", "xx", "xy")])
    o = {c: F.col(f"t_{c}") - F.col(c) for c in ("n", "x", "y", "xx", "xy")}
    slope = (o["n"] * o["xy"] - o["x"] * o["y"]) / F.nullif(o["n"] * o["xx"] - o["x"] * o["x"], F.lit(0.0))
    fit = per.crossJoin(F.broadcast(total)).withColumn("slope", slope).filter(o["n"] > 0).withColumn("intercept", (o["y"] - F.col("slope") * o["x"]) / F.nullif(o["n"], F.lit(0.0))).select("race", "slope", "intercept")
    e = F.col("lap_time") - (F.col("intercept") + F.col("slope") * F.col("lap"))
    scored = laps(s, d).join(fit, "race").withColumn("error", e)
    return scored.groupBy("race").agg(F.round(F.first("slope") + 1.7e-10, 6).alias("slope"), F.round(F.avg(F.abs("error")) + 1.7e-10, 6).alias("mae"))


def walk_forward_ols(s, d):
    """Each lap from a line through the vehicle's earlier laps (three at least)."""
    past = R.by_vehicle().rowsBetween(-(2**31), -1)
    x, y = F.col("lap").cast("double"), F.col("lap_time")
    rows = laps(s, d).withColumns({"n": F.count(F.lit(1)).over(past), "slope": F.regr_slope(y, x).over(past), "at": F.regr_intercept(y, x).over(past)})
    e = F.col("lap_time") - (F.col("at") + F.col("slope") * F.col("lap"))
    return rows.filter("n >= 3").withColumn("e", e).groupBy(*V).agg(F.round(F.avg(F.abs("e")), 5).alias("mae"), F.count(F.lit(1)).alias("n"))


IMPACT = {"coasting_pct": 0.02, "brake_level": 0.01}

QUERIES = {
    "relative_fit": (
        lambda s, d: rounded(L.relative_fit(laps(s, d)), "mean_relative", "last_relative", "baseline"),
        f"WITH {FIT_SQL} SELECT race, vehicle_number, {r('mean_relative', 'last_relative', 'baseline')} FROM fit",
    ),
    "relative_predict": (
        lambda s, d: L.relative_predict(L.relative_fit(laps(s, d).filter("lap <= 40")), laps(s, d).filter("lap > 40")).select(*KEY, R6("predicted_relative")),
        f"""WITH {FIT_SQL.replace('FROM laps)', 'FROM laps WHERE lap <= 40)', 1)}
SELECT race, vehicle_number, lap, round(mean_relative + pow(0.3, row_number() OVER (PARTITION BY race, vehicle_number ORDER BY lap)) * (last_relative - mean_relative) + 1.7e-10, 6) AS predicted_relative
FROM laps JOIN fit USING (race, vehicle_number) WHERE lap > 40""",
    ),
    "online_update": (
        lambda s, d: rounded(L.online_update(laps(s, d)), "prev_relative", "mean_relative"),
        f"""WITH {RELATIVE_SQL}, m AS (SELECT *, max(lap) OVER (PARTITION BY race, vehicle_number) AS last FROM relative)
SELECT race, vehicle_number, round(arg_max(relative_time, lap) + 1.7e-10, 6) AS prev_relative, round(sum(0.1 * pow(0.9, last - lap) * relative_time) + 1.7e-10, 6) AS mean_relative FROM m GROUP BY race, vehicle_number""",
    ),
    "lap_regimes": (
        lambda s, d: rounded(L.lap_regimes(laps(s, d)), "field_median", "field_std", "baseline"),
        f"""WITH {REGIME_SQL} SELECT race, lap, is_yellow, n_cars, regime, {r('field_median', 'field_std', 'baseline')} FROM regimes""",
    ),
    "regime_means": (
        lambda s, d: rounded(L.regime_means(laps(s, d)), "predicted_relative"),
        f"""WITH {REGIME_SQL}, x AS (SELECT l.race, vehicle_number, regime, lap_time - field_median AS rel FROM laps l JOIN regimes g ON g.race = l.race AND g.lap = l.lap),
o AS (SELECT race, vehicle_number, avg(rel) AS overall FROM x GROUP BY race, vehicle_number), p AS (SELECT race, vehicle_number, regime, avg(rel) AS mean FROM x GROUP BY race, vehicle_number, regime)
SELECT o.race, o.vehicle_number, k.regime, round(coalesce(mean, overall) + 1.7e-10, 6) AS predicted_relative FROM o CROSS JOIN (SELECT unnest(['green', 'yellow', 'restart']) AS regime) k LEFT JOIN p ON p.race = o.race AND p.vehicle_number = o.vehicle_number AND p.regime = k.regime""",
    ),
    "regime_uncertainty": (
        lambda s, d: L.lap_regimes(laps(s, d)).select("race", "lap", "regime", L.uncertainty(F.col("regime"), F.col("field_std") / 100).alias("uncertainty"), L.confidence(L.uncertainty(F.col("regime"))).alias("confidence")),
        f"""WITH {REGIME_SQL}, u AS (SELECT *, CASE regime WHEN 'green' THEN 1.9 WHEN 'yellow' THEN 2.5 ELSE 7.0 END AS u FROM regimes)
SELECT race, lap, regime, CAST(CASE WHEN field_std / 100 > 0.5 THEN u * 1.5 ELSE u END AS DOUBLE) AS uncertainty, CASE WHEN u <= 2 THEN 'high' WHEN u <= 3 THEN 'medium' ELSE 'low' END AS confidence FROM u""",
    ),
    "walk_forward_regimes": (
        lambda s, d: rounded(L.walk_forward_regimes(laps(s, d)).groupBy(*V).agg(F.avg(F.abs("error")).alias("mae"), F.count(F.lit(1)).alias("n")), "mae"),
        f"""WITH {RELATIVE_SQL}, p AS (SELECT *, lag(relative_time) OVER w AS prev, lag(field_median) OVER w AS pm, avg(relative_time) OVER (PARTITION BY race, vehicle_number ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM relative WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY lap))
SELECT race, vehicle_number, round(avg(abs(lap_time - (pm + 0.3 * prev + 0.7 * mean))) + 1.7e-10, 6) AS mae, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY race, vehicle_number""",
    ),
    "strategic_fit": (
        lambda s, d: rounded(L.racing_style(L.strategic_fit(features(s, d))), "base_pace", "aggression", "mean_gap_ahead", "last_relative"),
        f"""WITH {STRATEGIC_SQL} SELECT race, vehicle_number, {r('base_pace', 'aggression', 'mean_gap_ahead', 'last_relative')},
(CASE WHEN aggression > 0.3 THEN 'aggressive' WHEN aggression > 0.15 THEN 'balanced' ELSE 'patient' END) || ', ' || CASE WHEN base_pace < 0 THEN 'faster' ELSE 'slower' END || ' than the field' AS style FROM sfit""",
    ),
    "strategic_predict": (
        lambda s, d: strategic(s, d).withColumn("predicted_relative", F.round(F.col("predicted_relative") + 1.7e-10, 3)),
        f"""WITH RECURSIVE {STRATEGIC_SQL}, f(race, vehicle_number, lap, p, regime) AS (
SELECT race, vehicle_number, lap, 0.3 * last_relative + c, regime FROM sc WHERE lap = 1
UNION ALL SELECT sc.race, sc.vehicle_number, sc.lap, 0.3 * f.p + sc.c, sc.regime FROM f JOIN sc ON sc.vehicle_number = f.vehicle_number AND sc.lap = f.lap + 1)
SELECT race, vehicle_number, lap, round(p + 1.7e-10, 3) AS predicted_relative, regime, CAST(CASE WHEN regime = 'green' THEN 1.7 ELSE 2.5 END AS DOUBLE) AS uncertainty FROM f""",
    ),
    "overtakes": (lambda s, d: rounded(overtakes(s, d), "confidence"), f"WITH {OVERTAKE_SQL} SELECT race, vehicle_number, current_position, predicted_position, laps_to_overtake, round(confidence + 1.7e-10, 6) AS confidence FROM ov30"),
    "predicted_podium": (
        lambda s, d: L.predicted_podium(overtakes(s, d)).select(*V, "place"),
        f"WITH {OVERTAKE_SQL}, p AS (SELECT race, vehicle_number, row_number() OVER (PARTITION BY race ORDER BY predicted_position, current_position) AS place FROM ov30) SELECT * FROM p WHERE place <= 3",
    ),
    "position_validation": (
        position_validation,
        f"""WITH {DELTAS_SQL}, {", ".join(overtake_sql(at) for at in VALIDATED_LAPS)}, {STANDINGS_SQL}, ov AS ({" UNION ALL ".join(f"SELECT {at} AS from_lap, * FROM ov{at}" for at in VALIDATED_LAPS)})
SELECT race, CAST(from_lap AS BIGINT) AS from_lap, round(avg(abs(predicted_position - final_position)) + 1.7e-10, 6) AS mean_error, count(*) FILTER (predicted_position = 1 AND final_position = 1) AS winner_hits,
count(*) FILTER (predicted_position <= 3 AND final_position <= 3) AS podium_hits FROM ov JOIN standings USING (race, vehicle_number) GROUP BY race, from_lap""",
    ),
    "runner_up_what_if": (
        lambda s, d: rounded(L.runner_up(features(s, d)), "gap", "time_lost"),
        f"""WITH {POSITION_SQL}, lr AS (SELECT race, vehicle_number, arg_max(position, lap) AS position, max(cumulative_time) AS time, max(lap) AS laps, avg(lap_time) FILTER (lap BETWEEN 3 AND 5) AS early, avg(lap_time) FILTER (lap >= 20) AS late FROM pos GROUP BY race, vehicle_number),
n AS (SELECT *, row_number() OVER (PARTITION BY race, position ORDER BY laps DESC, time, vehicle_number) AS k FROM lr),
j AS (SELECT a.race, b.vehicle_number AS winner, a.vehicle_number AS runner_up, a.time - b.time AS gap, greatest((a.late - a.early) / greatest(a.laps - 5, 1), 0.0) AS pl, a.laps FROM n a JOIN n b ON a.race = b.race AND a.position = 2 AND b.position = 1 AND a.k = 1 AND b.k = 1)
SELECT race, winner, runner_up, round(gap + 1.7e-10, 6) AS gap, round(pl * laps * (laps + 1) / 2 + 1.7e-10, 6) AS time_lost, laps * 0.15 > gap AS would_have_won FROM j""",
    ),
    "technique_potential": (
        lambda s, d: rounded(L.technique_potential(per_lap_metrics(s, d).select(*KEY, *IMPACT), IMPACT, early=2, late=5), "potential"),
        f"""WITH {PER_LAP_SQL}, u AS (SELECT race, vehicle_number, lap, unnest([{{'m': 'coasting_pct', 'x': coasting_pct, 'i': 0.02}}, {{'m': 'brake_level', 'x': brake_level, 'i': 0.01}}]) AS u FROM per_lap)
SELECT race, vehicle_number, u.m AS metric, round(greatest((avg(u.x) FILTER (lap >= 5) - avg(u.x) FILTER (lap <= 2)) * any_value(u.i), 0.0) + 1.7e-10, 6) AS potential FROM u GROUP BY race, vehicle_number, u.m""",
    ),
    "winner_forecast": (
        lambda s, d: rounded(L.winner_forecast(features(s, d), 30, TOTAL_LAPS), "margin"),
        f"""WITH {POSITION_SQL}, a AS (SELECT race, vehicle_number, max(cumulative_time) + avg(lap_time) * 30 AS total FROM pos WHERE lap <= 30 GROUP BY race, vehicle_number),
k AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY total, vehicle_number) AS k FROM a)
SELECT race, max(vehicle_number) FILTER (k = 1) AS winner, round(max(total) FILTER (k = 2) - max(total) FILTER (k = 1) + 1.7e-10, 6) AS margin FROM k GROUP BY race""",
    ),
    "roll_forward": (
        lambda s, d: rounded(views.roll_forward(features(s, d).filter("lap <= 30"), 35), "forecast_time"),
        f"""WITH {FEATURES_SQL}, l AS (SELECT race, vehicle_number, max(lap) AS last, arg_max(rolling_avg_3, lap) AS pace, max(cumulative_time) AS so_far FROM features WHERE lap <= 30 GROUP BY race, vehicle_number),
x AS (SELECT *, unnest(generate_series(last + 1, 35)) AS lap FROM l) SELECT race, vehicle_number, lap, round(so_far + pace * (lap - last) + 1.7e-10, 6) AS forecast_time FROM x""",
    ),
    "driver_ols": (
        lambda s, d: rounded(L.two_feature_ols(features(s, d)), "intercept", "lap_coef", "position_coef"),
        f"""WITH {POSITION_SQL}, m AS (SELECT race, vehicle_number, count(*) AS n, avg(lap) AS mx, avg(position) AS mz, avg(lap_time) AS my, covar_pop(lap, lap) AS xx, covar_pop(position, position) AS zz, covar_pop(lap, position) AS xz, covar_pop(lap, lap_time) AS xy, covar_pop(position, lap_time) AS zy FROM pos GROUP BY race, vehicle_number),
c AS (SELECT *, (xy * zz - zy * xz) / nullif(xx * zz - xz * xz, 0) AS a, (zy * xx - xy * xz) / nullif(xx * zz - xz * xz, 0) AS b FROM m WHERE n >= 3)
SELECT race, vehicle_number, n, round(my - a * mx - b * mz + 1.7e-10, 6) AS intercept, round(a + 1.7e-10, 6) AS lap_coef, round(b + 1.7e-10, 6) AS position_coef FROM c""",
    ),
    "driver_ols_least_norm": (
        lambda s, d: rounded(L.driver_ols(features(s, d)), "intercept", "lap", "position", "laps_remaining"),
        f"""WITH {POSITION_SQL}, m AS (SELECT race, vehicle_number, count(*) AS n, avg(lap) AS mx, avg(position) AS mz, avg(lap_time) AS my, covar_pop(lap, lap) AS xx, covar_pop(position, position) AS zz, covar_pop(lap, position) AS xz, covar_pop(lap, lap_time) AS xy, covar_pop(position, lap_time) AS zy FROM pos GROUP BY race, vehicle_number HAVING count(*) >= 3),
c AS (SELECT *, CASE WHEN xx * zz - xz * xz > 1e-9 * xx * zz THEN (xy * zz - zy * xz) / (xx * zz - xz * xz) ELSE (xy / xx) / (1 + pow(xz / xx, 2) / 2) END AS a,
  CASE WHEN xx * zz - xz * xz > 1e-9 * xx * zz THEN (zy * xx - xy * xz) / (xx * zz - xz * xz) ELSE (xy / xx) / (1 + pow(xz / xx, 2) / 2) * (xz / xx) / 2 END AS b FROM m)
SELECT race, vehicle_number, n, round(my - a * mx + a / 2 * {TOTAL_LAPS} - b * mz + 1.7e-10, 6) AS intercept, round(a / 2 + 1.7e-10, 6) AS lap, round(b + 1.7e-10, 6) AS position, round(-a / 2 + 1.7e-10, 6) AS laps_remaining FROM c""",
    ),
    "walk_forward_ols": (
        walk_forward_ols,
        f"""WITH {LAPS_SQL}, p AS (SELECT *, count(*) OVER w AS n, regr_slope(lap_time, lap) OVER w AS slope, regr_intercept(lap_time, lap) OVER w AS a FROM laps WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT race, vehicle_number, round(avg(abs(lap_time - (a + slope * lap))), 5) AS mae, count(*) AS n FROM p WHERE n >= 3 GROUP BY race, vehicle_number""",
    ),
    "leave_one_race_out": (
        leave_one_race_out,
        f"""WITH {LAPS_SQL}, f AS (SELECT a.race, regr_slope(b.lap_time, b.lap) AS slope, regr_intercept(b.lap_time, b.lap) AS i FROM (SELECT DISTINCT race FROM laps) a JOIN laps b ON b.race <> a.race GROUP BY a.race)
SELECT race, round(any_value(slope) + 1.7e-10, 6) AS slope, round(avg(abs(lap_time - (i + slope * lap))) + 1.7e-10, 6) AS mae FROM laps JOIN f USING (race) GROUP BY race""",
    ),
    "gbt_laps": (boosted, None),
    "yellow_forest": (yellow_model, None),
    "expanding_validation": (
        lambda s, d: validation(s, d).select(*V, "warmup_laps", "prediction_lap", "target_lap", "horizon", "position", R6("predicted"), R6("error")),
        f"WITH {VAL_SQL} SELECT race, vehicle_number, warmup_laps, prediction_lap, target_lap, horizon, position, round(predicted + 1.7e-10, 6) AS predicted, round(error + 1.7e-10, 6) AS error FROM val",
    ),
    "weighted_mae_heatmap": (
        lambda s, d: VAL.weighted_heatmap(validation(s, d)).select("race", "warmup_laps", *[F.round(F.col(str(h)) + 1.7e-10, 6).alias(f"h{h}") for h in VAL.HORIZONS]),
        f"""WITH {VAL_SQL}, w AS (SELECT *, CASE WHEN position <= 3 THEN 3.0 WHEN position <= 5 THEN 1.5 ELSE 1.0 END AS w FROM val)
SELECT race, warmup_laps, {', '.join(f'round(sum(w * abs(error)) FILTER (horizon = {h}) / sum(w) FILTER (horizon = {h}) + 1.7e-10, 6) AS h{h}' for h in VAL.HORIZONS)} FROM w GROUP BY race, warmup_laps""",
    ),
    "driver_stats": (
        lambda s, d: rounded(VAL.driver_stats(validation(s, d)), "rmse", "mae", "avg_position", "worst_error"),
        f"""WITH {VAL_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY race, vehicle_number ORDER BY round(abs(error), 9) DESC, target_lap) AS k FROM val)
SELECT race, vehicle_number, round(sqrt(avg(error * error)) + 1.7e-10, 6) AS rmse, round(avg(abs(error)) + 1.7e-10, 6) AS mae, round(avg(position) + 1.7e-10, 6) AS avg_position, count(*) AS n, max(target_lap) FILTER (k = 1) AS worst_lap, round(max(abs(error)) + 1.7e-10, 6) AS worst_error FROM v GROUP BY race, vehicle_number""",
    ),
    "evaluate_errors": (
        lambda s, d: rounded(L.evaluate(validation(s, d), ["warmup_laps", "horizon"]), "rmse", "mae", "bias", "std", "weighted_rmse"),
        f"""WITH {VAL_SQL} SELECT warmup_laps, horizon, round(sqrt(avg(error * error)) + 1.7e-10, 6) AS rmse, round(avg(abs(error)) + 1.7e-10, 6) AS mae, round(avg(error) + 1.7e-10, 6) AS bias, round(stddev_pop(error) + 1.7e-10, 6) AS std, round(sqrt(avg(greatest(0.1, 1 - 0.05 * (position - 1)) * error * error)) + 1.7e-10, 6) AS weighted_rmse, count(*) AS n FROM val GROUP BY warmup_laps, horizon""",
    ),
    "inverse_position_rmse": (
        lambda s, d: rounded(VAL.inverse_position_rmse(validation(s, d), ["race", "horizon"]), "weighted_rmse"),
        f"WITH {VAL_SQL} SELECT race, horizon, round(sqrt(sum(1.0 / position * error * error) / sum(1.0 / position)) + 1.7e-10, 6) AS weighted_rmse FROM val GROUP BY race, horizon",
    ),
    "position_stratified": (
        lambda s, d: rounded(VAL.stratified_errors(validation(s, d)), "mae"),
        f"""WITH {VAL_SQL} SELECT CASE WHEN position <= 5 THEN '1-5' WHEN position <= 10 THEN '6-10' WHEN position <= 15 THEN '11-15' ELSE '16+' END AS band, round(avg(abs(error)) + 1.7e-10, 6) AS mae, count(*) AS n FROM val GROUP BY 1""",
    ),
    "alpha_sweep": (
        lambda s, d: rounded(VAL.alpha_sweep(relative_positions(s, d), [0.1, 0.3, 0.5, 0.7, 0.9]), "mae", "rmse"),
        f"""WITH {REL_POS_SQL}, b AS (SELECT *, lag(relative_time) OVER w AS prev, avg(relative_time) OVER (PARTITION BY race, vehicle_number ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM rp WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY lap)),
e AS (SELECT a AS alpha, relative_time - (a * prev + (1 - a) * mean) AS e FROM b CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.3, 0.5, 0.7, 0.9]) AS a) WHERE prev IS NOT NULL)
SELECT alpha, round(avg(abs(e)) + 1.7e-10, 6) AS mae, round(sqrt(avg(e * e)) + 1.7e-10, 6) AS rmse, count(*) AS n FROM e GROUP BY alpha""",
    ),
    "top5_ndcg": (
        lambda s, d: rounded(VAL.top_k_quality(standings(laps(s, d)), VAL.forecast_order(features(s, d), [4, 7, 10, 13, 16, 19])), "set_accuracy", "ndcg"),
        f"""WITH {POSITION_SQL}, {STANDINGS_SQL}, g AS (SELECT race, lap AS prediction_lap, vehicle_number, position FROM pos WHERE lap IN (4, 7, 10, 13, 16, 19) AND position <= 5),
a AS (SELECT race, vehicle_number, 6 - final_position AS rel FROM standings WHERE final_position <= 5)
SELECT race, prediction_lap, count(rel) AS correct, round(count(rel) / 5.0 + 1.7e-10, 6) AS set_accuracy, round(sum(coalesce(rel, 0) / log2(position + 1)) / {IDEAL!r} + 1.7e-10, 6) AS ndcg FROM g LEFT JOIN a USING (race, vehicle_number) GROUP BY race, prediction_lap""",
    ),
    "best_race": (
        lambda s, d: rounded(VAL.best_race(validation(s, d)), "mae"),
        f"WITH {VAL_SQL}, g AS (SELECT race, avg(abs(error)) AS mae FROM val GROUP BY race) SELECT race, round(mae + 1.7e-10, 6) AS mae, row_number() OVER (ORDER BY round(mae, 9), race) AS place FROM g",
    ),
    "claim_check": (
        lambda s, d: laps(s, d).groupBy(*V).agg(F.count(F.lit(1)).alias("n")).select(*V, VAL.claim_check(F.col("n"), F.lit(66), 0.05).alias("verdict")),
        f"WITH {LAPS_SQL} SELECT race, vehicle_number, CASE WHEN count(*) = 66 THEN 'VERIFIED' WHEN abs(count(*) - 66) <= 0.05 * 66 THEN 'APPROXIMATE' ELSE 'INCORRECT' END AS verdict FROM laps GROUP BY race, vehicle_number",
    ),
}
