"""Queries of the validation of technique metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.operators import metric_validation as MV
from lapforge.operators import metrics as M
from lapforge.operators.compare import standings
from lapforge.plans.adapter import LAPS_SQL, TELEMETRY_SQL, laps, telemetry
from lapforge.plans.compare_queries import PER_LAP_SQL, STANDINGS_SQL, per_lap_metrics
from lapforge.plans.metric_queries import COAST_SQL, STEER_SQL, V1_SQL, V, r, rounded

SIGNS = {"coasting_pct": 1, "brake_level": 1, "mean_g": -1, "lift_offs": 1, "full_pct": -1}
DIRECTIONS = {"std_dev": "lower", "coasting_pct": "lower", "pulses_per_event": "lower", "median_time_to_full": "lower", "mean_g": "higher"}
# slow places of any depth and closeness, so that SQL can say them
LOOSE = {"apart": 1, "least_rows": 20}

TIMING_SQL = """
ts0 AS (SELECT *, row_number() OVER (PARTITION BY race, vehicle_number ORDER BY ts_us, n) AS i, count(*) OVER (PARTITION BY race, vehicle_number) AS k FROM telemetry),
ts1 AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(speed) OVER w ELSE speed END AS soft FROM ts0 WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
ts2 AS (SELECT *, max(soft) OVER g AS hi, max(soft) OVER g - min(soft) OVER g AS span, round(soft, 9) AS level FROM ts1 WINDOW g AS (PARTITION BY race, vehicle_number)),
ts3 AS (SELECT *, coalesce(soft <> lag(soft) OVER (PARTITION BY race, vehicle_number ORDER BY i), true) AS fresh FROM ts2),
ts4 AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY race, vehicle_number ORDER BY i) AS run FROM ts3),
ts5 AS (SELECT race, vehicle_number, run, any_value(soft) AS soft, any_value(hi) AS hi, any_value(span) AS span, any_value(k) AS k, (min(i) + max(i)) // 2 AS mid FROM ts4 GROUP BY race, vehicle_number, run),
ts6 AS (SELECT *, lag(soft) OVER v AS p, lead(soft) OVER v AS q FROM ts5 WINDOW v AS (PARTITION BY race, vehicle_number ORDER BY run)),
ts7 AS (SELECT race, vehicle_number, mid FROM ts6 WHERE soft < p AND soft < q AND span >= 10 AND -soft >= -hi + 0.3 * span AND k >= 20),
ts8 AS (SELECT *, min(CASE WHEN throttle >= 95 THEN i END) OVER (PARTITION BY race, vehicle_number ORDER BY i ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING) AS j FROM ts0),
ts9 AS (SELECT ts8.race, ts8.vehicle_number, (b.ts_us - ts8.ts_us) / 1e6 AS wait FROM ts7 JOIN ts8 ON ts8.race = ts7.race AND ts8.vehicle_number = ts7.vehicle_number AND ts8.i = ts7.mid JOIN ts0 b ON b.race = ts8.race AND b.vehicle_number = ts8.vehicle_number AND b.i = ts8.j),
tw AS (SELECT race, vehicle_number, avg(wait) AS mean_time_to_full, median(wait) AS median_time_to_full, count(*) AS n_corners FROM ts9 WHERE wait > 0 AND wait < 10 GROUP BY race, vehicle_number),
timing AS (SELECT a.race, a.vehicle_number, a.full_throttle_pct, mean_time_to_full, median_time_to_full, CASE WHEN k >= 20 THEN coalesce(n_corners, 0) END AS n_corners
  FROM (SELECT race, vehicle_number, count(*) AS k, 100.0 * count(*) FILTER (throttle >= 95) / count(throttle) AS full_throttle_pct FROM telemetry GROUP BY race, vehicle_number) a LEFT JOIN tw ON tw.race = a.race AND tw.vehicle_number = a.vehicle_number)"""
# pulses by the automaton, one step a sample
PULSES_SQL = """
pulse(race, vehicle_number, n, ison, mark, pulses) AS (
SELECT race, vehicle_number, n, false, CAST(0 AS DOUBLE), CAST(0 AS BIGINT) FROM telemetry WHERE n = 1
UNION ALL
SELECT t.race, t.vehicle_number, t.n, t.brake > 20,
  CASE WHEN t.brake <= 20 THEN a.mark WHEN NOT a.ison THEN t.brake WHEN t.brake < 0.5 * a.mark THEN t.brake WHEN t.brake > 1.3 * a.mark THEN t.brake ELSE greatest(a.mark, t.brake) END,
  a.pulses + CASE WHEN a.ison AND t.brake > 20 AND t.brake >= 0.5 * a.mark AND t.brake > 1.3 * a.mark THEN 1 ELSE 0 END
FROM pulse a JOIN telemetry t ON t.vehicle_number = a.vehicle_number AND t.n = a.n + 1),
bw AS (SELECT *, brake > 20 AND NOT coalesce(lag(brake > 20) OVER (PARTITION BY race, vehicle_number ORDER BY n), true) AS begins FROM telemetry),
be AS (SELECT race, vehicle_number, count(*) FILTER (begins) AS n_events FROM bw GROUP BY race, vehicle_number),
ppe AS (SELECT be.race, be.vehicle_number, m / nullif(CAST(n_events AS DOUBLE), 0) AS pulses_per_event FROM be JOIN (SELECT vehicle_number, max(pulses) AS m FROM pulse GROUP BY vehicle_number) p USING (vehicle_number))"""
SUMMARY_SQL = (
    LAPS_SQL + "," + TELEMETRY_SQL + "," + V1_SQL + "," + COAST_SQL + "," + STEER_SQL + "," + TIMING_SQL + "," + PULSES_SQL
    + """,
summary AS (SELECT co.race, co.vehicle_number, 100 - std_dev * 20 AS consistency_score, throttle_pct AS efficiency_score, CASE WHEN pulses_per_event IS NOT NULL THEN greatest(0.0, 50 - pulses_per_event * 50) END AS braking_score,
  full_throttle_pct AS throttle_score, CASE WHEN median_time_to_full IS NOT NULL THEN greatest(0.0, 100 - (median_time_to_full - 0.2) * 55.5) END AS throttle_timing_score, smoothness AS smoothness_score,
  std_dev, coasting_pct, pulses_per_event, median_time_to_full
  FROM co LEFT JOIN c1 USING (race, vehicle_number) LEFT JOIN ss USING (race, vehicle_number) LEFT JOIN timing USING (race, vehicle_number) LEFT JOIN ppe USING (race, vehicle_number))"""
)
# Student's t for whole degrees of freedom by its finite series in the angle
P_SQL = """CASE WHEN n <= 2 THEN NULL WHEN abs(rho) >= 1 THEN 0.0 WHEN (n - 2) % 2 = 0
  THEN 1 - sin(th) * list_sum([gamma(j + 0.5) / (sqrt(pi()) * gamma(j + 1)) * pow(cos(th), 2 * j) FOR j IN generate_series(0, (n - 4) // 2)])
  WHEN n = 3 THEN 1 - 2 / pi() * th
  ELSE 1 - 2 / pi() * (th + sin(th) * cos(th) * list_sum([sqrt(pi()) / 2 * gamma(j + 1) / gamma(j + 1.5) * pow(cos(th), 2 * j) FOR j IN generate_series(0, (n - 5) // 2)])) END"""
TESTS_SQL = (
    LAPS_SQL + "," + PER_LAP_SQL
    + f""",
pm AS (SELECT p.*, lap_time FROM per_lap p JOIN laps l ON l.race = p.race AND l.vehicle_number = p.vehicle_number AND l.lap = p.lap),
pu AS (SELECT race, vehicle_number, lap_time, unnest([{', '.join(f"{{'m': '{m}', 'x': {m}, 'e': {e}}}" for m, e in SIGNS.items())}]) AS u FROM pm),
pe AS (SELECT race, u.m AS metric, any_value(u.e) AS expected, vehicle_number, count(*) AS n, corr(u.x, lap_time) AS r, round(avg(u.x), 9) AS x FROM pu GROUP BY race, u.m, vehicle_number),
pp AS (SELECT race, vehicle_number, round(avg(lap_time), 9) AS pace FROM pm GROUP BY race, vehicle_number),
pw AS (SELECT race, metric, avg(r) FILTER (n >= 5 AND NOT isnan(r)) AS mean_r, count(r) FILTER (n >= 5 AND NOT isnan(r)) AS n_within, any_value(expected) AS expected, count(*) FILTER (n >= 5) AS eligible FROM pe GROUP BY race, metric),
pr AS (SELECT race, metric, rank() OVER (PARTITION BY race, metric ORDER BY x) + (count(*) OVER (PARTITION BY race, metric, x) - 1) / 2.0 AS kx, rank() OVER (PARTITION BY race, metric ORDER BY pace) + (count(*) OVER (PARTITION BY race, metric, pace) - 1) / 2.0 AS ky FROM pe JOIN pp USING (race, vehicle_number)),
pc AS (SELECT race, metric, corr(kx, ky) AS rho, count(*) AS n, atan(abs(corr(kx, ky)) / sqrt(1 - pow(corr(kx, ky), 2))) AS th FROM pr GROUP BY race, metric HAVING count(*) >= 5),
tests AS (SELECT race, metric, mean_r, n_within, rho, n AS n_across, {P_SQL} AS p_value, CASE WHEN mean_r IS NOT NULL THEN (CASE WHEN mean_r > 0 THEN 1 ELSE -1 END) = expected END AS sign_ok FROM pw JOIN pc USING (race, metric))"""
)


def timing(s, d):
    return MV.throttle_timing(telemetry(s, d), **LOOSE)


def summary(s, d):
    return MV.summary_scores(telemetry(s, d), laps(s, d), **LOOSE)


def directions(s, d):
    t = telemetry(s, d)
    pulses = M.brake_pulses(t).join(M.braking_summary(t), V).select(*V, (F.col("n_pulses") / F.nullif(F.col("n_events"), F.lit(0))).alias("pulses_per_event"))
    parts = M.consistency_by_position(laps(s, d)).select(*V, "std_dev").join(M.coasting_shares(t).select(*V, "coasting_pct"), V).join(pulses, V, "left")
    parts = parts.join(timing(s, d).select(*V, "median_time_to_full"), V, "left").join(M.g_force(t).select(*V, "mean_g"), V, "left")
    return MV.direction_check(rounded(parts, *DIRECTIONS), standings(laps(s, d)), DIRECTIONS)


def correlation_tests(s, d):
    per_lap = per_lap_metrics(s, d).join(laps(s, d).select(*V, "lap", "lap_time"), [*V, "lap"])
    return MV.correlation_tests(per_lap.select(*V, "lap_time", *SIGNS), SIGNS)


QUERIES = {
    "throttle_timing": (lambda s, d: rounded(timing(s, d), "full_throttle_pct", "mean_time_to_full", "median_time_to_full"), f"WITH {TELEMETRY_SQL}, {TIMING_SQL} SELECT race, vehicle_number, {r('full_throttle_pct', 'mean_time_to_full', 'median_time_to_full')}, n_corners FROM timing"),
    "summary_scores": (lambda s, d: rounded(summary(s, d), *MV.SCORES), f"WITH RECURSIVE {SUMMARY_SQL} SELECT race, vehicle_number, {r(*MV.SCORES)} FROM summary"),
    "direction_check": (
        directions,
        f"""WITH RECURSIVE {SUMMARY_SQL}, {STANDINGS_SQL}, q AS (SELECT summary.race, summary.vehicle_number, {r('std_dev', 'coasting_pct', 'pulses_per_event', 'median_time_to_full', 'mean_g')} FROM summary JOIN (SELECT race, vehicle_number, avg(sqrt(accx * accx + accy * accy)) AS mean_g FROM telemetry GROUP BY race, vehicle_number) g USING (race, vehicle_number) WHERE EXISTS (SELECT 1 FROM c1 WHERE c1.race = summary.race AND c1.vehicle_number = summary.vehicle_number)),
j AS (SELECT q.*, final_position, min(final_position) OVER (PARTITION BY q.race) AS lo, max(final_position) OVER (PARTITION BY q.race) AS hi FROM q JOIN standings USING (race, vehicle_number)),
w AS (SELECT a.race, {' + '.join(f'coalesce(CAST(a.{c} {"<" if b == "lower" else ">"} b.{c} AS INT), 0)' for c, b in DIRECTIONS.items())} AS wins, {' + '.join(f'CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INT)' for c in DIRECTIONS)} AS n_metrics
FROM j a JOIN j b ON a.race = b.race WHERE a.final_position = a.lo AND b.final_position = b.hi)
SELECT race, CAST(wins AS BIGINT) AS wins, CAST(n_metrics AS BIGINT) AS n_metrics, CASE WHEN wins >= 4 THEN 'SUCCESS' WHEN wins = 3 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM w""",
    ),
    "correlation_tests": (
        lambda s, d: rounded(correlation_tests(s, d), "mean_r", "rho", "p_value"),
        f"WITH {TESTS_SQL} SELECT race, metric, {r('mean_r', 'rho', 'p_value')}, CASE WHEN eligible > 0 THEN n_within END AS n_within, n_across, sign_ok, p_value < 0.05 AS significant FROM tests JOIN (SELECT race, metric, eligible FROM pw) USING (race, metric)",
    ),
    "metrics_generalise": (
        lambda s, d: MV.generalisation(correlation_tests(s, d)),
        f"""WITH {TESTS_SQL}, g AS (SELECT race, count(*) FILTER (sign_ok) AS ok, count(*) FILTER (p_value < 0.05) AS sig FROM tests GROUP BY race)
SELECT race, ok AS signs_ok, sig AS n_significant, CASE WHEN ok >= 3 AND sig >= 2 THEN 'PASS' WHEN ok >= 2 AND sig >= 1 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM g""",
    ),
}
