"""Queries of the technique metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.operators import metrics as M
from lapforge.operators.compare import standings
from lapforge.plans.adapter import LAPS_SQL, TELEMETRY_SQL, laps, telemetry
from lapforge.plans.race_queries import R6

V = ["race", "vehicle_number"]
BOTH_SQL = LAPS_SQL + "," + TELEMETRY_SQL

V1_SQL = """
cn AS (SELECT *, row_number() OVER (PARTITION BY race, vehicle_number ORDER BY lap) AS rn FROM laps),
ci AS (SELECT *, median(lap_time) OVER w AS m, count(*) OVER w AS k FROM cn WHERE rn > 1 WINDOW w AS (PARTITION BY race, vehicle_number)),
c1 AS (SELECT race, vehicle_number, count(*) AS n_laps, CASE WHEN count(*) >= 3 THEN stddev_pop(lap_time) END AS std_dev,
         CASE WHEN count(*) >= 3 THEN stddev_pop(lap_time) / avg(lap_time) END AS cv, CASE WHEN count(*) >= 3 THEN max(lap_time) - min(lap_time) END AS spread,
         CASE WHEN count(*) >= 3 THEN avg(lap_time) END AS mean
       FROM ci WHERE k >= 3 AND lap_time < m + 10 GROUP BY race, vehicle_number)"""
COAST_SQL = """
co AS (SELECT race, vehicle_number, 100.0 * count(*) FILTER (throttle <= 5 AND brake <= 2) / count(*) AS coasting_pct,
        100.0 * count(*) FILTER (throttle > 5 AND brake > 2) / count(*) AS overlap_pct,
        100.0 * count(*) FILTER (throttle > 5) / count(*) AS throttle_pct, 100.0 * count(*) FILTER (brake > 2) / count(*) AS brake_pct
      FROM telemetry GROUP BY race, vehicle_number)"""
STEER_SQL = """
sr AS (SELECT race, vehicle_number, n, CASE WHEN ts_us - lag(ts_us) OVER w > 0 THEN (steering - lag(steering) OVER w) / ((ts_us - lag(ts_us) OVER w) / 1e6)
        WHEN lag(ts_us) OVER w IS NOT NULL THEN 0.0 END AS rate FROM telemetry WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY n)),
sj AS (SELECT *, abs(rate - lag(rate) OVER (PARTITION BY race, vehicle_number ORDER BY n)) AS jerk FROM sr),
ss AS (SELECT race, vehicle_number, avg(abs(rate)) AS mean_rate, avg(jerk) AS mean_jerk, greatest(0.0, 100 - avg(jerk) / 10) AS smoothness FROM sj GROUP BY race, vehicle_number)"""
SCORES_SQL = (
    BOTH_SQL + "," + V1_SQL + "," + COAST_SQL + "," + STEER_SQL
    + """,
scores AS (SELECT c1.race, c1.vehicle_number, least(greatest(100 - cv * 100, 0.0), 100.0) AS consistency_score,
  least(greatest(100 - coasting_pct, 0.0), 100.0) AS pedal_score, least(greatest(smoothness, 0.0), 100.0) AS steering_score
  FROM c1 LEFT JOIN co USING (race, vehicle_number) LEFT JOIN ss USING (race, vehicle_number))"""
)
ISLAND_SQL = """
b0 AS (SELECT race, vehicle_number, n, brake, brake > 10 AS ison FROM telemetry),
b1 AS (SELECT *, ison AND NOT coalesce(lag(ison) OVER w, true) AS beg, lead(ison) OVER w AS nxt, lead(ison AND NOT false) OVER w AS x FROM b0 WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY n)),
b2 AS (SELECT *, coalesce(lead(beg) OVER (PARTITION BY race, vehicle_number ORDER BY n), false) AS bef FROM b1),
b3 AS (SELECT *, sum(CAST(bef AS INT)) OVER (PARTITION BY race, vehicle_number ORDER BY n) AS ev FROM b2),
b4 AS (SELECT race, vehicle_number, ev, max(brake) FILTER (bef OR (ison AND (nxt IS NULL OR nxt))) AS peak, bool_or(ison AND nxt IS NULL) AS op FROM b3 WHERE ev > 0 GROUP BY race, vehicle_number, ev),
isl AS (SELECT race, vehicle_number, count(*) AS n_peaks, CASE WHEN count(*) >= 3 THEN 100 * stddev_pop(peak) / avg(peak) END AS peak_cv_pct
  FROM b4 WHERE NOT op AND peak > 15 GROUP BY race, vehicle_number)"""
THROTTLE_SQL = """
th AS (SELECT *, lag(throttle) OVER (PARTITION BY race, vehicle_number ORDER BY n) AS p FROM telemetry),
tc AS (SELECT race, vehicle_number, count(*) FILTER (p > 20 AND throttle > 20 AND p - throttle > 5) / CAST(greatest(count(*) FILTER (p < 20 AND throttle >= 20), 1) AS DOUBLE) AS lift_offs,
  100.0 * count(*) FILTER (throttle >= 90) / count(*) AS full_pct, CASE WHEN count(*) FILTER (throttle > 20) >= 11 THEN corr(throttle, accx) FILTER (throttle > 20) END AS throttle_accel_corr FROM th GROUP BY race, vehicle_number)"""
G_SQL = """
gf AS (SELECT race, vehicle_number, avg(sqrt(accx * accx + accy * accy)) AS mean_g, max(sqrt(accx * accx + accy * accy)) AS max_g, avg(abs(accx)) AS mean_abs_x, avg(abs(accy)) AS mean_abs_y FROM telemetry GROUP BY race, vehicle_number)"""


def rounded(df, *columns):
    return df.select(*[c if c not in columns else R6(c) for c in df.columns])


def r(*columns):
    return ", ".join(f"round({c} + 1.7e-10, 6) AS {c}" for c in columns)


SCORES = ["consistency_score", "pedal_score", "steering_score"]


def scores(s, d):
    return M.driver_scores(telemetry(s, d), laps(s, d))


QUERIES = {
    "consistency_v1": (
        lambda s, d: rounded(M.consistency_by_position(laps(s, d)), "std_dev", "cv", "spread", "mean"),
        f"WITH {LAPS_SQL}, {V1_SQL} SELECT race, vehicle_number, n_laps, {r('std_dev', 'cv', 'spread', 'mean')} FROM c1",
    ),
    "consistency_v2": (
        lambda s, d: rounded(M.consistency_after_laps(laps(s, d)), "std_dev", "cv_pct"),
        f"""WITH {LAPS_SQL} SELECT race, vehicle_number, round(stddev_samp(lap_time) + 1.7e-10, 6) AS std_dev, round(100 * stddev_samp(lap_time) / avg(lap_time) + 1.7e-10, 6) AS cv_pct,
count(*) AS n_laps FROM laps WHERE lap > 2 GROUP BY race, vehicle_number""",
    ),
    "coasting_v1": (
        lambda s, d: rounded(M.coasting_shares(telemetry(s, d)), "coasting_pct", "overlap_pct", "throttle_pct", "brake_pct"),
        f"WITH {TELEMETRY_SQL}, {COAST_SQL} SELECT race, vehicle_number, {r('coasting_pct', 'overlap_pct', 'throttle_pct', 'brake_pct')} FROM co",
    ),
    "coasting_v2": (
        lambda s, d: rounded(M.coasting_below(telemetry(s, d), 30.0, 30.0), "coasting_pct"),
        f"WITH {TELEMETRY_SQL} SELECT race, vehicle_number, round(100.0 * count(*) FILTER (throttle < 30 AND brake < 30) / count(*) + 1.7e-10, 6) AS coasting_pct FROM telemetry GROUP BY race, vehicle_number",
    ),
    "braking_summary": (
        lambda s, d: rounded(M.braking_summary(telemetry(s, d)), "mean_pressure"),
        f"""WITH {TELEMETRY_SQL}, b AS (SELECT *, lag(brake > 20) OVER (PARTITION BY race, vehicle_number ORDER BY n) AS p FROM telemetry)
SELECT race, vehicle_number, max(brake) AS max_pressure, round(avg(brake) FILTER (brake > 20) + 1.7e-10, 6) AS mean_pressure, count(*) FILTER (brake > 20 AND NOT p) AS n_events FROM b GROUP BY race, vehicle_number""",
    ),
    "brake_pulses": (
        lambda s, d: M.brake_pulses(telemetry(s, d)),
        f"""WITH RECURSIVE {TELEMETRY_SQL}, a(race, vehicle_number, n, ison, mark, pulses) AS (
SELECT race, vehicle_number, n, false, CAST(0 AS DOUBLE), CAST(0 AS BIGINT) FROM telemetry WHERE n = 1
UNION ALL
SELECT t.race, t.vehicle_number, t.n, t.brake > 20,
  CASE WHEN t.brake <= 20 THEN a.mark WHEN NOT a.ison THEN t.brake WHEN t.brake < 0.5 * a.mark THEN t.brake WHEN t.brake > 1.3 * a.mark THEN t.brake ELSE greatest(a.mark, t.brake) END,
  a.pulses + CASE WHEN a.ison AND t.brake > 20 AND t.brake >= 0.5 * a.mark AND t.brake > 1.3 * a.mark THEN 1 ELSE 0 END
FROM a JOIN telemetry t ON t.vehicle_number = a.vehicle_number AND t.n = a.n + 1)
SELECT race, vehicle_number, max(pulses) AS n_pulses FROM a GROUP BY race, vehicle_number""",
    ),
    "brake_islands": (
        lambda s, d: rounded(M.brake_islands(telemetry(s, d)), "peak_cv_pct"),
        f"WITH {TELEMETRY_SQL}, {ISLAND_SQL} SELECT race, vehicle_number, n_peaks, round(peak_cv_pct + 1.7e-10, 6) AS peak_cv_pct FROM isl",
    ),
    "lift_offs": (
        lambda s, d: rounded(M.throttle_control(telemetry(s, d)), "lift_offs", "full_pct", "throttle_accel_corr"),
        f"WITH {TELEMETRY_SQL}, {THROTTLE_SQL} SELECT race, vehicle_number, {r('lift_offs', 'full_pct', 'throttle_accel_corr')} FROM tc",
    ),
    "throttle_lookahead": (
        lambda s, d: M.throttle_lookahead(telemetry(s, d)).select(*V, "n", R6("seconds_to_full")),
        f"""WITH {TELEMETRY_SQL} SELECT race, vehicle_number, n, round((min(CASE WHEN throttle >= 95 THEN ts_us END) OVER (PARTITION BY race, vehicle_number ORDER BY n ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING) - ts_us) / 1e6 + 1.7e-10, 6) AS seconds_to_full FROM telemetry""",
    ),
    "centred_mean": (
        lambda s, d: M.centred_mean(telemetry(s, d), "speed").select(*V, "n", R6("speed_smooth")),
        f"""WITH {TELEMETRY_SQL} SELECT race, vehicle_number, n, round(CASE WHEN count(speed) OVER w = 5 THEN avg(speed) OVER w ELSE speed END + 1.7e-10, 6) AS speed_smooth FROM telemetry
WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    ),
    "steering_jerk": (
        lambda s, d: rounded(M.steering_smoothness(telemetry(s, d)), "mean_rate", "mean_jerk", "smoothness"),
        f"WITH {TELEMETRY_SQL}, {STEER_SQL} SELECT race, vehicle_number, {r('mean_rate', 'mean_jerk', 'smoothness')} FROM ss",
    ),
    "g_force": (
        lambda s, d: rounded(M.g_force(telemetry(s, d)), "mean_g", "max_g", "mean_abs_x", "mean_abs_y"),
        f"WITH {TELEMETRY_SQL}, {G_SQL} SELECT race, vehicle_number, {r('mean_g', 'max_g', 'mean_abs_x', 'mean_abs_y')} FROM gf",
    ),
    "lap_time_from_samples": (
        lambda s, d: rounded(M.lap_time_from_samples(telemetry(s, d), 100_000.0, 800_000.0, 9), "lap_time"),
        f"""WITH {TELEMETRY_SQL}, g AS (SELECT race, vehicle_number, lap, (max(ts_us) - min(ts_us)) / 1e6 AS lap_time, count(*) AS n FROM telemetry GROUP BY race, vehicle_number, lap)
SELECT race, vehicle_number, lap, n, round(lap_time + 1.7e-10, 6) AS lap_time FROM g WHERE n > 9 AND lap_time > 100000 AND lap_time < 800000""",
    ),
    "all_metrics": (
        lambda s, d: rounded(M.all_metrics(telemetry(s, d)).select(*V, "coasting_pct", "peak_cv_pct", "lift_offs", "full_pct", "mean_g"), "coasting_pct", "peak_cv_pct", "lift_offs", "full_pct", "mean_g"),
        f"""WITH {TELEMETRY_SQL}, {ISLAND_SQL}, {THROTTLE_SQL}, {G_SQL}, c AS (SELECT race, vehicle_number, 100.0 * count(*) FILTER (throttle < 5 AND brake < 5) / count(*) AS coasting_pct FROM telemetry GROUP BY race, vehicle_number)
SELECT race, vehicle_number, {r('coasting_pct', 'peak_cv_pct', 'lift_offs', 'full_pct', 'mean_g')} FROM c LEFT JOIN isl USING (race, vehicle_number) LEFT JOIN tc USING (race, vehicle_number) LEFT JOIN gf USING (race, vehicle_number)""",
    ),
    "driver_scores": (lambda s, d: rounded(scores(s, d), *SCORES), f"WITH {SCORES_SQL} SELECT race, vehicle_number, {r(*SCORES)} FROM scores"),
    "compare_pairs": (
        lambda s, d: M.compare_pairs(rounded(scores(s, d), *SCORES), SCORES),
        f"""WITH {SCORES_SQL}, q AS (SELECT race, vehicle_number, {r(*SCORES)} FROM scores)
SELECT a.race, a.vehicle_number AS vehicle_a, b.vehicle_number AS vehicle_b,
CAST({' + '.join(f'coalesce(sign(a.{c} - b.{c}), NULL)' for c in SCORES)} AS DOUBLE) AS net_wins FROM q a JOIN q b ON a.race = b.race AND a.vehicle_number < b.vehicle_number""",
    ),
    "winner_direction": (
        lambda s, d: M.winner_direction(rounded(scores(s, d), *SCORES), standings(laps(s, d)), SCORES),
        f"""WITH {SCORES_SQL}, q AS (SELECT race, vehicle_number, {r(*SCORES)} FROM scores),
g AS (SELECT race, vehicle_number, max(lap) AS m, sum(lap_time) AS t FROM laps GROUP BY race, vehicle_number),
st AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY m DESC, t, vehicle_number) AS p FROM g),
j AS (SELECT q.*, p FROM q JOIN st USING (race, vehicle_number)),
e AS (SELECT race, {', '.join(f'arg_min({c}, p) AS f{i}, arg_max({c}, p) AS l{i}' for i, c in enumerate(SCORES))} FROM j GROUP BY race),
w AS (SELECT race, CAST({' + '.join(f'CASE WHEN f{i} > l{i} THEN 1 ELSE 0 END' for i in range(3))} AS BIGINT) AS wins FROM e)
SELECT race, wins, CASE WHEN wins * 2 > 3 THEN 'SUCCESS' ELSE 'MIXED' END AS verdict FROM w""",
    ),
    "spearman": (
        lambda s, d: rounded(M.spearman(telemetry(s, d), "throttle", "brake", ["race"]), "rho", "t"),
        f"""WITH {TELEMETRY_SQL}, k AS (SELECT race, rank() OVER (PARTITION BY race ORDER BY throttle) + (count(*) OVER (PARTITION BY race, throttle) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY race ORDER BY brake) + (count(*) OVER (PARTITION BY race, brake) - 1) / 2.0 AS y FROM telemetry),
g AS (SELECT race, corr(x, y) AS rho, count(*) AS n FROM k GROUP BY race)
SELECT race, n, round(rho + 1.7e-10, 6) AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)) + 1.7e-10, 6) AS t FROM g""",
    ),
    "variance_ratio": (
        lambda s, d: rounded(M.variance_ratio(telemetry(s, d).select(*V, "throttle", "brake", "accx"), ["throttle", "brake", "accx"]), "within", "across", "ratio"),
        f"""WITH {TELEMETRY_SQL}, u AS (SELECT race, vehicle_number, unnest([{{'m': 'throttle', 'x': throttle}}, {{'m': 'brake', 'x': brake}}, {{'m': 'accx', 'x': accx}}]) AS u FROM telemetry),
e AS (SELECT race, u.m AS metric, vehicle_number, avg(u.x) AS mean, stddev_samp(u.x) AS std FROM u GROUP BY race, u.m, vehicle_number),
g AS (SELECT race, metric, avg(std) AS within, stddev_samp(mean) AS across FROM e GROUP BY race, metric)
SELECT race, metric, {r('within', 'across')}, round(across / within + 1.7e-10, 6) AS ratio, CASE WHEN across / within > 1.5 THEN 'PROFILE' WHEN across / within < 0.7 THEN 'STATE' ELSE 'MIXED' END AS kind FROM g""",
    ),
}
