"""Queries of error and quality reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.operators import error_reports as ER
from lapforge.operators import models as L
from lapforge.operators import quality as Q
from lapforge.operators import race as R
from lapforge.operators.compare import standings
from lapforge.plans.adapter import LAPS_SQL, TELEMETRY_SQL, laps, telemetry
from lapforge.plans.compare_queries import STANDINGS_SQL
from lapforge.plans.metric_queries import r, rounded
from lapforge.plans.model_queries import REL_POS_SQL, VAL_SQL, relative_positions, validation
from lapforge.plans.quality_queries import RANGES, SIGNALS, V
from lapforge.plans.race_queries import DELTAS_SQL, POSITION_SQL, features, positioned
from lapforge.plans.validation_queries import P_SQL

WINDOW_SQL = (
    REL_POS_SQL
    + """,
we AS (SELECT rp.*, width, lag(relative_time) OVER v AS prev, row_number() OVER v - 1 AS before, CASE width """
    + " ".join(f"WHEN {k} THEN avg(relative_time) OVER (PARTITION BY race, vehicle_number, width ORDER BY lap ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in ER.WIDTHS)
    + f""" END AS mean FROM rp, (SELECT unnest({list(ER.WIDTHS)}) AS width) WINDOW v AS (PARTITION BY race, vehicle_number, width ORDER BY lap)),
werr AS (SELECT *, relative_time - (0.3 * prev + 0.7 * mean) AS error FROM we WHERE before >= width)"""
)
EVENTS_SQL = (
    DELTAS_SQL
    + """,
ef AS (SELECT race, lap, avg(gap_to_ahead) AS avg_gap, coalesce(stddev_samp(gap_to_ahead), 0.0) AS gap_std, count(*) FILTER (is_fighting) AS fighting_count, coalesce(stddev_samp(lap_time), 0.0) AS lap_time_std,
  max(lap_time) - min(lap_time) AS lap_time_spread, max(is_under_yellow) AS yellow FROM deltas GROUP BY race, lap),
ech AS (SELECT race, lap, CAST(coalesce(sum(d), 0) AS BIGINT) AS position_churn FROM (SELECT race, lap, abs(position - lag(position) OVER (PARTITION BY race, vehicle_number ORDER BY lap)) AS d FROM pos) GROUP BY race, lap)"""
)


def window_errors(s, d):
    return ER.window_errors(relative_positions(s, d))


def events(s, d):
    return ER.event_features(features(s, d), R.position_churn(positioned(s, d)), R.yellow_laps(laps(s, d)))


def yellow_probability(s, d):
    """Even races train the forest, odd ones are scored as fields that stand."""
    rows = events(s, d)
    model = L.yellow_forest(rows.filter("race % 2 = 0").withColumn("next_yellow", F.col("next_yellow").cast("double")), ER.EVENT_COLUMNS)
    return ER.yellow_now(model, rows.filter("race % 2 = 1")).select("race", "lap", "next_yellow", "probability")


def overridden(s, d):
    """Final order by time, overridden by the positions on the line in the race's last lap."""
    return ER.override_positions(standings(laps(s, d)), positioned(s, d)).select(*V, "final_position", "overridden")


def issues(s, d):
    t = telemetry(s, d)
    found = ER.race_issues(Q.signal_profile(t, SIGNALS, RANGES, ["race"]), Q.lap_structure(t), Q.timestamp_audit(t, 30_000.0), Q.cross_signal_checks(t), outliers=1.0)
    return found.select("race", F.array_join("issues", ",").alias("issues"))


BEST_SQL = """
SELECT race, {what}, side, place, {r} , n FROM (
SELECT *, 'best' AS side, row_number() OVER (PARTITION BY race ORDER BY round(rmse, 9), {what}) AS place FROM g UNION ALL SELECT *, 'worst', row_number() OVER (PARTITION BY race ORDER BY round(rmse, 9) DESC, {what}) FROM g) WHERE place <= 5"""


def best_sql(what):
    return f"WITH {WINDOW_SQL}, g AS (SELECT race, {what}, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae, avg(position) AS avg_position, count(*) AS n FROM werr WHERE width = 5 GROUP BY race, {what})" + BEST_SQL.format(
        what=what, r=r("rmse", "mae", "avg_position")
    )


QUERIES = {
    "window_sweep": (
        lambda s, d: rounded(L.evaluate(window_errors(s, d), ["width"]).select("width", "rmse", "mae", "n"), "rmse", "mae"),
        f"WITH {WINDOW_SQL} SELECT width, round(sqrt(avg(error * error)) + 1.7e-10, 6) AS rmse, round(avg(abs(error)) + 1.7e-10, 6) AS mae, count(*) AS n FROM werr GROUP BY width",
    ),
    "best_worst_laps": (lambda s, d: rounded(ER.best_and_worst(window_errors(s, d).filter("width = 5"), "lap"), "rmse", "mae", "avg_position"), best_sql("lap")),
    "best_worst_drivers": (lambda s, d: rounded(ER.best_and_worst(window_errors(s, d).filter("width = 5"), "vehicle_number"), "rmse", "mae", "avg_position"), best_sql("vehicle_number")),
    "error_by_position": (
        lambda s, d: rounded(ER.error_by_position(window_errors(s, d).filter("width = 5")), "rho", "t", "p_value"),
        f"""WITH {WINDOW_SQL}, g AS (SELECT race, vehicle_number, round(sqrt(avg(error * error)), 9) AS y, round(avg(position), 9) AS x FROM werr WHERE width = 5 GROUP BY race, vehicle_number),
k AS (SELECT race, rank() OVER (PARTITION BY race ORDER BY x) + (count(*) OVER (PARTITION BY race, x) - 1) / 2.0 AS kx, rank() OVER (PARTITION BY race ORDER BY y) + (count(*) OVER (PARTITION BY race, y) - 1) / 2.0 AS ky FROM g),
c AS (SELECT race, corr(kx, ky) AS rho, count(*) AS n, atan(abs(corr(kx, ky)) * sqrt((count(*) - 2) / (1 - pow(corr(kx, ky), 2))) / sqrt(count(*) - 2)) AS th FROM k GROUP BY race)
SELECT race, n, round(rho + 1.7e-10, 6) AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)) + 1.7e-10, 6) AS t, round({P_SQL} + 1.7e-10, 6) AS p_value FROM c""",
    ),
    "trend_races": (
        lambda s, d: rounded(ER.trend_races(validation(s, d)).select("race", "warmup_trend", "horizon_trend", "score", "mae", "n_points", "place"), "warmup_trend", "horizon_trend", "score", "mae"),
        f"""WITH {VAL_SQL}, g AS (SELECT race, warmup_laps, horizon, round(avg(abs(error)), 9) AS m FROM val GROUP BY race, warmup_laps, horizon),
n AS (SELECT *, count(*) OVER (PARTITION BY race) AS cells FROM g), e AS (SELECT * FROM n WHERE cells >= 10),
a AS (SELECT race, horizon, rank() OVER p + (count(*) OVER (PARTITION BY race, horizon, m) - 1) / 2.0 AS k, rank() OVER q AS kx FROM e WINDOW p AS (PARTITION BY race, horizon ORDER BY m), q AS (PARTITION BY race, horizon ORDER BY warmup_laps)),
b AS (SELECT race, warmup_laps, rank() OVER p + (count(*) OVER (PARTITION BY race, warmup_laps, m) - 1) / 2.0 AS k, rank() OVER q AS kx FROM e WINDOW p AS (PARTITION BY race, warmup_laps ORDER BY m), q AS (PARTITION BY race, warmup_laps ORDER BY horizon)),
wt AS (SELECT race, avg(-c) AS warmup_trend FROM (SELECT race, horizon, corr(kx, k) AS c FROM a GROUP BY race, horizon HAVING count(*) >= 3) GROUP BY race),
ht AS (SELECT race, avg(c) AS horizon_trend FROM (SELECT race, warmup_laps, corr(kx, k) AS c FROM b GROUP BY race, warmup_laps HAVING count(*) >= 3) GROUP BY race),
o AS (SELECT race, avg(abs(error)) AS mae FROM val GROUP BY race), z AS (SELECT race, warmup_trend, horizon_trend, warmup_trend * horizon_trend AS score, mae, cells AS n_points FROM wt JOIN ht USING (race) JOIN o USING (race) JOIN (SELECT DISTINCT race, cells FROM e) USING (race))
SELECT race, {r('warmup_trend', 'horizon_trend', 'score', 'mae')}, n_points, row_number() OVER (ORDER BY round(score, 9) DESC, race) AS place FROM z""",
    ),
    "position_override": (
        overridden,
        f"""WITH {POSITION_SQL}, {STANDINGS_SQL}, l AS (SELECT *, max(lap) OVER (PARTITION BY race) AS last FROM pos), a AS (SELECT race, vehicle_number, position FROM l WHERE lap = last)
SELECT standings.race, standings.vehicle_number, coalesce(a.position, final_position) AS final_position, a.position IS NOT NULL AS overridden FROM standings LEFT JOIN a ON a.race = standings.race AND a.vehicle_number = standings.vehicle_number""",
    ),
    "event_features": (
        lambda s, d: rounded(events(s, d), "avg_gap", "gap_std", "lap_time_std", "lap_time_spread"),
        f"""WITH {EVENTS_SQL} SELECT ef.race, ef.lap, {r('avg_gap', 'gap_std', 'lap_time_std', 'lap_time_spread')}, fighting_count, position_churn, lead(yellow, 1, 0) OVER (PARTITION BY ef.race ORDER BY ef.lap) AS next_yellow
FROM ef JOIN ech ON ech.race = ef.race AND ech.lap = ef.lap""",
    ),
    "yellow_probability": (yellow_probability, None),
    "race_issues": (
        issues,
        f"""WITH {TELEMETRY_SQL}, u AS (SELECT race, unnest([{', '.join(f"{{'s': '{x}', 'x': {x}}}" for x in SIGNALS)}]) AS u FROM telemetry),
m AS (SELECT race, u.s AS s, avg(u.x) AS a, stddev_samp(u.x) AS sd FROM u GROUP BY race, u.s),
o AS (SELECT u.race, m.s, 100.0 * count(*) FILTER (CASE m.s WHEN 'throttle' THEN u.x < 0 OR u.x > 90 WHEN 'speed' THEN u.x < 0 OR u.x > 150 ELSE abs(u.x - a) > 3 * sd END) / count(*) AS pct FROM u JOIN m ON m.race = u.race AND m.s = u.u.s GROUP BY u.race, m.s),
c AS (SELECT race, avg(throttle) FILTER (speed > v) > 50 AS throttle_ok, avg(speed) FILTER (brake > b) < avg(speed) AS brake_ok, quantile_cont(g, 0.99) < 4 AS force_ok
  FROM (SELECT *, quantile_cont(speed, 0.9) OVER w AS v, quantile_cont(brake, 0.9) OVER w AS b, sqrt(accx * accx + accy * accy) AS g FROM telemetry WINDOW w AS (PARTITION BY race)) GROUP BY race),
dt AS (SELECT race, (ts_us - lag(ts_us) OVER (PARTITION BY race, vehicle_number ORDER BY ts_us, n)) / 1e6 AS d FROM telemetry),
i AS (SELECT race, 'outliers:' || s AS issue FROM o WHERE pct > 1 UNION ALL SELECT race, 'few samples' FROM (SELECT race, count(*) / CAST(count(DISTINCT (vehicle_number, lap)) AS DOUBLE) AS k FROM telemetry GROUP BY race) WHERE k < 500
 UNION ALL SELECT DISTINCT race, 'gaps' FROM dt WHERE d > 30000 UNION ALL SELECT race, 'failed:throttle_ok' FROM c WHERE NOT throttle_ok UNION ALL SELECT race, 'failed:brake_ok' FROM c WHERE NOT brake_ok UNION ALL SELECT race, 'failed:force_ok' FROM c WHERE NOT force_ok)
SELECT r.race, coalesce(string_agg(issue, ',' ORDER BY issue), '') AS issues FROM (SELECT DISTINCT race FROM telemetry) r LEFT JOIN i ON i.race = r.race GROUP BY r.race""",
    ),
}
