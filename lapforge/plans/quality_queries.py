"""Queries of what-if scenarios and data quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.operators import counterfactual as X
from lapforge.operators import quality as Q
from lapforge.operators import race as R
from lapforge.plans.adapter import LAPS_SQL, POINTS_SQL, TELEMETRY_SQL, laps, points, telemetry
from lapforge.plans.compare_queries import DEG_SQL, STANDINGS_SQL, TRAFFIC_SQL
from lapforge.plans.metric_queries import r, rounded
from lapforge.plans.race_queries import GAPS_SQL, R6, positioned

V = ["race", "vehicle_number"]
SIGNALS = ["throttle", "brake", "speed", "steering", "accx", "accy"]
RANGES = {"throttle": (0.0, 90.0), "speed": (0.0, 150.0)}

XF_SQL = (
    GAPS_SQL + "," + TRAFFIC_SQL + "," + DEG_SQL + "," + STANDINGS_SQL
    + """,
cc AS (SELECT race, vehicle_number, CASE WHEN count(*) FILTER (lap_time < 1.3 * m) >= 3 THEN stddev_samp(lap_time) FILTER (lap_time < 1.3 * m) END AS consistency,
  coalesce(median(lap_time) FILTER (lap_time < 1.3 * m AND lap <= 5), median(lap_time) FILTER (lap_time < 1.3 * m), median(lap_time)) AS baseline_pace, avg(lap_time) AS avg_lap_time FROM dm GROUP BY race, vehicle_number),
xj AS (SELECT * FROM deg JOIN cc USING (race, vehicle_number) JOIN traffic USING (race, vehicle_number) JOIN standings USING (race, vehicle_number)),
xf AS (SELECT * REPLACE (coalesce(consistency, median(consistency) OVER (PARTITION BY race)) AS consistency), avg_lap_time - median(avg_lap_time) OVER (PARTITION BY race) AS lap_time_delta,
  (avg_lap_time - min(avg_lap_time) FILTER (final_position = 1) OVER (PARTITION BY race)) * laps_completed AS gap_to_winner FROM xj)"""
)
# the fit of each race: centred sums, a column without spread has coefficient 0, the rest by Cramer's rule
FIT_SQL = (
    XF_SQL
    + """,
fm AS (SELECT race, count(*) AS n, avg(degradation) AS m1, avg(consistency) AS m2, avg(traffic_laps) AS m3, avg(lap_time_delta) AS my, var_pop(lap_time_delta) AS yy,
  var_pop(degradation) AS v11, var_pop(consistency) AS v22, var_pop(traffic_laps) AS v33, covar_pop(degradation, consistency) AS v12, covar_pop(degradation, traffic_laps) AS v13, covar_pop(consistency, traffic_laps) AS v23,
  covar_pop(degradation, lap_time_delta) AS v1, covar_pop(consistency, lap_time_delta) AS v2, covar_pop(traffic_laps, lap_time_delta) AS v3
  FROM xf WHERE degradation IS NOT NULL AND consistency IS NOT NULL AND traffic_laps IS NOT NULL AND lap_time_delta IS NOT NULL GROUP BY race HAVING count(*) >= 10),
fz AS (SELECT *, CAST(v11 > 1e-12 * (v11 + m1 * m1) AS INT) AS z1, CAST(v22 > 1e-12 * (v22 + m2 * m2) AS INT) AS z2, CAST(v33 > 1e-12 * (v33 + m3 * m3) AS INT) AS z3 FROM fm),
fc AS (SELECT race, n, m1, m2, m3, my, yy, CASE WHEN z1 = 1 THEN v11 ELSE 1 END AS c11, CASE WHEN z2 = 1 THEN v22 ELSE 1 END AS c22, CASE WHEN z3 = 1 THEN v33 ELSE 1 END AS c33,
  z1 * z2 * v12 AS c12, z1 * z3 * v13 AS c13, z2 * z3 * v23 AS c23, z1 * v1 AS q1, z2 * v2 AS q2, z3 * v3 AS q3 FROM fz),
fd AS (SELECT *, c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c23 * c13) + c13 * (c12 * c23 - c22 * c13) AS det FROM fc),
fb AS (SELECT *, (q1 * (c22 * c33 - c23 * c23) - c12 * (q2 * c33 - c23 * q3) + c13 * (q2 * c23 - c22 * q3)) / det AS b1,
  (c11 * (q2 * c33 - c23 * q3) - q1 * (c12 * c33 - c23 * c13) + c13 * (c12 * q3 - q2 * c13)) / det AS b2,
  (c11 * (c22 * q3 - q2 * c23) - c12 * (c12 * q3 - q2 * c13) + q1 * (c12 * c23 - c22 * c13)) / det AS b3 FROM fd),
fits AS (SELECT race, my - b1 * m1 - b2 * m2 - b3 * m3 AS intercept, b1, b2, b3, (b1 * q1 + b2 * q2 + b3 * q3) / yy AS r2, n FROM fb)"""
)
PLAN_SQL = (
    FIT_SQL
    + """,
g AS (SELECT xf.*, b1, b2, b3, quantile_cont(degradation, 0.25) OVER w AS gd, quantile_cont(consistency, 0.25) OVER w AS gc, CAST(min(traffic_laps) OVER w AS DOUBLE) AS gt,
  intercept + b1 * degradation + b2 * consistency + b3 * traffic_laps AS predicted FROM xf JOIN fits ON fits.race = xf.race WINDOW w AS (PARTITION BY xf.race)),
iv AS (SELECT race, vehicle_number, 'degradation' AS feature, degradation AS original, gd AS target, (lap_time_delta - (predicted + b1 * (gd - degradation))) * 20 AS savings FROM g WHERE degradation > gd
 UNION ALL SELECT race, vehicle_number, 'consistency', consistency, gc, (lap_time_delta - (predicted + b2 * (gc - consistency))) * 20 FROM g WHERE consistency > gc
 UNION ALL SELECT race, vehicle_number, 'traffic_laps', CAST(traffic_laps AS DOUBLE), gt, (lap_time_delta - (predicted + b3 * (gt - traffic_laps))) * 20 FROM g WHERE traffic_laps > gt)"""
)


def x_features(s, d):
    return X.race_features(R.gaps(positioned(s, d)))


def planned(s, d):
    f = x_features(s, d)
    return X.interventions(f, X.race_fits(f))


def ols_normal_eq(s, d):
    """One fit a race."""
    fits = X.race_fits(x_features(s, d))
    return fits.select("race", *[F.round(F.col(c) + 1.7e-10, 5).alias(c) for c in ("intercept", *X.FEATURES, "r2")], "n")


def ols_sums(s, d):
    row = X.normal_sums(x_features(s, d))
    return row.select("n", *[F.round(F.col(c) + 1.7e-10, 4).alias(c) for c in row.columns if c != "n"])


def traffic_nearest(s, d):
    return X.traffic_from_positions(telemetry(s, d), "speed", 0.05, stride=2, least=3)


COLS = {0: "1.0", 1: "degradation", 2: "consistency", 3: "traffic_laps"}
SUMS_SQL = ", ".join(
    [f"round(sum({COLS[i]} * {COLS[j]}) + 1.7e-10, 4) AS a{i}{j}" for i in range(4) for j in range(i, 4)] + [f"round(sum({COLS[i]} * lap_time_delta) + 1.7e-10, 4) AS b{i}" for i in range(4)]
)
U_SQL = "u AS (SELECT n, unnest([" + ", ".join(f"{{'s': '{x}', 'x': {x}}}" for x in SIGNALS) + "]) AS u FROM telemetry)"

QUERIES = {
    "controllable_features": (
        lambda s, d: rounded(x_features(s, d).select(*V, "degradation", "consistency", "traffic_laps", "baseline_pace", "avg_lap_time", "final_position", "lap_time_delta", "gap_to_winner"), "degradation", "consistency", "baseline_pace", "avg_lap_time", "lap_time_delta", "gap_to_winner"),
        f"WITH {XF_SQL} SELECT race, vehicle_number, traffic_laps, final_position, {r('degradation', 'consistency', 'baseline_pace', 'avg_lap_time', 'lap_time_delta', 'gap_to_winner')} FROM xf",
    ),
    "stint_filter": (
        lambda s, d: X.stint_filter(laps(s, d), "late").groupBy(*V).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lap_time") + 1.7e-10, 6).alias("avg_lap_time")),
        f"WITH {LAPS_SQL}, l AS (SELECT *, max(lap) OVER (PARTITION BY race, vehicle_number) AS last FROM laps) SELECT race, vehicle_number, count(*) AS n, round(avg(lap_time) + 1.7e-10, 6) AS avg_lap_time FROM l WHERE lap >= least(16, last) GROUP BY race, vehicle_number",
    ),
    "ols_normal_sums": (ols_sums, f"WITH {XF_SQL} SELECT count(*) AS n, {SUMS_SQL}, round(sum(lap_time_delta * lap_time_delta) + 1.7e-10, 4) AS yy FROM xf"),
    "ols_normal_eq": (
        ols_normal_eq,
        f"WITH {FIT_SQL} SELECT race, round(intercept + 1.7e-10, 5) AS intercept, round(b1 + 1.7e-10, 5) AS degradation, round(b2 + 1.7e-10, 5) AS consistency, round(b3 + 1.7e-10, 5) AS traffic_laps, round(r2 + 1.7e-10, 5) AS r2, n FROM fits",
    ),
    "interventions": (
        lambda s, d: X.flatten_interventions(planned(s, d)).select(*V, "feature", R6("original"), R6("target"), R6("savings"), "place"),
        f"""WITH {PLAN_SQL} SELECT race, vehicle_number, feature, round(original + 1.7e-10, 6) AS original, round(target + 1.7e-10, 6) AS target, round(savings + 1.7e-10, 6) AS savings,
row_number() OVER (PARTITION BY race, vehicle_number ORDER BY round(savings, 9) DESC, feature) AS place FROM iv""",
    ),
    "scenarios": (
        lambda s, d: X.scenarios(planned(s, d)).select(*V, "original_position", R6("total_savings"), "positions_gained"),
        f"""WITH {PLAN_SQL}, t AS (SELECT xf.race, xf.vehicle_number, final_position, avg_lap_time, coalesce(sum(savings), 0.0) AS total_savings FROM g xf LEFT JOIN iv ON iv.race = xf.race AND iv.vehicle_number = xf.vehicle_number GROUP BY ALL),
a AS (SELECT t.race, t.vehicle_number, t.total_savings, sum(abs(t.avg_lap_time - o.avg_lap_time) * 20) OVER (PARTITION BY t.race, t.vehicle_number ORDER BY o.final_position DESC) AS need FROM t JOIN t o ON o.race = t.race AND o.final_position < t.final_position),
p AS (SELECT race, vehicle_number, count(*) FILTER (total_savings > need) AS positions_gained FROM a GROUP BY race, vehicle_number)
SELECT t.race, t.vehicle_number, final_position AS original_position, round(total_savings + 1.7e-10, 6) AS total_savings, coalesce(positions_gained, 0) AS positions_gained FROM t LEFT JOIN p ON p.race = t.race AND p.vehicle_number = t.vehicle_number""",
    ),
    "traffic_nearest": (
        traffic_nearest,
        f"""WITH {TELEMETRY_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY race, vehicle_number, lap ORDER BY n) AS k FROM telemetry),
d AS (SELECT a.race, a.vehicle_number, a.lap, a.n, min(abs(a.speed - b.speed)) AS near FROM p a LEFT JOIN telemetry b ON b.race = a.race AND b.lap = a.lap AND b.vehicle_number <> a.vehicle_number WHERE (a.k - 1) % 2 = 0 GROUP BY ALL)
SELECT race, vehicle_number, lap, count(*) AS n_samples, count(*) FILTER (near < 0.05) AS n_near, CASE WHEN count(*) >= 3 THEN count(*) FILTER (near < 0.05) > 0.3 * count(*) ELSE false END AS in_traffic FROM d GROUP BY race, vehicle_number, lap""",
    ),
    "signal_audit": (
        lambda s, d: rounded(Q.issues(Q.signal_profile(telemetry(s, d), SIGNALS, RANGES)).withColumn("issues", F.array_join("issues", ",")), "mean", "std", "p1", "p5", "p50", "p95", "p99", "outlier_pct", "zero_pct", "negative_pct"),
        f"""WITH {TELEMETRY_SQL}, {U_SQL}, m AS (SELECT u.s AS signal, avg(u.x) AS a, stddev_samp(u.x) AS sd FROM u GROUP BY u.s),
o AS (SELECT u.s AS signal, u.x AS x, CASE u.s WHEN 'throttle' THEN u.x < 0 OR u.x > 90 WHEN 'speed' THEN u.x < 0 OR u.x > 150 ELSE abs(u.x - a) > 3 * sd END AS ol FROM u JOIN m ON m.signal = u.s),
p AS (SELECT signal, count(*) AS n, 0.0::DOUBLE AS missing_pct, min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99,
100.0 * count(*) FILTER (ol) / count(*) AS outlier_pct, 100.0 * count(*) FILTER (x = 0) / count(*) AS zero_pct, 100.0 * count(*) FILTER (x < 0) / count(*) AS negative_pct FROM o GROUP BY signal)
SELECT signal, n, missing_pct, min, max, {r('mean', 'std', 'p1', 'p5', 'p50', 'p95', 'p99', 'outlier_pct', 'zero_pct', 'negative_pct')}, concat_ws(',', CASE WHEN outlier_pct > 5 THEN 'outliers' END, CASE WHEN zero_pct > 50 THEN 'mostly zero' END) AS issues FROM p""",
    ),
    "missingness_pairs": (
        lambda s, d: rounded(Q.missingness_pairs(telemetry(s, d).withColumns({"throttle": F.when(F.col("n") % 5 != 0, F.col("throttle")), "brake": F.when(F.col("n") % 5 != 0, F.col("brake")), "speed": F.when(F.col("n") % 3 != 0, F.col("speed"))}), ["throttle", "brake", "speed"], least=-2.0), "correlation"),
        f"""WITH {TELEMETRY_SQL}, f AS (SELECT CAST(n % 5 = 0 OR throttle IS NULL AS INT) AS t, CAST(n % 5 = 0 OR brake IS NULL AS INT) AS b, CAST(n % 3 = 0 OR speed IS NULL AS INT) AS s FROM telemetry),
p AS (SELECT 'throttle|brake' AS pair, corr(t, b) AS c FROM f UNION ALL SELECT 'throttle|speed', corr(t, s) FROM f UNION ALL SELECT 'brake|speed', corr(b, s) FROM f)
SELECT pair, round(c + 1.7e-10, 6) AS correlation FROM p""",
    ),
    "lap_structure": (
        lambda s, d: rounded(Q.lap_structure(telemetry(s, d).withColumn("lap", F.expr("lap + lap div 3"))), "samples_per_lap", "samples_cv"),
        f"""WITH {TELEMETRY_SQL}, p AS (SELECT race, vehicle_number, lap, count(*) AS k FROM (SELECT * REPLACE (lap + lap // 3 AS lap) FROM telemetry) GROUP BY race, vehicle_number, lap)
SELECT race, vehicle_number, min(lap) AS first_lap, max(lap) AS last_lap, count(*) AS n_laps, max(lap) - min(lap) + 1 - count(*) AS n_missing, round(avg(k) + 1.7e-10, 6) AS samples_per_lap, round(stddev_samp(k) / avg(k) + 1.7e-10, 6) AS samples_cv FROM p GROUP BY race, vehicle_number""",
    ),
    "timestamp_gaps": (
        lambda s, d: rounded(Q.timestamp_audit(telemetry(s, d), 30_000.0), "mean_s", "std_s", "mean_hz"),
        f"""WITH {TELEMETRY_SQL}, x AS (SELECT race, vehicle_number, (ts_us - lag(ts_us) OVER (PARTITION BY race, vehicle_number ORDER BY ts_us, n)) / 1e6 AS d FROM telemetry)
SELECT race, vehicle_number, round(avg(d) + 1.7e-10, 6) AS mean_s, round(stddev_samp(d) + 1.7e-10, 6) AS std_s, min(d) AS min_s, max(d) AS max_s, count(*) FILTER (d > 30000) AS n_gaps, count(*) FILTER (d < 0) AS n_negative, round(1 / (avg(d) FILTER (d <= 30000)) + 1.7e-10, 6) AS mean_hz FROM x GROUP BY race, vehicle_number""",
    ),
    "cross_signal_checks": (
        lambda s, d: Q.cross_signal_checks(telemetry(s, d)),
        f"""WITH {TELEMETRY_SQL}, m AS (SELECT *, quantile_cont(speed, 0.9) OVER w AS v, quantile_cont(brake, 0.9) OVER w AS b, sqrt(accx * accx + accy * accy) AS g FROM telemetry WINDOW w AS (PARTITION BY race))
SELECT race, avg(throttle) FILTER (speed > v) > 50 AS throttle_ok, avg(speed) FILTER (brake > b) < avg(speed) AS brake_ok, quantile_cont(g, 0.99) < 4 AS force_ok FROM m GROUP BY race""",
    ),
    "physical_sanity": (
        lambda s, d: rounded(Q.physical_sanity(telemetry(s, d)), "brake_slows_pct", "throttle_speeds_pct", "steering_pulls_pct"),
        f"""WITH {TELEMETRY_SQL} SELECT race, round(100.0 * count(*) FILTER (brake > 50 AND accx < 0) / count(*) FILTER (brake > 50) + 1.7e-10, 6) AS brake_slows_pct,
round(100.0 * count(*) FILTER (throttle > 80 AND accx > 0) / count(*) FILTER (throttle > 80) + 1.7e-10, 6) AS throttle_speeds_pct,
round(100.0 * count(*) FILTER (abs(steering) > 30 AND abs(accy) > 0.3) / count(*) FILTER (abs(steering) > 30) + 1.7e-10, 6) AS steering_pulls_pct, count(*) FILTER (abs(accx) > 3 OR abs(accy) > 3) AS n_extreme FROM telemetry GROUP BY race""",
    ),
    "driver_variability": (
        lambda s, d: rounded(Q.driver_variability(telemetry(s, d), "speed"), "mean_std", "cv_of_means"),
        f"""WITH {TELEMETRY_SQL}, e AS (SELECT race, vehicle_number, avg(speed) AS mean, stddev_samp(speed) AS std, max(speed) AS mx FROM telemetry GROUP BY race, vehicle_number)
SELECT race, round(avg(std) + 1.7e-10, 6) AS mean_std, max(mx) AS max, round(stddev_samp(mean) / avg(mean) + 1.7e-10, 6) AS cv_of_means FROM e GROUP BY race""",
    ),
    "band_counts": (
        lambda s, d: Q.band_counts(points(s, d), "longitude", [-0.1, 0.0, 0.1]),
        f"WITH {POINTS_SQL} SELECT track, CAST((longitude >= -0.1)::INT + (longitude >= 0.0)::INT + (longitude >= 0.1)::INT AS BIGINT) AS band, count(*) AS n FROM points GROUP BY 1, 2",
    ),
    "histogram": (
        lambda s, d: Q.histogram(laps(s, d), "lap_time", 0.0, 200.0, 20),
        f"WITH {LAPS_SQL} SELECT CAST(CASE WHEN lap_time < 0 THEN 0 WHEN lap_time >= 200 THEN 21 ELSE floor(lap_time / 200.0 * 20) + 1 END AS BIGINT) AS bin, count(*) AS n FROM laps GROUP BY 1",
    ),
    "signal_availability": (
        lambda s, d: rounded(Q.availability(telemetry(s, d), ["throttle", "brake"], 40.0, 60.0), "speed_p10", "speed_p30", "speed_p50"),
        f"""WITH {TELEMETRY_SQL} SELECT race, count(throttle) AS n_throttle, count(brake) AS n_brake, round(quantile_cont(speed, 0.1) + 1.7e-10, 6) AS speed_p10, round(quantile_cont(speed, 0.3) + 1.7e-10, 6) AS speed_p30, round(quantile_cont(speed, 0.5) + 1.7e-10, 6) AS speed_p50,
count(*) FILTER (speed < 40) AS n_slow, count(*) FILTER (brake > 60) AS n_braking FROM telemetry GROUP BY race""",
    ),
    "join_yield": (
        lambda s, d: Q.join_yield(telemetry(s, d).select(*V, "lap", "n"), telemetry(s, d).filter("n % 4 <> 0").select(*V, "n", F.when(F.col("brake") > 20, F.col("speed")).alias("speed")), [*V, "n"], "speed", ["race", "lap"]),
        f"WITH {TELEMETRY_SQL} SELECT race, lap, count(*) AS n, count(*) FILTER (n % 4 <> 0) AS n_met, count(*) FILTER (n % 4 <> 0 AND brake > 20) AS n_value FROM telemetry GROUP BY race, lap",
    ),
    "lap_time_skew": (
        lambda s, d: rounded(Q.bias_corrected_skew(laps(s, d), "lap_time", ["race"]), "skew"),
        f"WITH {LAPS_SQL} SELECT race, count(*) AS n, round(skewness(lap_time) + 1.7e-10, 6) AS skew FROM laps GROUP BY race",
    ),
}
