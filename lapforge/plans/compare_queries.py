"""Queries of comparison, profiles and read-side views, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapforge.operators import compare as C
from lapforge.operators import metrics as M
from lapforge.operators import race as R
from lapforge.operators import views
from lapforge.plans.adapter import LAPS_SQL, TELEMETRY_SQL, TOTAL_LAPS, laps, telemetry
from lapforge.plans.metric_queries import r, rounded
from lapforge.plans.race_queries import DELTAS_SQL, FEATURES_SQL, GAPS_SQL, KEY, POSITION_SQL, R6, features, positioned

V = ["race", "vehicle_number"]

BENCH_SQL = (
    POSITION_SQL
    + """,
bm AS (SELECT *, median(lap_time) OVER w AS m, count(*) OVER w AS k FROM pos WINDOW w AS (PARTITION BY race, lap)),
bench AS (SELECT race, lap, median(lap_time) AS field_median, quantile_cont(lap_time, 0.25) AS field_p25, quantile_cont(lap_time, 0.75) AS field_p75,
  coalesce(avg(lap_time) FILTER (position <= 5), min(lap_time)) AS top5_avg, count(*) AS n_cars
  FROM bm WHERE k >= 3 AND lap_time < 1.3 * m GROUP BY race, lap HAVING count(*) >= 3)"""
)
STINT_SQL = """
sl AS (SELECT *, max(lap) OVER (PARTITION BY race, vehicle_number) AS last FROM laps),
stints AS (SELECT *, CASE WHEN lap <= least(5, last) THEN 'early' WHEN lap BETWEEN least(5, last) + 1 AND least(15, last) THEN 'mid' WHEN lap >= least(15, last) + 1 THEN 'late' END AS stint FROM sl),
pace AS (SELECT race, vehicle_number, median(lap_time) FILTER (stint = 'early') AS early_pace, median(lap_time) FILTER (stint = 'mid') AS mid_pace, median(lap_time) FILTER (stint = 'late') AS late_pace FROM stints GROUP BY race, vehicle_number)"""
DEG_SQL = """
dm AS (SELECT *, median(lap_time) OVER (PARTITION BY race, vehicle_number) AS m FROM laps),
deg AS (SELECT race, vehicle_number, CASE WHEN count(*) < 3 OR count(*) FILTER (lap_time < 1.3 * m) < 3 THEN 0.0 ELSE regr_slope(lap_time, lap) FILTER (lap_time < 1.3 * m) END AS degradation, count(*) AS n_laps FROM dm GROUP BY race, vehicle_number)"""
TRAFFIC_SQL = """
tr AS (SELECT *, gap_to_ahead < 1.5 OR gap_to_behind < 1.5 AS in_traffic FROM gapped),
traffic AS (SELECT race, vehicle_number, count(*) FILTER (in_traffic) AS traffic_laps,
  coalesce((median(lap_time) FILTER (in_traffic) - median(lap_time) FILTER (NOT in_traffic)) * count(*) FILTER (in_traffic), 0.0) AS traffic_cost FROM tr GROUP BY race, vehicle_number)"""
STANDINGS_SQL = """
sg AS (SELECT race, vehicle_number, max(lap) AS laps_completed, sum(lap_time) AS total_time FROM laps GROUP BY race, vehicle_number),
standings AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY laps_completed DESC, total_time, vehicle_number) AS final_position FROM sg)"""
METRICS_SQL = (
    GAPS_SQL + "," + TRAFFIC_SQL + "," + DEG_SQL + "," + STINT_SQL
    + """,
lastrow AS (SELECT race, vehicle_number, max(lap) AS last_lap, arg_max(position, lap) AS final_position, arg_max(gap_to_ahead, lap) AS gap_to_ahead, median(lap_time) AS pace, max(cumulative_time) AS driver_time FROM gapped GROUP BY race, vehicle_number),
own AS (SELECT * FROM lastrow JOIN deg USING (race, vehicle_number) JOIN traffic USING (race, vehicle_number) JOIN pace USING (race, vehicle_number)),
win AS (SELECT race, max(cumulative_time) AS winner_time FROM gapped WHERE position = 1 GROUP BY race),
fd AS (SELECT race, avg(degradation) AS field_deg FROM own WHERE n_laps >= 5 GROUP BY race),
met AS (SELECT own.*, g.vehicle_number AS ahead_vehicle FROM own LEFT JOIN gapped g ON g.race = own.race AND g.lap = own.last_lap AND g.position = CASE WHEN own.final_position = 1 THEN 2 ELSE own.final_position - 1 END),
dmx AS (SELECT met.race, met.vehicle_number, met.final_position, coalesce(met.driver_time - winner_time, 0.0) AS gap_to_winner, met.gap_to_ahead, met.ahead_vehicle,
  coalesce(met.pace - o.pace, 0.0) AS ahead_pace_delta, coalesce(met.degradation - o.degradation, 0.0) AS ahead_deg_delta, coalesce(met.traffic_laps - o.traffic_laps, 0) AS ahead_traffic_delta,
  met.degradation AS driver_deg, coalesce(field_deg, 0.0) AS field_deg, met.traffic_laps, met.traffic_cost, coalesce(met.early_pace, 0.0) AS early_pace, coalesce(met.mid_pace, 0.0) AS mid_pace, coalesce(met.late_pace, 0.0) AS late_pace
  FROM met LEFT JOIN own o ON o.race = met.race AND o.vehicle_number = met.ahead_vehicle LEFT JOIN win ON win.race = met.race LEFT JOIN fd ON fd.race = met.race)"""
)
PER_LAP_SQL = (
    TELEMETRY_SQL
    + """,
pt AS (SELECT *, lag(throttle) OVER (PARTITION BY race, vehicle_number, lap ORDER BY n) AS p FROM telemetry),
per_lap AS (SELECT race, vehicle_number, lap, count(*) FILTER (p > 20 AND throttle > 20 AND p - throttle > 5) / CAST(greatest(count(*) FILTER (p < 20 AND throttle >= 20), 1) AS DOUBLE) AS lift_offs,
  100.0 * count(*) FILTER (throttle >= 90) / count(*) AS full_pct, avg(sqrt(accx * accx + accy * accy)) AS mean_g, avg(brake) AS brake_level,
  100.0 * count(*) FILTER (throttle < 30 AND brake < 30) / count(*) AS coasting_pct FROM pt GROUP BY race, vehicle_number, lap),
profile AS (SELECT race, vehicle_number, avg(lift_offs) AS lift_offs, avg(full_pct) AS full_pct, avg(mean_g) AS mean_g, avg(brake_level) AS brake_mean,
  coalesce(nullif(stddev_samp(brake_level), 0), 0.15 * avg(brake_level)) AS brake_std, avg(coasting_pct) AS coasting_mean,
  coalesce(nullif(stddev_samp(coasting_pct), 0), 0.15 * avg(coasting_pct)) AS coasting_std, count(*) AS n_laps FROM per_lap GROUP BY race, vehicle_number)"""
)
TRAITS = ["lift_offs", "full_pct", "mean_g", "coasting_mean"]
DM = ["gap_to_winner", "gap_to_ahead", "ahead_pace_delta", "ahead_deg_delta", "driver_deg", "field_deg", "traffic_cost", "early_pace", "mid_pace", "late_pace"]


def per_lap_metrics(s, d):
    t = telemetry(s, d)
    keys = [*V, "lap"]
    levels = t.groupBy(*keys).agg(F.avg("brake").alias("brake_level"))
    return (
        M.throttle_control(t, keys=keys).join(M.g_force(t, keys), keys).join(M.coasting_below(t, 30.0, 30.0, keys), keys).join(levels, keys)
    )


def profiles(s, d):
    return C.driver_profile(per_lap_metrics(s, d))


def driver_metrics(s, d):
    return C.driver_metrics(features(s, d))


QUERIES = {
    "field_benchmark": (
        lambda s, d: rounded(C.field_benchmark(positioned(s, d)), "field_median", "field_p25", "field_p75", "top5_avg"),
        f"WITH {BENCH_SQL} SELECT race, lap, n_cars, {r('field_median', 'field_p25', 'field_p75', 'top5_avg')} FROM bench",
    ),
    "driver_deltas": (
        lambda s, d: C.driver_deltas(laps(s, d), C.field_benchmark(positioned(s, d))).select(*KEY, R6("delta_vs_median"), R6("delta_vs_top5")),
        f"WITH {BENCH_SQL} SELECT race, vehicle_number, lap, round(lap_time - field_median + 1.7e-10, 6) AS delta_vs_median, round(lap_time - top5_avg + 1.7e-10, 6) AS delta_vs_top5 FROM laps LEFT JOIN bench USING (race, lap)",
    ),
    "stint_pace": (
        lambda s, d: rounded(C.stint_pace(laps(s, d)), "early_pace", "mid_pace", "late_pace"),
        f"WITH {LAPS_SQL}, {STINT_SQL} SELECT race, vehicle_number, {r('early_pace', 'mid_pace', 'late_pace')} FROM pace",
    ),
    "stint_sizes": (
        lambda s, d: C.with_stints(laps(s, d)).groupBy("race", "stint").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {LAPS_SQL}, {STINT_SQL} SELECT race, stint, count(*) AS n FROM stints GROUP BY race, stint",
    ),
    "degradation": (
        lambda s, d: rounded(C.degradation(laps(s, d)), "degradation"),
        f"WITH {LAPS_SQL}, {DEG_SQL} SELECT race, vehicle_number, n_laps, round(degradation + 1.7e-10, 6) AS degradation FROM deg",
    ),
    "traffic_cost": (
        lambda s, d: rounded(C.traffic_cost(R.gaps(positioned(s, d))), "traffic_cost"),
        f"WITH {GAPS_SQL}, {TRAFFIC_SQL} SELECT race, vehicle_number, traffic_laps, round(traffic_cost + 1.7e-10, 6) AS traffic_cost FROM traffic",
    ),
    "standings": (
        lambda s, d: rounded(C.standings(laps(s, d)), "total_time"),
        f"WITH {LAPS_SQL}, {STANDINGS_SQL} SELECT race, vehicle_number, laps_completed, round(total_time + 1.7e-10, 6) AS total_time, final_position FROM standings",
    ),
    "vs_driver_ahead": (
        lambda s, d: rounded(driver_metrics(s, d), *DM),
        f"WITH {METRICS_SQL} SELECT race, vehicle_number, final_position, ahead_vehicle, ahead_traffic_delta, traffic_laps, {r(*DM)} FROM dmx",
    ),
    "narrative_template": (
        lambda s, d: C.narrative(driver_metrics(s, d)).select(*V, "narrative"),
        f"""WITH {METRICS_SQL} SELECT race, vehicle_number, CASE WHEN final_position = 1 THEN printf('Car %d won; pace against second %.3f s.', vehicle_number, ahead_pace_delta)
ELSE printf('Car %d finished P%d, %.3f s off the winner; %d laps in traffic cost %.3f s.', vehicle_number, final_position, gap_to_winner, traffic_laps, traffic_cost) END AS narrative FROM dmx""",
    ),
    "percentile_in_field": (
        lambda s, d: C.percentile_in_field(M.g_force(telemetry(s, d)).select(*V, F.round("mean_g", 9).alias("mean_g")), "mean_g").select(*V, F.col("mean_g_rank").cast("bigint").alias("mean_g_rank"), R6("mean_g_percentile")),
        f"""WITH {TELEMETRY_SQL}, g AS (SELECT race, vehicle_number, round(avg(sqrt(accx * accx + accy * accy)), 9) AS x FROM telemetry GROUP BY race, vehicle_number)
SELECT race, vehicle_number, rank() OVER (PARTITION BY race ORDER BY x) AS mean_g_rank, round(100.0 * (rank() OVER (PARTITION BY race ORDER BY x) - 1) / count(x) OVER (PARTITION BY race) + 1.7e-10, 6) AS mean_g_percentile FROM g""",
    ),
    "driver_profiles": (
        lambda s, d: rounded(profiles(s, d), "lift_offs", "full_pct", "mean_g", "brake_mean", "brake_std", "coasting_mean", "coasting_std"),
        f"WITH {PER_LAP_SQL} SELECT race, vehicle_number, n_laps, {r('lift_offs', 'full_pct', 'mean_g', 'brake_mean', 'brake_std', 'coasting_mean', 'coasting_std')} FROM profile",
    ),
    "training_recommendations": (
        lambda s, d: rounded(C.recommendations(rounded(profiles(s, d), *TRAITS).select(*V, *TRAITS), TRAITS), "percentile"),
        f"""WITH {PER_LAP_SQL}, u AS (SELECT race, vehicle_number, unnest([{', '.join(f"{{'t': '{t}', 'v': round({t} + 1.7e-10, 6)}}" for t in TRAITS)}]) AS u FROM profile),
p AS (SELECT race, vehicle_number, u.t AS trait, 100.0 * (rank() OVER (PARTITION BY race, u.t ORDER BY u.v) - 1) / count(u.v) OVER (PARTITION BY race, u.t) AS percentile FROM u)
SELECT race, vehicle_number, trait, round(percentile + 1.7e-10, 6) AS percentile, CASE WHEN percentile < 25 THEN 'high' ELSE 'medium' END AS priority FROM p WHERE percentile < 50""",
    ),
    "clean_consistency": (
        lambda s, d: rounded(C.clean_consistency(laps(s, d)), "consistency"),
        f"WITH {LAPS_SQL}, {DEG_SQL} SELECT race, vehicle_number, round(CASE WHEN count(*) FILTER (lap_time < 1.3 * m) >= 3 THEN stddev_samp(lap_time) FILTER (lap_time < 1.3 * m) END + 1.7e-10, 6) AS consistency FROM dm GROUP BY race, vehicle_number",
    ),
    "lap_card": (
        lambda s, d: views.lap_card(features(s, d), 20).select("race", "vehicle_number", "position", R6("gap_to_ahead"), R6("vs_field"), "band"),
        f"""WITH {GAPS_SQL}, m AS (SELECT *, lap_time - median(lap_time) OVER (PARTITION BY race, lap) AS vs_field FROM gapped)
SELECT race, vehicle_number, position, round(gap_to_ahead + 1.7e-10, 6) AS gap_to_ahead, round(vs_field + 1.7e-10, 6) AS vs_field, CASE WHEN vs_field < -0.5 THEN 'fast' WHEN vs_field < 0.5 THEN 'even' ELSE 'slow' END AS band FROM m WHERE lap = 20""",
    ),
    "gap_history": (
        lambda s, d: views.history(features(s, d), 20).select(*KEY, "position", R6("gap_to_ahead"), R6("gap_to_behind"), "is_fighting"),
        f"WITH {DELTAS_SQL} SELECT race, vehicle_number, lap, position, round(gap_to_ahead + 1.7e-10, 6) AS gap_to_ahead, round(gap_to_behind + 1.7e-10, 6) AS gap_to_behind, is_fighting FROM deltas WHERE lap <= 20",
    ),
    "sector_vs_field": (
        lambda s, d: views.sector_deltas(laps(s, d).select(*KEY, (F.col("lap_time") * 0.4).alias("s1"), (F.col("lap_time") * 0.6).alias("s2")), ["s1", "s2"]).select(*KEY, "sector", R6("delta")),
        f"""WITH {LAPS_SQL}, u AS (SELECT race, vehicle_number, lap, 's1' AS sector, lap_time * 0.4 AS x FROM laps UNION ALL SELECT race, vehicle_number, lap, 's2', lap_time * 0.6 FROM laps)
SELECT race, vehicle_number, lap, sector, round(x - median(x) OVER (PARTITION BY race, lap, sector) + 1.7e-10, 6) AS delta FROM u""",
    ),
    "position_neighbours": (
        lambda s, d: views.neighbours(features(s, d), 20, 3),
        f"""WITH {POSITION_SQL}, p AS (SELECT * FROM pos WHERE lap = 20) SELECT a.race, a.vehicle_number, b.vehicle_number AS neighbour, b.position - a.position AS places
FROM p a JOIN p b ON a.race = b.race AND a.vehicle_number <> b.vehicle_number AND abs(a.position - b.position) <= 3""",
    ),
    "degradation_vs_field": (
        lambda s, d: views.against_field(C.degradation(laps(s, d)), "degradation").select(*V, R6("vs_median"), R6("vs_p25")),
        f"""WITH {LAPS_SQL}, {DEG_SQL} SELECT race, vehicle_number, round(degradation - median(degradation) OVER (PARTITION BY race) + 1.7e-10, 6) AS vs_median,
round(degradation - quantile_cont(degradation, 0.25) OVER (PARTITION BY race) + 1.7e-10, 6) AS vs_p25 FROM deg""",
    ),
    "coaching_message": (
        lambda s, d: views.coaching_message(laps(s, d).select(*KEY, "lap_time", (F.col("lap_time") * 0.4).alias("s1"), (F.col("lap_time") * 0.6).alias("s2")), ["s1", "s2"]).select(*KEY, "message"),
        f"""WITH {LAPS_SQL}, m AS (SELECT *, lap_time - median(lap_time) OVER w AS x, lap_time * 0.4 - median(lap_time * 0.4) OVER w AS a, lap_time * 0.6 - median(lap_time * 0.6) OVER w AS b FROM laps WINDOW w AS (PARTITION BY race, lap))
SELECT race, vehicle_number, lap, (CASE WHEN x < -0.5 THEN 'Fast lap' WHEN x < 0.5 THEN 'On pace' ELSE 'Off pace' END) || CASE WHEN greatest(a, b) > 0.2 THEN '; lost most in ' || CASE WHEN a >= b THEN 's1' ELSE 's2' END ELSE '' END AS message FROM m""",
    ),
    "duplicate_positions": (
        lambda s, d: laps(s, d).groupBy("race", "vehicle_number").agg(F.max("lap").alias("final_lap")).groupBy("race", "final_lap").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
        f"""WITH {LAPS_SQL}, g AS (SELECT race, vehicle_number, max(lap) AS final_lap FROM laps GROUP BY race, vehicle_number) SELECT race, final_lap, count(*) AS n FROM g GROUP BY race, final_lap HAVING count(*) > 1""",
    ),
}
