"""Queries of the race core, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapforge.operators import race as R
from lapforge.plans.adapter import LAPS_SQL, TOTAL_LAPS, laps

#: Results are rounded a little off the tie, so that sums in another order cannot fall on its other side.
R6 = lambda c: F.round(F.col(c) + 1.7e-10, 6).alias(c)
KEY = ["race", "vehicle_number", "lap"]

POSITION_SQL = (
    LAPS_SQL
    + """,
most AS (SELECT *, max(lap) OVER (PARTITION BY race, vehicle_number) AS most FROM laps),
pos AS (
  SELECT race, vehicle_number, lap, ts_us, lap_time, is_under_yellow,
         sum(lap_time) OVER (PARTITION BY race, vehicle_number ORDER BY lap) AS cumulative_time,
         CAST(row_number() OVER (PARTITION BY race, lap ORDER BY most DESC, ts_us, vehicle_number) AS BIGINT) AS position
  FROM most)"""
)
GAPS_SQL = (
    POSITION_SQL
    + """,
gapped AS (
  SELECT *, (ts_us - min(ts_us) OVER (PARTITION BY race, lap)) / 1e6 AS gap_to_leader,
         coalesce((ts_us - lag(ts_us) OVER w) / 1e6, 0.0) AS gap_to_ahead,
         least(coalesce((lead(ts_us) OVER w - ts_us) / 1e6, 999.0), 60.0) AS gap_to_behind
  FROM pos WINDOW w AS (PARTITION BY race, lap ORDER BY position))"""
)
DELTAS_SQL = (
    GAPS_SQL
    + """,
deltas AS (
  SELECT *, coalesce(gap_to_ahead - lag(gap_to_ahead, 3) OVER w, 0.0) AS gap_delta_ahead,
         coalesce(gap_to_behind - lag(gap_to_behind, 3) OVER w, 0.0) AS gap_delta_behind,
         gap_to_ahead < 1.0 OR gap_to_behind < 1.0 AS is_fighting
  FROM gapped WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY lap))"""
)
FEATURES_SQL = (
    DELTAS_SQL
    + f""",
features AS (
  SELECT *, lag(lap_time) OVER w AS prev_lap_time,
         avg(lap_time) OVER (PARTITION BY race, vehicle_number ORDER BY lap ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_avg_3,
         coalesce(lap_time - lag(lap_time) OVER w, 0.0) AS lap_time_diff,
         {TOTAL_LAPS} - lap AS laps_remaining, lap / {TOTAL_LAPS}.0 AS race_progress, 1 - lap / {TOTAL_LAPS}.0 AS fuel_load_estimate
  FROM deltas WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY lap))"""
)
RELATIVE_SQL = (
    LAPS_SQL
    + """,
rel AS (SELECT *, median(lap_time) OVER (PARTITION BY race, lap) AS field_median FROM laps),
relative AS (SELECT *, lap_time - field_median AS relative_time FROM rel)"""
)
CLEAN_SQL = (
    RELATIVE_SQL
    + """,
spread AS (
  SELECT *, stddev_samp(relative_time) OVER w AS s, avg(relative_time) OVER w AS a FROM relative
  WINDOW w AS (PARTITION BY race, vehicle_number)),
clean AS (SELECT * FROM spread WHERE s IS NULL OR s <= 0 OR abs(relative_time - a) <= 2 * s)"""
)


def positioned(spark, d):
    return R.race_position(R.cumulative_time(laps(spark, d)))


def features(spark, d):
    return R.race_features(laps(spark, d), TOTAL_LAPS)


def clean_relative(spark, d):
    return R.within_sigma(R.relative_time(laps(spark, d)), "relative_time", 2.0)


def relative_pace(spark, d):
    """Weighted prediction of each lap's relative time from the last lap and the mean of the past; MAE per driver."""
    base = R.prev_relative(clean_relative(spark, d))
    past = R.by_vehicle().rowsBetween(Window.unboundedPreceding, -1)
    predicted = base.withColumn("mean_past", F.avg("relative_time").over(past)).filter("prev_relative is not null")
    error = F.col("relative_time") - (0.3 * F.col("prev_relative") + 0.7 * F.col("mean_past"))
    return predicted.groupBy("race", "vehicle_number").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(error)) + 1.7e-10, 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)) + 1.7e-10, 6).alias("rmse")
    )


QUERIES = {
    "relative_pace": (
        relative_pace,
        f"""WITH {CLEAN_SQL},
p AS (SELECT *, lag(relative_time) OVER w AS prev_relative,
        avg(relative_time) OVER (PARTITION BY race, vehicle_number ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_past
      FROM clean WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY lap)),
e AS (SELECT *, relative_time - (0.3 * prev_relative + 0.7 * mean_past) AS error FROM p WHERE prev_relative IS NOT NULL)
SELECT race, vehicle_number, count(*) AS n, round(avg(abs(error)) + 1.7e-10, 6) AS mae, round(sqrt(avg(error * error)) + 1.7e-10, 6) AS rmse
FROM e GROUP BY race, vehicle_number""",
    ),
    "lap_time_diff": (
        lambda s, d: R.lap_time_diff(laps(s, d).drop("lap_time")).select(*KEY, R6("lap_time")),
        f"WITH {LAPS_SQL} SELECT race, vehicle_number, lap, round((ts_us - lag(ts_us) OVER (PARTITION BY race, vehicle_number ORDER BY lap)) / 1e6 + 1.7e-10, 6) AS lap_time FROM laps",
    ),
    "lap_filter": (
        lambda s, d: R.valid_laps(laps(s, d), 10.0, 100.0, max_lap=50).select(*KEY, "lap_time"),
        f"WITH {LAPS_SQL} SELECT race, vehicle_number, lap, lap_time FROM laps WHERE lap > 1 AND lap < 1000 AND lap <= 50 AND lap_time > 10 AND lap_time < 100",
    ),
    "clean_laps_2sigma": (
        lambda s, d: clean_relative(s, d).select(*KEY, R6("relative_time")),
        f"WITH {CLEAN_SQL} SELECT race, vehicle_number, lap, round(relative_time + 1.7e-10, 6) AS relative_time FROM clean",
    ),
    "clean_laps_3sigma": (
        lambda s, d: R.within_sigma(R.green_laps(laps(s, d)), "lap_time", 3.0).select(*KEY, "lap_time"),
        f"""WITH {LAPS_SQL}, g AS (SELECT *, stddev_samp(lap_time) OVER w AS s, avg(lap_time) OVER w AS a FROM laps WHERE is_under_yellow = 0
WINDOW w AS (PARTITION BY race, vehicle_number))
SELECT race, vehicle_number, lap, lap_time FROM g WHERE s IS NULL OR s <= 0 OR abs(lap_time - a) <= 3 * s""",
    ),
    "field_relative_outliers": (
        lambda s, d: R.field_relative_outliers(laps(s, d), over=("race", "lap")).select(*KEY, "lap_time"),
        f"""WITH {LAPS_SQL}, g AS (SELECT *, median(lap_time) OVER (PARTITION BY race, lap) AS m FROM laps)
SELECT race, vehicle_number, lap, lap_time FROM g WHERE lap_time < 1.3 * m""",
    ),
    "near_median_laps": (
        lambda s, d: R.near_median(laps(s, d)).select(*KEY, "lap_time"),
        f"""WITH {LAPS_SQL}, g AS (SELECT *, median(lap_time) OVER (PARTITION BY race, vehicle_number) AS m FROM laps)
SELECT race, vehicle_number, lap, lap_time FROM g WHERE lap_time < m + 10""",
    ),
    "green_laps": (
        lambda s, d: R.green_laps(laps(s, d)).groupBy("race", "vehicle_number").agg(F.count(F.lit(1)).alias("n_green")),
        f"WITH {LAPS_SQL} SELECT race, vehicle_number, count(*) AS n_green FROM laps WHERE is_under_yellow = 0 GROUP BY race, vehicle_number",
    ),
    "keep_last_lap_event": (
        lambda s, d: R.keep_last(laps(s, d), ["race", "vehicle_number", "event_type"], [F.desc("ts_us"), F.desc("lap")]).select(
            "race", "vehicle_number", "event_type", "lap", "ts_us"
        ),
        f"""WITH {LAPS_SQL} SELECT race, vehicle_number, event_type, max(lap) AS lap, max(ts_us) AS ts_us FROM laps
GROUP BY race, vehicle_number, event_type""",
    ),
    "cumulative_time": (
        lambda s, d: R.cumulative_time(laps(s, d)).select(*KEY, R6("cumulative_time")),
        f"WITH {POSITION_SQL} SELECT race, vehicle_number, lap, round(cumulative_time + 1.7e-10, 6) AS cumulative_time FROM pos",
    ),
    "race_position": (
        lambda s, d: positioned(s, d).select(*KEY, "position"),
        f"WITH {POSITION_SQL} SELECT race, vehicle_number, lap, position FROM pos",
    ),
    "gaps": (
        lambda s, d: R.gaps(positioned(s, d)).select(*KEY, "position", R6("gap_to_leader"), R6("gap_to_ahead"), R6("gap_to_behind")),
        f"""WITH {GAPS_SQL} SELECT race, vehicle_number, lap, position, round(gap_to_leader + 1.7e-10, 6) AS gap_to_leader,
round(gap_to_ahead + 1.7e-10, 6) AS gap_to_ahead, round(gap_to_behind + 1.7e-10, 6) AS gap_to_behind FROM gapped""",
    ),
    "gap_deltas": (
        lambda s, d: R.gap_deltas(R.gaps(positioned(s, d))).select(*KEY, R6("gap_delta_ahead"), R6("gap_delta_behind"), "is_fighting"),
        f"""WITH {DELTAS_SQL} SELECT race, vehicle_number, lap, round(gap_delta_ahead + 1.7e-10, 6) AS gap_delta_ahead,
round(gap_delta_behind + 1.7e-10, 6) AS gap_delta_behind, is_fighting FROM deltas""",
    ),
    "lag_rolling3": (
        lambda s, d: R.lag_features(laps(s, d)).select(*KEY, "prev_lap_time", R6("rolling_avg_3"), R6("lap_time_diff")),
        f"""WITH {FEATURES_SQL} SELECT race, vehicle_number, lap, prev_lap_time, round(rolling_avg_3 + 1.7e-10, 6) AS rolling_avg_3,
round(lap_time_diff + 1.7e-10, 6) AS lap_time_diff FROM features""",
    ),
    "race_context": (
        lambda s, d: R.race_context(laps(s, d), TOTAL_LAPS).select(*KEY, "laps_remaining", R6("race_progress"), R6("fuel_load_estimate")),
        f"""WITH {FEATURES_SQL} SELECT race, vehicle_number, lap, laps_remaining, round(race_progress + 1.7e-10, 6) AS race_progress,
round(fuel_load_estimate + 1.7e-10, 6) AS fuel_load_estimate FROM features""",
    ),
    "position_churn": (
        lambda s, d: R.position_churn(positioned(s, d)).select("race", "lap", F.col("position_churn").cast("bigint").alias("position_churn")),
        f"""WITH {POSITION_SQL}, c AS (SELECT race, lap, abs(position - lag(position) OVER (PARTITION BY race, vehicle_number ORDER BY lap)) AS d FROM pos)
SELECT race, lap, CAST(coalesce(sum(d), 0) AS BIGINT) AS position_churn FROM c GROUP BY race, lap""",
    ),
    "next_yellow": (
        lambda s, d: R.yellow_laps(laps(s, d)),
        f"""WITH {LAPS_SQL}, y AS (SELECT race, lap, max(is_under_yellow) AS is_yellow FROM laps GROUP BY race, lap)
SELECT race, lap, is_yellow, lead(is_yellow, 1, 0) OVER (PARTITION BY race ORDER BY lap) AS next_yellow FROM y""",
    ),
    "race_features": (
        lambda s, d: features(s, d).select(
            *KEY, "position", R6("cumulative_time"), R6("gap_to_ahead"), R6("gap_delta_ahead"), "is_fighting", R6("rolling_avg_3"), "laps_remaining"
        ),
        f"""WITH {FEATURES_SQL} SELECT race, vehicle_number, lap, position, round(cumulative_time + 1.7e-10, 6) AS cumulative_time,
round(gap_to_ahead + 1.7e-10, 6) AS gap_to_ahead, round(gap_delta_ahead + 1.7e-10, 6) AS gap_delta_ahead, is_fighting, round(rolling_avg_3 + 1.7e-10, 6) AS rolling_avg_3, laps_remaining FROM features""",
    ),
}
