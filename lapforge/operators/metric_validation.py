"""Whether technique metrics hold: timing of the throttle, six summary scores, winner against last, and correlations
within and across drivers with their significance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.functions.statistics import t_p_value
from lapforge.operators import RACE
from lapforge.operators import metrics as M
from lapforge.operators.spatial import centred_mean, peaks

VEHICLE = (*RACE, "vehicle_number")
SCORES = ("consistency_score", "efficiency_score", "braking_score", "throttle_score", "throttle_timing_score", "smoothness_score")
# what is better, as published
DIRECTIONS = {"consistency_std": "lower", "coasting_pct": "lower", "brake_oscillations_per_event": "lower", "apex_to_throttle_ms": "lower", "mean_combined_g": "higher"}
SIGNS = {"coasting_pct": 1, "brake_cv": 1, "mean_combined_g": -1, "lift_off_count": 1, "full_throttle_pct": -1}


def throttle_timing(t: DataFrame, full: float = 95.0, apart: int = 50, ahead: int = 200, least_rows: int = 100, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Per group: full_throttle_pct, and mean and median seconds from the slow places to full throttle, n_corners.

    A slow place is a minimum of the speed (mean of five samples) in the lower 70 % of its range, `apart` samples from a slower one. Full throttle counts
    if it comes among the next `ahead` samples, more than 0 and less than 10 seconds later. A group whose speed has a range below 10,
    or no such place, has no times; one with fewer than least_rows whole samples has none either. One group is one vehicle's race.
    """
    share = t.groupBy(*keys).agg((100.0 * F.count_if(F.col("throttle") >= full) / F.nullif(F.count("throttle"), F.lit(0))).alias("full_throttle_pct"))
    rows = t.dropna(subset=["throttle", "speed", "ts_us"]).select(*keys, "ts_us", "n", F.col("speed").cast("double"), F.col("throttle").cast("double"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*keys, "mean_time_to_full", "median_time_to_full", "n_corners"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts_us", "n"], kind="stable")
        if len(part) < least_rows:
            return pd.DataFrame(columns=names)
        soft = centred_mean(part["speed"].to_numpy(float), 5)
        span = soft.max() - soft.min()
        times = np.zeros(0)
        if span >= 10:
            at = peaks(-soft, height=-soft.max() + 0.3 * span, distance=apart)
            there = np.flatnonzero(part["throttle"].to_numpy(float) >= full)
            if len(there):
                place = np.searchsorted(there, at)
                at, place = at[place < len(there)], place[place < len(there)]
                hit = there[place]
                clock = part["ts_us"].to_numpy(np.int64)
                times = ((clock[hit] - clock[at]) / 1e6)[hit - at < ahead]
                times = times[(times > 0) & (times < 10)]
        found = [float(times.mean()), float(np.median(times))] if len(times) else [None, None]
        return pd.DataFrame([[*part[list(keys)].iloc[0], *found, len(times)]], columns=names)

    shape = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "mean_time_to_full double", "median_time_to_full double", "n_corners bigint"])
    return share.join(rows.groupBy(*keys).applyInPandas(run, shape), list(keys), "left")


def summary_scores(t: DataFrame, laps: DataFrame, keys: Sequence[str] = VEHICLE, **timing) -> DataFrame:
    """The six summary scores of every vehicle; a score whose metric cannot be computed is null and leaves the others be.

    consistency: 100 less 20 per second of deviation; efficiency: share of time on the throttle; braking: 50 less 50 pulses an event, not below 0; throttle:
    share at full throttle; throttle timing: 100 at 0.2 s, falling 55.5 a second, not below 0; smoothness of the steering.
    """
    on = list(keys)
    parts = (
        t.select(*on).distinct()
        .join(M.consistency_by_position(laps).select(*on, "std_dev"), on, "left")
        .join(M.coasting_shares(t, keys=keys).select(*on, "throttle_pct"), on, "left")
        .join(M.brake_pulses(t, keys=keys).join(M.braking_summary(t, keys=keys), on).select(*on, (F.col("n_pulses") / F.nullif(F.col("n_events"), F.lit(0))).alias("pulses_per_event")), on, "left")
        .join(throttle_timing(t, keys=keys, **timing).select(*on, "full_throttle_pct", "median_time_to_full"), on, "left")
        .join(M.steering_smoothness(t, keys=keys).select(*on, "smoothness"), on, "left")
    )
    floor = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))
    return parts.select(
        *on,
        (100 - F.col("std_dev") * 20).alias("consistency_score"),
        F.col("throttle_pct").alias("efficiency_score"),
        floor(50 - F.col("pulses_per_event") * 50).alias("braking_score"),
        F.col("full_throttle_pct").alias("throttle_score"),
        floor(100 - (F.col("median_time_to_full") - 0.2) * 55.5).alias("throttle_timing_score"),
        F.col("smoothness").alias("smoothness_score"),
    )


def direction_check(metrics: DataFrame, standings: DataFrame, directions: Mapping[str, str] = DIRECTIONS, success: int = 4, race: Sequence[str] = RACE) -> DataFrame:
    """Per race: in how many of the metrics that both have the first finisher beats the last, and the verdict: SUCCESS from `success` wins, PARTIAL one below, else FAIL."""
    placed = metrics.join(standings.select(*race, "vehicle_number", "final_position"), [*race, "vehicle_number"])
    ends = placed.groupBy(*race).agg(*[f(F.struct(F.col(c)), "final_position")[c].alias(f"{side}_{c}") for c in directions for side, f in (("first", F.min_by), ("last", F.max_by))])
    known, wins = F.lit(0), F.lit(0)
    for c, better in directions.items():
        first, last = F.col(f"first_{c}"), F.col(f"last_{c}")
        known = known + (first.isNotNull() & last.isNotNull()).cast("int")
        wins = wins + F.coalesce((first < last if better == "lower" else first > last).cast("int"), F.lit(0))
    out = ends.select(*race, wins.cast("bigint").alias("wins"), known.cast("bigint").alias("n_metrics"))
    return out.withColumn("verdict", F.when(F.col("wins") >= success, "SUCCESS").when(F.col("wins") >= success - 1, "PARTIAL").otherwise("FAIL"))


def spearman_test(df: DataFrame, x: str, y: str, over: Sequence[str]) -> DataFrame:
    """rho, n, t and the two-sided p-value per group; p is 0 for a perfect order and null below three rows."""
    found = M.spearman(df, x, y, over)
    p = F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(t_p_value(F.col("t"), F.col("n") - 2))
    return found.withColumn("p_value", F.when(F.col("n") > 2, p))


def correlation_tests(per_lap: DataFrame, signs: Mapping[str, int] = SIGNS, least: int = 5, digits: int = 9, race: Sequence[str] = RACE) -> DataFrame:
    """One row per race and metric: within (mean over drivers of the correlation with lap time, drivers with `least` laps or more), its sign against
    the expected one, and across (rank correlation of the drivers' means) with p-value. Means that agree to `digits` places are ties, whatever the order they were added up in. per_lap: race, vehicle_number, lap_time and the metrics."""
    keys = [*race, "metric"]
    long = per_lap.unpivot([*race, "vehicle_number", "lap_time"], list(signs), "metric", "x").dropna(subset=["x", "lap_time"])
    each = long.groupBy(*keys, "vehicle_number").agg(F.count(F.lit(1)).alias("n"), M.pearson("x", "lap_time").alias("r"), F.round(F.avg("x"), digits).alias("x"))
    pace = per_lap.groupBy(*race, "vehicle_number").agg(F.round(F.avg("lap_time"), digits).alias("pace"))  # over all laps, as published
    within = each.filter(F.col("n") >= least).groupBy(*keys).agg(F.avg("r").alias("mean_r"), F.count("r").alias("n_within"))
    across = spearman_test(each.join(pace, [*race, "vehicle_number"]), "x", "pace", keys).filter(F.col("n") >= least)
    expected = F.create_map(*[F.lit(z) for item in signs.items() for z in item])[F.col("metric")]
    out = within.join(across.select(*keys, "rho", F.col("n").alias("n_across"), "p_value"), keys, "full")
    return out.withColumns({"sign_ok": F.when(F.col("mean_r").isNotNull(), F.when(F.col("mean_r") > 0, 1).otherwise(-1) == expected), "significant": F.col("p_value") < 0.05})


def generalisation(tests: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Per race: PASS with three right signs and two significant rank correlations, PARTIAL with two and one, else FAIL."""
    ok, sig = F.count_if("sign_ok"), F.count_if("significant")
    out = tests.groupBy(*race).agg(ok.alias("signs_ok"), sig.alias("n_significant"))
    verdict = F.when((F.col("signs_ok") >= 3) & (F.col("n_significant") >= 2), "PASS").when((F.col("signs_ok") >= 2) & (F.col("n_significant") >= 1), "PARTIAL")
    return out.withColumn("verdict", verdict.otherwise("FAIL"))
