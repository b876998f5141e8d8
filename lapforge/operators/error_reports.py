"""Reports on prediction errors and data quality: window widths, best and worst, trends, event features, issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators import RACE
from lapforge.operators.metric_validation import spearman_test
from lapforge.operators.metrics import spearman
from lapforge.operators.race import by_vehicle
from lapforge.operators.selection import global_rank

WIDTHS = (3, 5, 8, 10)
CHECKS = ("throttle_ok", "brake_ok", "force_ok")


def window_errors(relative: DataFrame, widths: Sequence[int] = WIDTHS, alpha: float = 0.3, race: Sequence[str] = RACE) -> DataFrame:
    """One-step errors of predictions from the last `width` laps, for all widths: race, vehicle_number, lap, position, width, predicted, error.

    The mean of a width is a difference of two prefix sums, and all of them are frames of one window, so more widths need no further pass. A lap counts from
    the first one with `width` laps before it. relative: race, vehicle_number, lap, position, relative_time without nulls.
    """
    w = by_vehicle(race)
    upto = lambda k: w.rowsBetween(Window.unboundedPreceding, -1 - k)
    sums = {f"__s{k}": F.coalesce(F.sum("relative_time").over(upto(k)), F.lit(0.0)) for k in (0, *widths)}
    base = relative.withColumns({**sums, "__n": F.count("relative_time").over(upto(0)), "__prev": F.lag("relative_time").over(w)})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("width"), ((F.col("__s0") - F.col(f"__s{k}")) / k).alias("mean")) for k in widths])).alias("__e")
    rows = base.select(*race, "vehicle_number", "lap", "position", "relative_time", "__n", "__prev", each).filter(F.col("__n") >= F.col("__e.width"))
    predicted = alpha * F.col("__prev") + (1 - alpha) * F.col("__e.mean")
    return rows.select(*race, "vehicle_number", "lap", "position", F.col("__e.width").alias("width"), predicted.alias("predicted"), (F.col("relative_time") - predicted).alias("error"))


def best_and_worst(errors: DataFrame, what: str, k: int = 5, digits: int = 9, race: Sequence[str] = RACE) -> DataFrame:
    """The k best and k worst values of a column (lap, vehicle_number) of each race by root mean square error: a top-k report.

    side is best or worst, place counts from 1; ties (to `digits` places) go to the smaller value.
    """
    e = F.col("error")
    each = errors.groupBy(*race, what).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg("position").alias("avg_position"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*race)
    level = F.round("rmse", digits)
    placed = each.withColumns({"best": F.row_number().over(w.orderBy(level, what)), "worst": F.row_number().over(w.orderBy(F.desc(level), what))})
    side = F.explode(F.array(F.struct(F.lit("best").alias("side"), F.col("best").alias("place")), F.struct(F.lit("worst").alias("side"), F.col("worst").alias("place")))).alias("__s")
    return placed.select(*race, what, "rmse", "mae", "avg_position", "n", side).select("*", "__s.side", F.col("__s.place").cast("bigint").alias("place")).drop("__s").filter(F.col("place") <= k)


def error_by_position(errors: DataFrame, digits: int = 9, race: Sequence[str] = RACE) -> DataFrame:
    """Rank correlation, with p-value, of the drivers' mean position and their error, per race."""
    e = F.col("error")
    each = errors.groupBy(*race, "vehicle_number").agg(F.round(F.sqrt(F.avg(e * e)), digits).alias("rmse"), F.round(F.avg("position"), digits).alias("avg_position"))
    return spearman_test(each, "avg_position", "rmse", race)


def trend_races(validation: DataFrame, cells: int = 10, points: int = 3, digits: int = 9, race: Sequence[str] = RACE) -> DataFrame:
    """Races by how steadily errors fall with more warm-up and rise with the horizon: warmup_trend (mean of minus the rank correlation of warm-up and error, by
    horizon), horizon_trend (mean of that of horizon and error, by warm-up), their product, mae, n_points and place.

    A race needs `cells` pairs of warm-up and horizon, a correlation `points` values. A trend without variation counts for nothing; a race without both trends has no row.
    """
    grid = validation.groupBy(*race, "warmup_laps", "horizon").agg(F.round(F.avg(F.abs("error")), digits).alias("mae"))
    size = F.count(F.lit(1)).over(Window.partitionBy(*race))
    grid = grid.withColumn("n_points", size).filter(F.col("n_points") >= cells)
    warm = spearman(grid, "warmup_laps", "mae", [*race, "horizon"]).filter(F.col("n") >= points).groupBy(*race).agg(F.avg(-F.col("rho")).alias("warmup_trend"))
    ahead = spearman(grid, "horizon", "mae", [*race, "warmup_laps"]).filter(F.col("n") >= points).groupBy(*race).agg(F.avg("rho").alias("horizon_trend"))
    overall = validation.groupBy(*race).agg(F.avg(F.abs("error")).alias("mae"))
    counts = grid.groupBy(*race).agg(F.first("n_points").alias("n_points"))
    met = warm.join(ahead, list(race)).join(overall, list(race)).join(counts, list(race)).filter("warmup_trend is not null and horizon_trend is not null")
    scored = met.withColumn("score", F.col("warmup_trend") * F.col("horizon_trend"))
    return global_rank(scored, [F.desc(F.round("score", digits)), *[F.col(c) for c in race]])


def override_positions(standings: DataFrame, analytics: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """standings with final_position replaced by the analytics table's at its race's last lap, for the drivers it has there.

    Positions may then occur twice in a race, as published. Of several such rows of a driver the largest position counts.
    """
    last = F.max("lap").over(Window.partitionBy(*race))
    given = analytics.withColumn("__last", last).filter("lap = __last").groupBy(*race, "vehicle_number").agg(F.max("position").alias("__given"))
    out = standings.join(given, [*race, "vehicle_number"], "left")
    return out.withColumns({"final_position": F.coalesce("__given", "final_position").cast("bigint"), "overridden": F.col("__given").isNotNull()}).drop("__given")


def event_features(features: DataFrame, churn: DataFrame, yellow: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Per race and lap what the yellow-flag model looks at, with the flag a lap later: gaps, fights, places changed, spread of lap times.

    churn and yellow join on the left; what they lack is 0. A deviation of one car is 0.
    """
    per = features.groupBy(*race, "lap").agg(
        F.avg("gap_to_ahead").alias("avg_gap"), F.coalesce(F.stddev_samp("gap_to_ahead"), F.lit(0.0)).alias("gap_std"), F.count_if("is_fighting").alias("fighting_count"),
        F.coalesce(F.stddev_samp("lap_time"), F.lit(0.0)).alias("lap_time_std"), (F.max("lap_time") - F.min("lap_time")).alias("lap_time_spread"),
    )
    on = [*race, "lap"]
    out = per.join(churn, on, "left").join(yellow.select(*on, "next_yellow"), on, "left")
    return out.withColumns({"position_churn": F.coalesce("position_churn", F.lit(0)).cast("bigint"), "next_yellow": F.coalesce("next_yellow", F.lit(0))})


EVENT_COLUMNS = ("avg_gap", "gap_std", "fighting_count", "position_churn", "lap_time_std", "lap_time_spread")


def yellow_now(model, events: DataFrame) -> DataFrame:
    """events with the probability of a yellow flag a lap later, places changed taken as none, since the lap before is not known to a field as it stands; 0 without a model."""
    from pyspark.ml.functions import vector_to_array

    still = events.withColumn("position_churn", F.lit(0).cast("bigint"))
    if model is None:
        return still.withColumn("probability", F.lit(0.0))
    scored = model.transform(still).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(*events.columns, "probability")


def race_issues(profile: DataFrame, structure: DataFrame, timing: DataFrame, checks: DataFrame, missing: float = 10.0, outliers: float = 5.0, samples: float = 500.0, race: Sequence[str] = RACE) -> DataFrame:
    """One row per race with all that its audits found: `missing:<signal>`, `outliers:<signal>`, `few samples`, `gaps`, `failed:<check>`, sorted; empty where nothing is wrong.

    profile: race, signal, missing_pct, outlier_pct; structure: samples_per_lap per vehicle; timing: n_gaps per vehicle; checks: a boolean per check.
    A check that cannot be computed has not failed.
    """
    said = lambda test, text: F.when(test, text)
    found = profile.select(
        *race,
        F.explode(F.array_compact(F.array(said(F.col("missing_pct") > missing, F.concat(F.lit("missing:"), "signal")), said(F.col("outlier_pct") > outliers, F.concat(F.lit("outliers:"), "signal"))))).alias("issue"),
    )
    dense = structure.groupBy(*race).agg((F.sum(F.col("samples_per_lap") * F.col("n_laps")) / F.sum("n_laps")).alias("density")).filter(F.col("density") < samples).select(*race, F.lit("few samples").alias("issue"))
    gaps = timing.groupBy(*race).agg(F.sum("n_gaps").alias("k")).filter("k > 0").select(*race, F.lit("gaps").alias("issue"))
    failed = checks.select(*race, F.explode(F.array_compact(F.array(*[said(~F.col(c), F.lit(f"failed:{c}")) for c in CHECKS]))).alias("issue"))
    every: Column = F.sort_array(F.collect_list("issue"))  # a handful a race
    issues = found.unionByName(dense).unionByName(gaps).unionByName(failed).groupBy(*race).agg(every.alias("issues"))
    return structure.select(*race).distinct().join(issues, list(race), "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
