"""Validation of predictions: expanding windows, rank errors, NDCG, sweeps, weighted errors, claims."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators import RACE
from lapforge.operators.race import by_vehicle
from lapforge.operators.selection import global_rank

WARMUPS, HORIZONS = (3, 5, 8, 10, 15), (1, 2, 3, 5)


def expanding_validation(
    relative: DataFrame, warmups: Sequence[int] = WARMUPS, horizons: Sequence[int] = HORIZONS, alpha: float = 0.3, strict: bool = False, race: Sequence[str] = RACE
) -> DataFrame:
    """Predict lap k + h from the laps up to k, for every k, warm-up and horizon.

    One window holds the mean of all laps up to k; targets are rows further down, so nothing is fitted in a loop.
    The target's own previous lap is used (for h > 1 it lies after k, as in the published figures); strict takes
    lap k's value instead. relative: race, vehicle_number, lap, position, relative_time.
    """
    w = by_vehicle(race)
    mean = F.avg("relative_time").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = relative.withColumns({"mean_past": mean, "prev": F.lag("relative_time").over(w)})
    keys = [*race, "vehicle_number"]
    train = base.select(*keys, F.col("lap").alias("prediction_lap"), "mean_past", F.col("relative_time").alias("__now"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    train = train.withColumn("target_lap", F.col("prediction_lap") + F.col("horizon"))
    target = base.select(*keys, F.col("lap").alias("target_lap"), "position", F.col("relative_time").alias("actual"), "prev")
    met = train.join(target, [*keys, "target_lap"])
    prev = F.col("__now") if strict else F.col("prev")
    scored = met.withColumn("predicted", alpha * prev + (1 - alpha) * F.col("mean_past")).withColumn("error", F.col("actual") - F.col("predicted"))
    warm = F.explode(F.filter(F.array(*[F.lit(x) for x in warmups]), lambda x: x <= F.col("prediction_lap"))).alias("warmup_laps")
    return scored.select(*keys, "prediction_lap", "target_lap", "horizon", "position", "actual", "predicted", "error", warm)


def position_weight(position: Column, mode: str = "podium") -> Column:
    if mode == "podium":
        return F.when(position <= 3, 3.0).when(position <= 5, 1.5).otherwise(1.0)
    if mode == "exponential":
        return 1 / (1 + 0.1 * (position - 1))
    return F.lit(1.0)


def weighted_heatmap(validation: DataFrame, mode: str = "podium", horizons: Sequence[int] = HORIZONS, race: Sequence[str] = RACE) -> DataFrame:
    """Weighted mean absolute error, one row a warm-up and one column a horizon."""
    w = position_weight(F.col("position"), mode)
    cells = validation.groupBy(*race, "warmup_laps", "horizon").agg((F.sum(w * F.abs("error")) / F.sum(w)).alias("mae"))
    return cells.groupBy(*race, "warmup_laps").pivot("horizon", list(horizons)).agg(F.first("mae"))


def driver_stats(validation: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Errors per vehicle with its worst lap: one aggregation."""
    e = F.col("error")
    return validation.groupBy(*race, "vehicle_number").agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg("position").alias("avg_position"), F.count(F.lit(1)).alias("n"),
        F.max_by("target_lap", F.struct(F.round(F.abs(e), 9), (-F.col("target_lap")).alias("first"))).alias("worst_lap"), F.max(F.abs(e)).alias("worst_error"),
    )


def alpha_sweep(relative: DataFrame, alphas: Sequence[float], race: Sequence[str] = RACE) -> DataFrame:
    """One-step errors for each weight, all weights in one pass."""
    w = by_vehicle(race)
    base = relative.withColumns({"prev": F.lag("relative_time").over(w), "mean": F.avg("relative_time").over(w.rowsBetween(Window.unboundedPreceding, -1))}).filter("prev is not null")
    rows = base.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    e = F.col("relative_time") - (F.col("alpha") * F.col("prev") + (1 - F.col("alpha")) * F.col("mean"))
    return rows.groupBy("alpha").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def stratified_errors(validation: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Errors by band of position, closed on the right."""
    p = F.col("position")
    band = F.when(p <= 5, "1-5").when(p <= 10, "6-10").when(p <= 15, "11-15").otherwise("16+")
    return validation.withColumn("band", band).groupBy("band").agg(F.avg(F.abs("error")).alias("mae"), F.count(F.lit(1)).alias("n"))


def inverse_position_rmse(validation: DataFrame, by: Sequence[str]) -> DataFrame:
    w = 1.0 / F.col("position")
    return validation.groupBy(*by).agg(F.sqrt(F.sum(w * F.col("error") * F.col("error")) / F.sum(w)).alias("weighted_rmse"))


def position_errors(predicted: DataFrame, standings: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Mean rank error, winner and podium hits of predicted final positions."""
    met = predicted.join(standings.select(*race, "vehicle_number", "final_position"), [*race, "vehicle_number"])
    p, f = F.col("predicted_position"), F.col("final_position")
    return met.groupBy(*race).agg(F.avg(F.abs(p - f)).alias("mean_error"), F.count_if((p == 1) & (f == 1)).alias("winner_hits"), F.count_if((p <= 3) & (f <= 3)).alias("podium_hits"))


def top_k_quality(standings: DataFrame, forecast: DataFrame, k: int = 5, race: Sequence[str] = RACE) -> DataFrame:
    """Overlap and NDCG of the predicted first k with the final first k.

    Relevance of the car in place i is k - i, discounted by log2(i + 2). standings: final_position; forecast:
    prediction_lap, predicted_place. Only the first k of each side are joined.
    """
    actual = standings.filter(F.col("final_position") <= k).select(*race, "vehicle_number", (k + 1 - F.col("final_position")).alias("rel"))
    guess = forecast.filter(F.col("predicted_place") <= k).select(*race, "prediction_lap", "vehicle_number", "predicted_place")
    met = guess.join(actual, [*race, "vehicle_number"], "left")
    ideal = F.lit(sum((k - i) / math.log2(i + 2) for i in range(k)))
    gain = F.coalesce(F.col("rel"), F.lit(0)) / F.log2(F.col("predicted_place") + 1)
    hits = F.count("rel")
    return met.groupBy(*race, "prediction_lap").agg(hits.alias("correct"), (hits / k).alias("set_accuracy"), (F.sum(gain) / ideal).alias("ndcg"))


def forecast_order(features: DataFrame, laps_at: Sequence[int], race: Sequence[str] = RACE) -> DataFrame:
    """The order of cars at several laps, taken as the forecast of the final order."""
    at = features.filter(F.col("lap").isin(list(laps_at)))
    return at.select(*race, "vehicle_number", F.col("lap").alias("prediction_lap"), F.col("position").alias("predicted_place"))


def best_race(validation: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Races by mean absolute error, best first."""
    mae = validation.groupBy(*race).agg(F.avg(F.abs("error")).alias("mae"))
    return global_rank(mae, [F.round("mae", 9), *[F.col(c) for c in race]])


def claim_check(actual: Column, expected: Column, tolerance: float) -> Column:
    return F.when(actual == expected, "VERIFIED").when(F.abs(actual - expected) <= tolerance * F.abs(expected), "APPROXIMATE").otherwise("INCORRECT")
