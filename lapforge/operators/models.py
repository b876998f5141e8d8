"""Lap-time models: weighted relative pace, strategic adjustments, overtakes, regressions, regimes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators import RACE
from lapforge.operators.race import by_lap, by_vehicle, relative_time

ALPHA = 0.3
#: Uncertainty in seconds by regime (fixed values of the model).
UNCERTAINTY = {"green": 1.9, "yellow": 2.5, "restart": 7.0}
#: Effects of the strategic model: per second of gap ahead, of pressure from behind, per place.
GAP_EFFECT, PRESSURE_EFFECT, POSITION_EFFECT = -0.05, 0.05, 0.05
#: Rows of a part that trees are fitted on.
ROWS_PER_TASK = 200_000


def relative_fit(laps: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """(vehicle, mean_relative, last_relative, baseline): what the weighted model knows of each vehicle."""
    rel = relative_time(laps, race)
    per_lap = rel.groupBy(*race, "lap").agg(F.first("field_median").alias("m"))
    base = per_lap.groupBy(*race).agg(F.median("m").alias("baseline"))
    fit = rel.groupBy(*race, "vehicle_number").agg(F.avg("relative_time").alias("mean_relative"), F.max_by("relative_time", "lap").alias("last_relative"))
    return fit.join(base, list(race))


def relative_predict(fit: DataFrame, laps: DataFrame, alpha: float = ALPHA, race: Sequence[str] = RACE) -> DataFrame:
    """Predictions lap after lap, each the next one's previous value.

    p = alpha * previous + (1 - alpha) * mean, so the k-th prediction is mean + alpha^k (last - mean).
    """
    k = F.row_number().over(by_vehicle(race))
    p = F.col("mean_relative") + F.pow(F.lit(alpha), k) * (F.col("last_relative") - F.col("mean_relative"))
    return laps.join(fit, [*race, "vehicle_number"]).withColumn("predicted_relative", p)


def online_update(laps: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """State after each vehicle's laps, seen one at a time: previous value, and mean moving a tenth towards it."""
    listed = relative_time(laps, race).groupBy(*race, "vehicle_number").agg(F.array_sort(F.collect_list(F.struct("lap", "relative_time"))).alias("s"))
    start = F.struct(F.lit(0.0).alias("prev"), F.lit(0.0).alias("mean"))
    state = F.aggregate("s", start, lambda a, x: F.struct(x["relative_time"].alias("prev"), (0.9 * a["mean"] + 0.1 * x["relative_time"]).alias("mean")))
    return listed.select(*race, "vehicle_number", state["prev"].alias("prev_relative"), state["mean"].alias("mean_relative"))


def regime_of(is_yellow: Column, median: Column, baseline: Column) -> Column:
    return F.when(is_yellow > 0, "yellow").when(median > baseline + 20, "restart").when(median > baseline + 5, "yellow").otherwise("green")


def lap_regimes(laps: DataFrame, early: int = 10, race: Sequence[str] = RACE) -> DataFrame:
    """Per lap: statistics of the field and its regime against the median of the early laps' medians."""
    per_lap = laps.groupBy(*race, "lap").agg(
        F.median("lap_time").alias("field_median"), F.stddev_samp("lap_time").alias("field_std"), F.max("is_under_yellow").alias("is_yellow"), F.count(F.lit(1)).alias("n_cars")
    )
    base = F.median(F.when(F.col("lap") <= early, F.col("field_median"))).over(Window.partitionBy(*race))
    return per_lap.withColumn("baseline", base).withColumn("regime", regime_of(F.col("is_yellow"), F.col("field_median"), F.col("baseline")))


def uncertainty(regime: Column, yellow_probability: Column | None = None) -> Column:
    base = F.when(regime == "green", UNCERTAINTY["green"]).when(regime == "yellow", UNCERTAINTY["yellow"]).otherwise(UNCERTAINTY["restart"])
    return base if yellow_probability is None else F.when(yellow_probability > 0.5, base * 1.5).otherwise(base)


def confidence(value: Column) -> Column:
    return F.when(value <= 2.0, "high").when(value <= 3.0, "medium").otherwise("low")


def regime_means(laps: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Each vehicle's mean relative time in each regime, its overall mean where it has none there."""
    rel = relative_time(laps, race).join(lap_regimes(laps, race=race).select(*race, "lap", "regime"), [*race, "lap"])
    overall = rel.groupBy(*race, "vehicle_number").agg(F.avg("relative_time").alias("overall"))
    per = rel.groupBy(*race, "vehicle_number", "regime").agg(F.avg("relative_time").alias("mean"))
    kinds = F.explode(F.array(*[F.lit(x) for x in UNCERTAINTY])).alias("regime")
    grid = overall.select(*race, "vehicle_number", "overall", kinds)
    return grid.join(per, [*race, "vehicle_number", "regime"], "left").select(*race, "vehicle_number", "regime", F.coalesce("mean", "overall").alias("predicted_relative"))


def walk_forward_regimes(laps: DataFrame, alpha: float = ALPHA, race: Sequence[str] = RACE) -> DataFrame:
    """Each lap from what was known a lap before: previous regime's field median plus weighted relative pace."""
    rel = relative_time(laps, race)
    w = by_vehicle(race)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    known = rel.withColumns({"prev": F.lag("relative_time").over(w), "mean": F.avg("relative_time").over(past), "prev_median": F.lag("field_median").over(w)})
    predicted = known.filter("prev is not null").withColumn("predicted", F.col("prev_median") + alpha * F.col("prev") + (1 - alpha) * F.col("mean"))
    return predicted.withColumn("error", F.col("lap_time") - F.col("predicted"))


def strategic_fit(features: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """base_pace, aggression (share of laps that close the gap by over 0.3 s), mean gap ahead clipped to 0..30, last relative time."""
    rel = relative_time(features, race)
    return rel.groupBy(*race, "vehicle_number").agg(
        F.avg("relative_time").alias("base_pace"),
        (F.count_if(F.col("gap_delta_ahead") < -0.3) / F.count(F.lit(1))).alias("aggression"),
        F.avg(F.least(F.greatest("gap_to_ahead", F.lit(0.0)), F.lit(30.0))).alias("mean_gap_ahead"),
        F.max_by("relative_time", "lap").alias("last_relative"),
    )


def strategic_predict(fit: DataFrame, features: DataFrame, alpha: float = ALPHA, race: Sequence[str] = RACE) -> DataFrame:
    """Weighted pace with adjustments for the gap ahead, pressure and position; each prediction is the next one's
    previous value. The adjustments do not depend on the state, so the fold over a vehicle's laps is linear:
    p_k = alpha p_(k-1) + c_k."""
    gap = F.least(F.greatest(F.col("gap_to_ahead") - F.col("mean_gap_ahead"), F.lit(-5.0)), F.lit(5.0))
    pressure = F.when(F.col("gap_to_behind") < 5, PRESSURE_EFFECT * (5 - F.col("gap_to_behind")) / 5).otherwise(0.0)
    place = F.when(F.col("position") > 5, POSITION_EFFECT * (F.col("position") - 5) * 0.1).otherwise(0.0)
    c = (1 - alpha) * F.col("base_pace") + GAP_EFFECT * gap + pressure + place
    regime = F.when(F.col("gap_to_ahead") < 1, "close_battle").when(F.col("gap_to_behind") < 2, "pressure").otherwise("green")
    rows = features.join(fit, [*race, "vehicle_number"]).select(*race, "vehicle_number", "lap", "last_relative", c.alias("c"), regime.alias("regime"))
    listed = rows.groupBy(*race, "vehicle_number").agg(F.first("last_relative").alias("prev"), F.array_sort(F.collect_list(F.struct("lap", "c", "regime"))).alias("s"))
    start = F.struct(F.col("prev").alias("p"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        p = alpha * acc["p"] + x["c"]
        return F.struct(p.alias("p"), F.array_append(acc["out"], p).alias("out"))

    folded = listed.withColumn("p", F.aggregate("s", start, step, lambda a: a["out"]))
    flat = folded.select(*race, "vehicle_number", F.explode(F.arrays_zip("s", "p")).alias("z"))
    return flat.select(
        *race,
        "vehicle_number",
        F.col("z.s.lap").alias("lap"),
        F.col("z.p").alias("predicted_relative"),
        F.col("z.s.regime").alias("regime"),
        F.when(F.col("z.s.regime") == "green", 1.7).otherwise(2.5).alias("uncertainty"),
    )


def racing_style(fit: DataFrame) -> DataFrame:
    style = F.when(F.col("aggression") > 0.3, "aggressive").when(F.col("aggression") > 0.15, "balanced").otherwise("patient")
    pace = F.when(F.col("base_pace") < 0, "faster").otherwise("slower")
    return fit.withColumn("style", F.concat(style, F.lit(", "), pace, F.lit(" than the field")))


def overtakes(features: DataFrame, from_lap: int, total_laps: int, window: int = 5, race: Sequence[str] = RACE) -> DataFrame:
    """Predicted final positions: a car gains a place if its pace of the last laps closes its gap in time."""
    rel = relative_time(features.filter(F.col("lap") <= from_lap), race)
    recent = F.when(F.col("lap") > from_lap - window, F.col("relative_time"))
    pace = rel.groupBy(*race, "vehicle_number").agg(
        F.coalesce(F.avg(recent), F.avg("relative_time")).alias("pace"), F.stddev_samp(recent).alias("std"), F.count(recent).alias("n")
    )
    now = features.filter(F.col("lap") == from_lap).select(*race, "vehicle_number", "position", "gap_to_ahead").join(pace, [*race, "vehicle_number"])
    delta = F.col("pace") - F.lag("pace").over(Window.partitionBy(*race).orderBy("position"))
    laps_needed = F.col("gap_to_ahead") / F.abs(F.col("__d"))
    can = F.coalesce((F.col("__d") < -0.1) & (laps_needed < total_laps - from_lap), F.lit(False))
    gain = F.when(can, 1).otherwise(0)
    return now.withColumn("__d", delta).select(
        *race,
        "vehicle_number",
        F.col("position").alias("current_position"),
        F.greatest(F.lit(1).cast("bigint"), F.col("position") - gain).alias("predicted_position"),
        F.when(can, F.ceil(laps_needed)).alias("laps_to_overtake"),
        F.when(F.col("n") > 1, F.greatest(F.lit(0.3), 1 - F.col("std") / 3)).otherwise(0.5).alias("confidence"),
    )


def predicted_podium(predicted: DataFrame, places: int = 3, race: Sequence[str] = RACE) -> DataFrame:
    """The first places by predicted, then current position."""
    order = Window.partitionBy(*race).orderBy("predicted_position", "current_position")
    return predicted.withColumn("place", F.row_number().over(order).cast("bigint")).filter(F.col("place") <= places)


def runner_up(features: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """The second car of each race against the first: gap, late degradation, time it cost, and whether a potential
    of 0.15 s a lap would have been enough."""
    last = features.groupBy(*race, "vehicle_number").agg(
        F.max_by("position", "lap").alias("position"),
        F.max("cumulative_time").alias("time"),
        F.max("lap").alias("laps"),
        F.avg(F.when(F.col("lap").between(3, 5), F.col("lap_time"))).alias("early"),
        F.avg(F.when(F.col("lap") >= 20, F.col("lap_time"))).alias("late"),
    )
    pick = lambda p: last.filter(F.col("position") == p)
    order = Window.partitionBy(*race).orderBy(F.desc("laps"), "time", "vehicle_number")
    first = pick(1).withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*race, F.col("vehicle_number").alias("winner"), F.col("time").alias("winner_time"))
    second = pick(2).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    met = second.join(first, list(race))
    gap = F.col("time") - F.col("winner_time")
    per_lap = F.greatest((F.col("late") - F.col("early")) / F.greatest(F.col("laps") - 5, F.lit(1)), F.lit(0.0))
    lost = per_lap * F.col("laps") * (F.col("laps") + 1) / 2
    return met.select(*race, "winner", F.col("vehicle_number").alias("runner_up"), gap.alias("gap"), lost.alias("time_lost"), (F.col("laps") * 0.15 > gap).alias("would_have_won"))


def technique_potential(per_lap: DataFrame, impact: dict[str, float], race: Sequence[str] = RACE, early: int = 5, late: int = 20) -> DataFrame:
    """How far each technique metric falls off from the early to the late laps, in seconds by an impact table."""
    long = per_lap.unpivot([*race, "vehicle_number", "lap"], list(impact), "metric", "x")
    ends = long.groupBy(*race, "vehicle_number", "metric").agg(F.avg(F.when(F.col("lap") <= early, F.col("x"))).alias("early"), F.avg(F.when(F.col("lap") >= late, F.col("x"))).alias("late"))
    table = F.create_map(*[F.lit(x) for pair in impact.items() for x in pair])
    return ends.select(*race, "vehicle_number", "metric", F.greatest((F.col("late") - F.col("early")) * table[F.col("metric")], F.lit(0.0)).alias("potential"))


def winner_forecast(features: DataFrame, from_lap: int, total_laps: int, race: Sequence[str] = RACE) -> DataFrame:
    """The car with the least cumulative time plus mean pace over the laps left, and its margin."""
    at = features.filter(F.col("lap") <= from_lap).groupBy(*race, "vehicle_number").agg(F.max("cumulative_time").alias("so_far"), F.avg("lap_time").alias("pace"))
    total = at.withColumn("total", F.col("so_far") + F.col("pace") * (total_laps - from_lap))
    ranked = total.groupBy(*race).agg(F.array_sort(F.collect_list(F.struct("total", "vehicle_number"))).alias("r"))  # a race's cars
    return ranked.select(*race, F.col("r")[0]["vehicle_number"].alias("winner"), (F.get("r", F.lit(1))["total"] - F.col("r")[0]["total"]).alias("margin"))


OLS_FEATURES = ("lap", "position", "laps_remaining")


def least_norm(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of centred least squares; collinear columns share the slope."""
    mean = x.mean(axis=0)
    beta = np.linalg.lstsq(x - mean, y - y.mean(), rcond=None)[0]
    return float(y.mean() - mean @ beta), beta


def driver_ols(features: DataFrame, columns: Sequence[str] = OLS_FEATURES, race: Sequence[str] = RACE) -> DataFrame:
    """Coefficients per vehicle with three laps or more. A group is one vehicle's laps in one race."""
    keys = [*race, "vehicle_number"]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna()
        if len(frame) < 3:
            return pd.DataFrame(columns=[*keys, "n", "intercept", *columns])
        intercept, beta = least_norm(frame[list(columns)].to_numpy(float), frame["lap_time"].to_numpy(float))
        return pd.DataFrame([[*frame[keys].iloc[0], len(frame), intercept, *beta]], columns=[*keys, "n", "intercept", *columns])

    schema = ", ".join([f"{k} bigint" for k in keys] + ["n bigint", "intercept double"] + [f"{c} double" for c in columns])
    return features.select(*keys, *columns, "lap_time").groupBy(*keys).applyInPandas(fit, schema)


def two_feature_ols(features: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """lap_time on lap and position per vehicle by normal equations: sums in one aggregation, no Python.

    laps_remaining is a function of lap, so predictions equal those of the three-column model.
    """
    x, z, y = F.col("lap").cast("double"), F.col("position").cast("double"), F.col("lap_time")
    s = features.groupBy(*race, "vehicle_number").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(z).alias("mz"), F.avg(y).alias("my"),
        F.covar_pop(x, x).alias("xx"), F.covar_pop(z, z).alias("zz"), F.covar_pop(x, z).alias("xz"), F.covar_pop(x, y).alias("xy"), F.covar_pop(z, y).alias("zy"),
    )
    det = F.nullif(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"), F.lit(0.0))
    a = (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det
    b = (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det
    fitted = s.filter("n >= 3").withColumns({"lap_coef": a, "position_coef": b})
    return fitted.withColumn("intercept", F.col("my") - F.col("lap_coef") * F.col("mx") - F.col("position_coef") * F.col("mz")).select(*race, "vehicle_number", "n", "intercept", "lap_coef", "position_coef")


def tree_rows(features: DataFrame, columns: Sequence[str], target: str = "lap_time") -> DataFrame:
    """What trees are fitted on: columns and target in as few parts as the number of rows asks for, since every tree passes over all parts
    once a level. Part and place of a row follow from its values, so a seeded fit does not depend on how the rows came.
    """
    named = [*dict.fromkeys([*columns, target])]
    rows = features.select(*named)
    return rows.repartition(max(1, -(-rows.count() // ROWS_PER_TASK)), *named).sortWithinPartitions(*named)


def boosted_laps(features: DataFrame, columns: Sequence[str], trees: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 42):
    """A gradient-boosted tree pipeline for lap_time, fitted by Spark ML. features is read twice: keep what is dear to compute."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip"), GBTRegressor(labelCol="lap_time", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)]
    rows = tree_rows(features, columns).persist()
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def yellow_forest(per_lap: DataFrame, columns: Sequence[str], trees: int = 50, depth: int = 3, seed: int = 42):
    """A random forest for next_yellow, fitted by Spark ML; None with fewer than five laps or one class."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = per_lap.agg(F.count(F.lit(1)), F.min("next_yellow"), F.max("next_yellow")).first()
    if known[0] < 5 or known[1] == known[2]:
        return None
    stages = [VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip"), RandomForestClassifier(labelCol="next_yellow", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(per_lap)


def field_statistics(laps: DataFrame, churn: DataFrame, yellow: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Per-lap features of the yellow-flag model."""
    per_lap = laps.groupBy(*race, "lap").agg(
        F.median("lap_time").alias("field_median"), F.stddev_samp("lap_time").alias("field_std"), F.min("lap_time").alias("field_min"), F.max("lap_time").alias("field_max"), F.count(F.lit(1)).alias("n_cars")
    )
    on = [*race, "lap"]
    return per_lap.join(churn, on, "left").join(yellow, on, "left").fillna(0, ["position_churn", "next_yellow", "is_yellow", "field_std"])


def evaluate(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rmse, mae, mean and deviation of the error, rmse with weights falling 5 % a place (not divided by their sum)."""
    weight = F.greatest(F.lit(0.1), 1 - 0.05 * (F.col("position") - 1))
    e = F.col("error")
    return errors.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("std"), F.sqrt(F.avg(weight * e * e)).alias("weighted_rmse"), F.count(F.lit(1)).alias("n")
    )
