"""Race core: lap times, positions, gaps, lags and filters as window expressions.

Every window is partitioned by the race columns first; a table that is already dealt out by race needs
no further shuffle for any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lapforge.functions.scalars import seconds_between
from lapforge.operators import RACE

NO_CAR_BEHIND, GAP_CAP = 999.0, 60.0
LAP_SENTINEL = 1000


def by_vehicle(race=RACE) -> WindowSpec:
    return Window.partitionBy(*race, "vehicle_number").orderBy("lap")


def by_lap(race=RACE) -> WindowSpec:
    return Window.partitionBy(*race, "lap")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order; ties must be broken by the order itself."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def lap_time_diff(laps: DataFrame, race=RACE) -> DataFrame:
    """lap_time as the time since the vehicle's previous row: a missing lap gives a two-lap time."""
    return laps.withColumn("lap_time", seconds_between(F.col("ts_us"), F.lag("ts_us").over(by_vehicle(race))))


def valid_laps(laps: DataFrame, least: float = 60.0, most: float = 300.0, max_lap: int | None = None) -> DataFrame:
    """Laps after the first with a plausible time (both bounds open) and number."""
    out = laps.filter((F.col("lap") < LAP_SENTINEL) & (F.col("lap") > 1) & (F.col("lap_time") > least) & (F.col("lap_time") < most))
    return out.filter(F.col("lap") <= max_lap) if max_lap is not None else out


def cumulative_time(laps: DataFrame, race=RACE) -> DataFrame:
    run = by_vehicle(race).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return laps.withColumn("cumulative_time", F.sum("lap_time").over(run))


def race_position(laps: DataFrame, race=RACE) -> DataFrame:
    """Position at each lap: vehicles that complete more laps of the whole race first, then by time."""
    most = F.max("lap").over(Window.partitionBy(*race, "vehicle_number"))
    order = by_lap(race).orderBy(F.desc("__most"), "ts_us", "vehicle_number")
    return laps.withColumn("__most", most).withColumn("position", F.row_number().over(order).cast("bigint")).drop("__most")


def gaps(positioned: DataFrame, race=RACE) -> DataFrame:
    """gap_to_leader, gap_to_ahead (0 for the first), gap_to_behind (capped): seconds at the line.

    Positions are not in time order, so gaps to a neighbour may be negative.
    """
    order = by_lap(race).orderBy("position")
    ts = F.col("ts_us")
    return positioned.withColumns(
        {
            "gap_to_leader": seconds_between(ts, F.min("ts_us").over(by_lap(race))),
            "gap_to_ahead": F.coalesce(seconds_between(ts, F.lag("ts_us").over(order)), F.lit(0.0)),
            "gap_to_behind": F.least(F.coalesce(seconds_between(F.lead("ts_us").over(order), ts), F.lit(NO_CAR_BEHIND)), F.lit(GAP_CAP)),
        }
    )


def gap_deltas(gapped: DataFrame, window: int = 3, race=RACE) -> DataFrame:
    """Change of the gaps over a number of rows (0 where there are none), and who is fighting."""
    w = by_vehicle(race)
    return gapped.withColumns(
        {
            "gap_delta_ahead": F.coalesce(F.col("gap_to_ahead") - F.lag("gap_to_ahead", window).over(w), F.lit(0.0)),
            "gap_delta_behind": F.coalesce(F.col("gap_to_behind") - F.lag("gap_to_behind", window).over(w), F.lit(0.0)),
            "is_fighting": (F.col("gap_to_ahead") < 1.0) | (F.col("gap_to_behind") < 1.0),
        }
    )


def lag_features(laps: DataFrame, race=RACE) -> DataFrame:
    """prev_lap_time, rolling_avg_3 of the three rows before, lap_time_diff (0 at the start)."""
    w = by_vehicle(race)
    return laps.withColumns(
        {
            "prev_lap_time": F.lag("lap_time").over(w),
            "rolling_avg_3": F.avg("lap_time").over(w.rowsBetween(-3, -1)),
            "lap_time_diff": F.coalesce(F.col("lap_time") - F.lag("lap_time").over(w), F.lit(0.0)),
        }
    )


def race_context(laps: DataFrame, total_laps: int) -> DataFrame:
    progress = F.col("lap") / F.lit(total_laps)
    return laps.withColumns({"laps_remaining": F.lit(total_laps) - F.col("lap"), "race_progress": progress, "fuel_load_estimate": 1 - progress})


def relative_time(laps: DataFrame, race=RACE) -> DataFrame:
    """field_median of the lap and the lap time relative to it."""
    median = F.median("lap_time").over(by_lap(race))
    return laps.withColumn("field_median", median).withColumn("relative_time", F.col("lap_time") - F.col("field_median"))


def prev_relative(laps: DataFrame, race=RACE) -> DataFrame:
    return laps.withColumn("prev_relative", F.lag("relative_time").over(by_vehicle(race)))


def position_churn(positioned: DataFrame, race=RACE) -> DataFrame:
    """Places changed per lap: (race, lap, position_churn)."""
    change = F.abs(F.col("position") - F.lag("position").over(by_vehicle(race)))
    return positioned.withColumn("__d", change).groupBy(*race, "lap").agg(F.coalesce(F.sum("__d"), F.lit(0)).alias("position_churn"))


def yellow_laps(laps: DataFrame, race=RACE) -> DataFrame:
    """(race, lap, is_yellow, next_yellow): whether any vehicle is under yellow, now and a lap later."""
    per_lap = laps.groupBy(*race, "lap").agg(F.max("is_under_yellow").alias("is_yellow"))
    w = Window.partitionBy(*race).orderBy("lap")
    return per_lap.withColumn("next_yellow", F.lead("is_yellow", 1, 0).over(w))


def race_features(laps: DataFrame, total_laps: int, race=RACE) -> DataFrame:
    """The central table: one row per vehicle and lap with positions, gaps, lags and context."""
    out = gap_deltas(gaps(race_position(cumulative_time(laps, race), race), race), race=race)
    return race_context(lag_features(out, race), total_laps)


def field_relative_outliers(laps: DataFrame, factor: float = 1.3, over=RACE) -> DataFrame:
    """Laps below factor times the median of their group."""
    return laps.withColumn("__m", F.median("lap_time").over(Window.partitionBy(*over))).filter(F.col("lap_time") < factor * F.col("__m")).drop("__m")


def within_sigma(df: DataFrame, column: str, sigma: float, race=RACE) -> DataFrame:
    """Rows within sigma sample deviations of their vehicle's mean; groups without deviation stay whole."""
    w = Window.partitionBy(*race, "vehicle_number")
    marked = df.withColumns({"__s": F.stddev_samp(column).over(w), "__a": F.avg(column).over(w)})
    keep = F.col("__s").isNull() | (F.col("__s") <= 0) | (F.abs(F.col(column) - F.col("__a")) <= sigma * F.col("__s"))
    return marked.filter(keep).drop("__s", "__a")


def near_median(laps: DataFrame, margin: float = 10.0, race=RACE) -> DataFrame:
    """Laps below the vehicle's median plus a margin."""
    median = F.median("lap_time").over(Window.partitionBy(*race, "vehicle_number"))
    return laps.withColumn("__m", median).filter(F.col("lap_time") < F.col("__m") + margin).drop("__m")


def green_laps(laps: DataFrame) -> DataFrame:
    return laps.filter(F.coalesce("is_under_yellow", F.lit(0)) == 0)
