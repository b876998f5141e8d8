"""Drivers against the field: benchmarks, stints, traffic, degradation, standings, profiles, narratives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.functions.scalars import gated
from lapforge.operators import RACE

TRAFFIC_GAP = 1.5
CLEAN_FACTOR = 1.3


def field_benchmark(positioned: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Per lap with three cars or more, of which three are clean: median, quartiles, mean of the top five."""
    w = Window.partitionBy(*race, "lap")
    marked = positioned.withColumns({"__m": F.median("lap_time").over(w), "__n": F.count(F.lit(1)).over(w)})
    clean = marked.filter((F.col("__n") >= 3) & (F.col("lap_time") < CLEAN_FACTOR * F.col("__m")))
    top = F.avg(F.when(F.col("position") <= 5, F.col("lap_time")))
    out = clean.groupBy(*race, "lap").agg(
        F.median("lap_time").alias("field_median"),
        F.percentile("lap_time", F.lit(0.25)).alias("field_p25"),
        F.percentile("lap_time", F.lit(0.75)).alias("field_p75"),
        F.coalesce(top, F.min("lap_time")).alias("top5_avg"),
        F.count(F.lit(1)).alias("n_cars"),
    )
    return out.filter("n_cars >= 3")


def driver_deltas(laps: DataFrame, benchmarks: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    met = laps.join(benchmarks, [*race, "lap"], "left")
    return met.withColumns({"delta_vs_median": F.col("lap_time") - F.col("field_median"), "delta_vs_top5": F.col("lap_time") - F.col("top5_avg")})


def stint(lap: Column, last: Column) -> Column:
    early = F.least(F.lit(5), last)
    mid = F.least(F.lit(15), last)
    return F.when(lap <= early, "early").when(lap.between(early + 1, mid), "mid").when(lap >= mid + 1, "late")


def with_stints(laps: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Early, mid and late laps of each vehicle; the bounds shrink with its last lap."""
    last = F.max("lap").over(Window.partitionBy(*race, "vehicle_number"))
    return laps.withColumn("__last", last).withColumn("stint", stint(F.col("lap"), F.col("__last"))).drop("__last")


def _stint_columns() -> list[Column]:
    return [F.median(F.when(F.col("stint") == s, F.col("lap_time"))).alias(f"{s}_pace") for s in ("early", "mid", "late")]


def stint_pace(laps: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    return with_stints(laps, race).groupBy(*race, "vehicle_number").agg(*_stint_columns())


def in_traffic(gapped: DataFrame, threshold: float = TRAFFIC_GAP) -> DataFrame:
    """Close to the car ahead or behind. The first car's gap ahead is 0, so it always is."""
    return gapped.withColumn("in_traffic", (F.col("gap_to_ahead") < threshold) | (F.col("gap_to_behind") < threshold))


def _with_clean_median(laps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return laps.withColumn("__m", F.median("lap_time").over(Window.partitionBy(*keys)))


def _degradation_columns() -> list[Column]:
    clean = F.col("lap_time") < CLEAN_FACTOR * F.col("__m")
    x, y = F.when(clean, F.col("lap").cast("double")), F.when(clean, F.col("lap_time"))
    n = F.count(F.lit(1))
    slope = F.when((n < 3) | (F.count(y) < 3), 0.0).otherwise(F.regr_slope(y, x))
    return [slope.alias("degradation"), n.alias("n_laps")]


def degradation(laps: DataFrame, keys: Sequence[str] = (*RACE, "vehicle_number")) -> DataFrame:
    """Slope of clean lap times over laps; 0 with fewer than three laps or clean laps."""
    return _with_clean_median(laps, keys).groupBy(*keys).agg(*_degradation_columns())


def _traffic_columns() -> list[Column]:
    slow = F.median(F.when(F.col("in_traffic"), F.col("lap_time")))
    free = F.median(F.when(~F.col("in_traffic"), F.col("lap_time")))
    n = F.count_if("in_traffic")
    return [n.alias("traffic_laps"), F.coalesce((slow - free) * n, F.lit(0.0)).alias("traffic_cost")]


def traffic_cost(gapped: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Laps in traffic and what they cost: the difference of medians times their number."""
    return in_traffic(gapped).groupBy(*race, "vehicle_number").agg(*_traffic_columns())


def standings(laps: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Final order: most laps first, then least total time."""
    totals = laps.groupBy(*race, "vehicle_number").agg(F.max("lap").alias("laps_completed"), F.sum("lap_time").alias("total_time"))
    order = Window.partitionBy(*race).orderBy(F.desc("laps_completed"), "total_time", "vehicle_number")
    return totals.withColumn("final_position", F.row_number().over(order).cast("bigint"))


def driver_metrics(features: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Every driver against the car one place ahead at the driver's last lap (the winner against the second).

    One scan: windows by race mark each lap with the car a place ahead, one aggregation gives all figures of a driver,
    windows over these rows give those of the field, and the drivers are joined once to the cars ahead of them.
    """
    keys = [*race, "vehicle_number"]
    seats = Window.partitionBy(*race, "lap").orderBy("position")
    ahead = F.when(F.col("position") == 1, F.lead("vehicle_number").over(seats)).otherwise(F.lag("vehicle_number").over(seats))
    marked = in_traffic(with_stints(_with_clean_median(features, keys), race)).withColumn("__ahead", ahead)
    own = (
        marked.groupBy(*keys)
        .agg(
            F.max_by(F.struct("position", "gap_to_ahead", "__ahead"), "lap").alias("f"), F.median("lap_time").alias("pace"), F.max("cumulative_time").alias("driver_time"),
            F.max(F.when(F.col("position") == 1, F.col("cumulative_time"))).alias("__led"), *_degradation_columns(), *_traffic_columns(), *_stint_columns(),
        )
        .select("*", F.col("f.position").alias("final_position"), F.col("f.gap_to_ahead").alias("gap_to_ahead"), F.col("f.__ahead").alias("ahead_vehicle"))
    )
    field = Window.partitionBy(*race)
    wanted = own.withColumns({"winner_time": F.max("__led").over(field), "field_deg": F.avg(F.when(F.col("n_laps") >= 5, F.col("degradation"))).over(field)})
    other = own.select(*race, F.col("vehicle_number").alias("ahead_vehicle"), F.col("pace").alias("__pace"), F.col("degradation").alias("__deg"), F.col("traffic_laps").alias("__traffic"))
    full = wanted.join(other, [*race, "ahead_vehicle"], "left")
    return full.select(
        *keys,
        "final_position",
        F.coalesce(F.col("driver_time") - F.col("winner_time"), F.lit(0.0)).alias("gap_to_winner"),
        "gap_to_ahead",
        "ahead_vehicle",
        F.coalesce(F.col("pace") - F.col("__pace"), F.lit(0.0)).alias("ahead_pace_delta"),
        F.coalesce(F.col("degradation") - F.col("__deg"), F.lit(0.0)).alias("ahead_deg_delta"),
        F.coalesce(F.col("traffic_laps") - F.col("__traffic"), F.lit(0)).alias("ahead_traffic_delta"),
        F.col("degradation").alias("driver_deg"),
        F.coalesce("field_deg", F.lit(0.0)).alias("field_deg"),
        "traffic_laps",
        "traffic_cost",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("early_pace", "mid_pace", "late_pace")],
    )


def narrative(metrics: DataFrame) -> DataFrame:
    """A sentence per driver from a template; no service is called."""
    text = F.when(
        F.col("final_position") == 1, F.format_string("Car %d won; pace against second %.3f s.", "vehicle_number", "ahead_pace_delta")
    ).otherwise(
        F.format_string("Car %d finished P%d, %.3f s off the winner; %d laps in traffic cost %.3f s.", "vehicle_number", "final_position", "gap_to_winner", "traffic_laps", "traffic_cost")
    )
    return metrics.withColumn("narrative", text)


def percentile_in_field(df: DataFrame, column: str, over: Sequence[str] = RACE) -> DataFrame:
    """Share of the field with a smaller value, and competition rank (smallest first)."""
    w = Window.partitionBy(*over)
    rank = F.rank().over(w.orderBy(column))
    return df.withColumns({f"{column}_rank": rank, f"{column}_percentile": 100.0 * (rank - 1) / F.count(column).over(w)})


def driver_profile(per_lap: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Traits as means, states as mean and sample deviation (15 % of the mean where there is none)."""
    state = lambda c: F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), 0.15 * F.avg(c))
    return per_lap.groupBy(*race, "vehicle_number").agg(
        F.avg("lift_offs").alias("lift_offs"),
        F.avg("full_pct").alias("full_pct"),
        F.avg("mean_g").alias("mean_g"),
        F.avg("brake_level").alias("brake_mean"),
        state("brake_level").alias("brake_std"),
        F.avg("coasting_pct").alias("coasting_mean"),
        state("coasting_pct").alias("coasting_std"),
        F.count(F.lit(1)).alias("n_laps"),
    )


def recommendations(profiles: DataFrame, traits: Sequence[str], race: Sequence[str] = RACE) -> DataFrame:
    """(vehicle, trait, percentile, priority) for traits below the field's middle; high in the lowest quarter."""
    long = profiles.unpivot([*race, "vehicle_number"], list(traits), "trait", "value")
    placed = percentile_in_field(long, "value", [*race, "trait"]).filter("value_percentile < 50")
    return placed.select(*race, "vehicle_number", "trait", F.col("value_percentile").alias("percentile"), F.when(F.col("value_percentile") < 25, "high").otherwise("medium").alias("priority"))


def clean_consistency(laps: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    w = Window.partitionBy(*race, "vehicle_number")
    y = F.when(F.col("lap_time") < CLEAN_FACTOR * F.col("__m"), F.col("lap_time"))
    return laps.withColumn("__m", F.median("lap_time").over(w)).groupBy(*race, "vehicle_number").agg(gated(F.count(y), 3, F.stddev_samp(y)).alias("consistency"))
