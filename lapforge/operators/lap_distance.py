"""Laps along their distance: a common distance axis, and corners as clusters on that line.

A lap's samples come at its own distances. On a grid of metres, laps and vehicles can be set beside each other; and
places along one line need no plane to be clustered: density clusters of a line are runs of cores without a wide gap,
which ordered windows find without a kernel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.functions.scalars import bands
from lapforge.operators import RACE
from lapforge.operators.spatial import peaks

LAP = (*RACE, "vehicle_number", "lap")
BRAKE_KINDS = ((30.0, "light"), (60.0, "medium"))


def resampled(samples: DataFrame, values: Sequence[str], step: float, distance: str = "lap_distance", keys: Sequence[str] = LAP) -> DataFrame:
    """keys, distance (0, step, 2 * step, ... within the lap's own range) and each value, linear between the samples on both sides.

    Samples without a distance are left out; of samples at one distance the mean counts; a missing value is skipped, and a grid
    place without known values on both sides is null. Grid and samples meet in one ordered window per lap.
    """
    known = samples.filter(F.col(distance).isNotNull()).groupBy(*keys, F.col(distance).cast("double").alias("at")).agg(*[F.avg(v).alias(v) for v in values])
    ends = known.groupBy(*keys).agg(F.ceil(F.min("at") / step).alias("lo"), F.floor(F.max("at") / step).alias("hi")).filter("lo <= hi")
    grid = ends.select(*keys, F.explode(F.sequence("lo", "hi")).alias("k")).select(*keys, (F.col("k") * step).cast("double").alias("at"), *[F.lit(None).cast("double").alias(v) for v in values], F.lit(True).alias("grid"))
    both = known.withColumn("grid", F.lit(False)).unionByName(grid)
    w = Window.partitionBy(*keys).orderBy("at")
    back, ahead = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    pair = lambda v: F.when(F.col(v).isNotNull(), F.struct(F.col("at").alias("at"), F.col(v).alias("v")))
    met = both.withColumns({f"__{side}_{v}": take(pair(v), ignorenulls=True).over(frame) for v in values for side, take, frame in (("p", F.last, back), ("q", F.first, ahead))})

    def between(v: str) -> Column:
        p, q = F.col(f"__p_{v}"), F.col(f"__q_{v}")
        return F.when(p["at"] == q["at"], p["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * (F.col("at") - p["at"]) / (q["at"] - p["at"]))

    return met.filter("grid").select(*keys, F.col("at").alias("distance"), *[between(v).alias(v) for v in values])


def smoothed(samples: DataFrame, value: str, width: int = 5, order: str | list[str] = "lap_distance", keys: Sequence[str] = LAP, name: str = "smooth") -> DataFrame:
    """Adds the centred mean of `width` samples; the sample itself where the window is not full."""
    side = width // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-side, side)
    full = F.count(value).over(w) == 2 * side + 1
    return samples.withColumn(name, F.when(full, F.avg(value).over(w)).otherwise(F.col(value).cast("double")))


def braking_places(
    samples: DataFrame, value: str = "brake", share: float = 0.4, apart: int = 20, prominence: float = 5.0, least_rows: int = 100, width: int = 5,
    distance: str = "lap_distance", keys: Sequence[str] = LAP, ties: Sequence[str] = (),
) -> DataFrame:
    """Peaks of the smoothed value along each lap: keys, distance, latitude, longitude, level (the raw value there).

    ties: columns that order samples at one distance, as those of a standing vehicle are. A peak reaches the share quantile of the lap's values above 0. Laps with fewer than least_rows samples, or without a value above 0, have none.
    The kernel gets all laps of a vehicle's race at once (keys but the last) and goes through them by their bounds.
    """
    rows = smoothed(samples.filter(F.col(distance).isNotNull()), value, width, [distance, *ties], keys)
    lap = Window.partitionBy(*keys)
    limited = rows.select(*keys, distance, *ties, "latitude", "longitude", F.col(value).cast("double").alias("level"), "smooth").withColumns(
        {"__limit": F.percentile(F.when(F.col("smooth") > 0, F.col("smooth")), F.lit(share)).over(lap), "__n": F.count(F.lit(1)).over(lap)}
    )
    kinds = {f.name: f.dataType.simpleString() for f in limited.schema}
    shape = [*keys, distance, "latitude", "longitude", "level"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([keys[-1], distance, *ties], kind="stable")
        lap_of, level, limit = (part[c].to_numpy() for c in (keys[-1], "smooth", "__limit"))
        first = np.flatnonzero(np.append(True, lap_of[1:] != lap_of[:-1]))
        at = [i + peaks(level[i:j], height=float(limit[i]), distance=apart, prominence=prominence) for i, j in zip(first, np.append(first[1:], len(part)), strict=True)]
        return part.iloc[np.concatenate(at)][shape]

    eligible = limited.filter((F.col("__n") >= least_rows) & F.col("__limit").isNotNull())
    return eligible.groupBy(*keys[:-1]).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in shape))


def line_clusters(places: DataFrame, at: str, eps: str, least: str, group: Sequence[str]) -> DataFrame:
    """Adds cluster: the number of the density cluster along `at`, from 0 in order; null for noise.

    eps and least are columns that are constant in a group. A core has at least `least` places within eps (itself included, ends
    included); cores in a row no more than eps apart are one cluster; other places join the nearest core within eps, the one before of two equally near.
    """
    scaled = places.withColumn("__at", F.col(at) / F.col(eps))
    order = Window.partitionBy(*group).orderBy("__at")
    near = F.count(F.lit(1)).over(order.rangeBetween(-1, 1))
    cores = scaled.withColumn("__core", near >= F.col(least))
    here = F.when(F.col("__core"), F.col("__at"))
    previous = F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = cores.withColumn("__fresh", F.when(F.col("__core"), F.coalesce((F.col("__at") - previous > 1.0).cast("int"), F.lit(1))))
    numbered = fresh.withColumn("__c", F.when(F.col("__core"), F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    mark = F.when(F.col("__core"), F.struct(F.col("__at").alias("at"), F.col("__c").alias("c")))
    sides = numbered.withColumns(
        {
            "__p": F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "__q": F.first(mark, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    before, behind = F.col("__at") - F.col("__p.at"), F.col("__q.at") - F.col("__at")
    joins = F.when((before <= 1.0) & (behind.isNull() | (before <= behind)), F.col("__p.c")).when(behind <= 1.0, F.col("__q.c"))
    return sides.withColumn("cluster", F.coalesce("__c", joins).cast("int")).drop("__at", "__core", "__fresh", "__c", "__p", "__q")


def distance_corners(
    places: DataFrame, laps: DataFrame, fewest: int = 12, most: int = 16, widest: float = 50.0, distance: str = "lap_distance", race: Sequence[str] = RACE
) -> DataFrame:
    """One row per corner of a race, numbered along the lap: medians of distance and position, largest and median level, n_observations, corner_type, narrowed.

    The radius is a third of the spacing that `most` corners would have, `widest` at most, with a quarter of the laps as least number of places. A race
    with fewer than `fewest` corners is clustered again with 0.6 of the radius and a fifth of the laps, and takes that if it has more corners.
    laps: race, n_laps, track_length.
    """
    radius = F.least(F.lit(float(widest)), F.col("track_length") / most / 3)
    attempts = F.explode(
        F.array(
            F.struct(F.lit(0).alias("narrowed"), radius.alias("__eps"), F.greatest(F.lit(2), F.floor(F.col("n_laps") / 4)).alias("__least")),
            F.struct(F.lit(1).alias("narrowed"), (radius * 0.6).alias("__eps"), F.greatest(F.lit(2), F.floor(F.col("n_laps") / 5)).alias("__least")),
        )
    ).alias("__a")
    tried = places.join(laps, list(race)).filter("track_length > 0").withColumn("__a", attempts).select("*", "__a.*")
    clustered = line_clusters(tried, distance, "__eps", "__least", [*race, "narrowed"]).filter("cluster is not null")
    corner = clustered.groupBy(*race, "narrowed", "cluster").agg(
        F.median(distance).alias("distance"), F.median("latitude").alias("latitude"), F.median("longitude").alias("longitude"), F.max("level").alias("max_level"), F.median("level").alias("median_level"), F.count(F.lit(1)).alias("n_observations")
    )
    w = Window.partitionBy(*race)
    count = lambda a: F.count_if(F.col("narrowed") == a).over(w)
    chosen = F.when((count(0) < fewest) & (count(1) > count(0)), 1).otherwise(0)
    kept = corner.withColumn("__use", chosen).filter("narrowed = __use")
    place = F.row_number().over(w.orderBy("distance", "cluster")).cast("bigint")
    return kept.select(
        *race, place.alias("corner_id"), "distance", "latitude", "longitude", "max_level", "median_level", "n_observations",
        bands(F.col("max_level"), list(BRAKE_KINDS), "heavy").alias("corner_type"), (F.col("narrowed") == 1).alias("narrowed"),
    )


def lap_extent(samples: DataFrame, distance: str = "lap_distance", race: Sequence[str] = RACE) -> DataFrame:
    """race, n_laps (laps of all its vehicles) and track_length (the longest distance)."""
    per_lap = samples.groupBy(*dict.fromkeys([*race, "vehicle_number", "lap"])).agg(F.max(distance).alias("m"))
    return per_lap.groupBy(*race).agg(F.count(F.lit(1)).alias("n_laps"), F.max("m").alias("track_length"))
