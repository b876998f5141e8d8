"""Data-quality audits: signal profiles, lap structure, timing, cross-signal checks, issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.functions.scalars import seconds_between
from lapforge.operators import RACE
from lapforge.operators.selection import exact_quantiles


def out_of_range(value: Column, bounds: tuple[float, float] | None, mean: Column, std: Column) -> Column:
    """Outside the physical range if there is one, else beyond three deviations."""
    if bounds is not None:
        return (value < bounds[0]) | (value > bounds[1])
    return F.abs(value - mean) > 3 * std


SHARES = (1, 5, 50, 95, 99)


def signal_profile(t: DataFrame, signals: Sequence[str], ranges: dict[str, tuple[float, float]], by: Sequence[str] = ()) -> DataFrame:
    """One row per signal (and group of `by`): missing, zero, negative and outlier shares, moments and quantiles.

    Signals are turned into rows, so one aggregation serves them all. Quantiles of whole signals come from value
    ranges (no group holds a signal); those of the small groups of `by` from the group.
    """
    long = t.unpivot([*by, "n"], list(signals), "signal", "x")
    low = F.create_map(*[F.lit(z) for s in ranges for z in (s, float(ranges[s][0]))])[F.col("signal")] if ranges else F.lit(None)
    high = F.create_map(*[F.lit(z) for s in ranges for z in (s, float(ranges[s][1]))])[F.col("signal")] if ranges else F.lit(None)
    moments = long.groupBy(*by, "signal").agg(F.avg("x").alias("__a"), F.stddev_samp("x").alias("__s"))
    x = F.col("x")
    outlier = F.coalesce((x < low) | (x > high), F.abs(x - F.col("__a")) > 3 * F.col("__s"))
    n, pct = F.count(F.lit(1)), lambda test: 100.0 * F.count_if(test) / F.count(F.lit(1))
    grouped = [F.percentile(x, F.lit(q / 100)).alias(f"p{q}") for q in SHARES] if by else []
    profile = long.join(moments if by else F.broadcast(moments), [*by, "signal"]).groupBy(*by, "signal").agg(
        n.alias("n"), pct(x.isNull()).alias("missing_pct"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        *grouped, pct(outlier).alias("outlier_pct"), pct(x == 0).alias("zero_pct"), pct(x < 0).alias("negative_pct"),
    )
    if by:
        return profile
    quantiles = exact_quantiles(long, "signal", "x", [q / 100 for q in SHARES])
    wide = quantiles.groupBy("signal").agg(*[F.max(F.when(F.col("share") == q / 100, F.col("quantile"))).alias(f"p{q}") for q in SHARES])
    return profile.join(F.broadcast(wide), "signal", "left")  # one row a signal


def missingness_pairs(t: DataFrame, signals: Sequence[str], least: float = 0.8) -> DataFrame:
    """Pairs of signals that go missing together: correlation of their null flags."""
    flag = {s: F.col(s).isNull().cast("int") for s in signals}
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i + 1 :]]
    row = t.agg(*[F.corr(flag[a], flag[b]).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "correlation")
    return long.filter(F.col("correlation") > least)


def lap_structure(t: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Per vehicle: first and last lap, laps there are, missing ones, samples a lap and their variation."""
    per_lap = t.groupBy(*race, "vehicle_number", "lap").agg(F.count(F.lit(1)).alias("k"))
    n = F.count(F.lit(1))
    return per_lap.groupBy(*race, "vehicle_number").agg(
        F.min("lap").alias("first_lap"), F.max("lap").alias("last_lap"), n.alias("n_laps"), (F.max("lap") - F.min("lap") + 1 - n).alias("n_missing"),
        F.avg("k").alias("samples_per_lap"), (F.stddev_samp("k") / F.avg("k")).alias("samples_cv"),
    )


def timestamp_audit(t: DataFrame, gap_s: float = 1.0, race: Sequence[str] = RACE) -> DataFrame:
    """Per vehicle: spacing of samples, gaps over gap_s, mean rate over shorter ones."""
    dt = seconds_between(F.col("ts_us"), F.lag("ts_us").over(Window.partitionBy(*race, "vehicle_number").orderBy("ts_us", "n")))
    d = F.col("__d")
    return t.withColumn("__d", dt).groupBy(*race, "vehicle_number").agg(
        F.avg(d).alias("mean_s"), F.stddev_samp(d).alias("std_s"), F.min(d).alias("min_s"), F.max(d).alias("max_s"), F.count_if(d > gap_s).alias("n_gaps"), F.count_if(d < 0).alias("n_negative"),
        (1 / F.nullif(F.avg(F.when(d <= gap_s, d)), F.lit(0.0))).alias("mean_hz"),
    )


def cross_signal_checks(t: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Whether signals agree: full throttle where it is fast, slow where it brakes hard, plausible forces."""
    w = Window.partitionBy(*race)
    marked = t.withColumns({"__v": F.percentile("speed", F.lit(0.9)).over(w), "__b": F.percentile("brake", F.lit(0.9)).over(w), "__g": F.sqrt(F.pow("accx", F.lit(2)) + F.pow("accy", F.lit(2)))})
    fast = F.avg(F.when(F.col("speed") > F.col("__v"), F.col("throttle")))
    braking = F.avg(F.when(F.col("brake") > F.col("__b"), F.col("speed")))
    return marked.groupBy(*race).agg((fast > 50).alias("throttle_ok"), (braking < F.avg("speed")).alias("brake_ok"), (F.percentile("__g", F.lit(0.99)) < 4).alias("force_ok"))


def physical_sanity(t: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """Shares of samples whose cause has its effect: braking slows, throttle speeds up, steering pulls sideways."""
    def share(cause, effect):
        return 100.0 * F.count_if(cause & effect) / F.nullif(F.count_if(cause), F.lit(0))

    return t.groupBy(*race).agg(
        share(F.col("brake") > 50, F.col("accx") < 0).alias("brake_slows_pct"), share(F.col("throttle") > 80, F.col("accx") > 0).alias("throttle_speeds_pct"),
        share(F.abs("steering") > 30, F.abs("accy") > 0.3).alias("steering_pulls_pct"), F.count_if((F.abs("accx") > 3) | (F.abs("accy") > 3)).alias("n_extreme"),
    )


def driver_variability(t: DataFrame, column: str, race: Sequence[str] = RACE) -> DataFrame:
    each = t.groupBy(*race, "vehicle_number").agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.max(column).alias("max"))
    return each.groupBy(*race).agg(F.avg("std").alias("mean_std"), F.max("max").alias("max"), (F.stddev_samp("mean") / F.avg("mean")).alias("cv_of_means"))


def issues(profile: DataFrame, missing: float = 10.0, outliers: float = 5.0) -> DataFrame:
    """The list of what is wrong with each signal; empty if nothing is."""
    found = F.array(F.when(F.col("missing_pct") > missing, "missing"), F.when(F.col("outlier_pct") > outliers, "outliers"), F.when(F.col("zero_pct") > 50, "mostly zero"))
    return profile.withColumn("issues", F.array_compact(found))


def band_counts(points: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts per band of a value by width-free edges, closed on the left."""
    band = F.lit(0)
    for e in edges:
        band = band + F.when(F.col(value) >= e, 1).otherwise(0)
    return points.withColumn("band", band.cast("bigint")).groupBy("track", "band").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    b = F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins))
    return df.withColumn("bin", b.cast("bigint")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def availability(t: DataFrame, signals: Sequence[str], slow: float, braking: float, race: Sequence[str] = RACE) -> DataFrame:
    return t.groupBy(*race).agg(
        *[F.count(s).alias(f"n_{s}") for s in signals], *[F.percentile("speed", F.lit(q / 100)).alias(f"speed_p{q}") for q in (10, 30, 50)],
        F.count_if(F.col("speed") < slow).alias("n_slow"), F.count_if(F.col("brake") > braking).alias("n_braking"),
    )


def join_yield(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """Per group of left: rows, rows that met the right side, and those with a value."""
    met = left.join(right.withColumn("__hit", F.lit(1)), list(on), "left")
    return met.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("__hit").alias("n_met"), F.count(value).alias("n_value"))


def bias_corrected_skew(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    n = F.count(column)
    g = F.skewness(column)
    return df.groupBy(*by).agg((g * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))).alias("skew"), n.alias("n"))
