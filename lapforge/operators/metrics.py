"""Driver-technique metrics over wide telemetry, one aggregation per group of keys.

Groups that are too small give NULL, never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.functions.scalars import gated, seconds_between
from lapforge.operators import RACE

VEHICLE = (*RACE, "vehicle_number")


def _share(test: Column, count: Column) -> Column:
    return 100.0 * F.count_if(test) / F.nullif(count, F.lit(0))


def consistency_by_position(laps: DataFrame, skip_first: int = 1, skip_last: int = 0, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Deviation of lap times without the first and last rows and without laps 10 s over the median."""
    w = Window.partitionBy(*keys)
    placed = laps.dropna(subset=["lap_time"]).withColumns({"__n": F.row_number().over(w.orderBy("lap")), "__c": F.count(F.lit(1)).over(w)})
    inner = placed.filter((F.col("__n") > skip_first) & (F.col("__n") <= F.col("__c") - skip_last))
    marked = inner.withColumns({"__m": F.median("lap_time").over(w), "__k": F.count(F.lit(1)).over(w)})
    kept = marked.filter((F.col("__k") >= 3) & (F.col("lap_time") < F.col("__m") + 10))
    n = F.count(F.lit(1))
    return kept.groupBy(*keys).agg(
        gated(n, 3, F.stddev_pop("lap_time")).alias("std_dev"),
        gated(n, 3, F.stddev_pop("lap_time") / F.avg("lap_time")).alias("cv"),
        gated(n, 3, F.max("lap_time") - F.min("lap_time")).alias("spread"),
        gated(n, 3, F.avg("lap_time")).alias("mean"),
        n.alias("n_laps"),
    )


def consistency_after_laps(laps: DataFrame, skip: int = 2, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Sample deviation and its percentage of the mean, laps after the first skip."""
    n = F.count("lap_time")
    return laps.filter(F.col("lap") > skip).groupBy(*keys).agg(
        gated(n, 3, F.stddev_samp("lap_time")).alias("std_dev"), gated(n, 3, 100 * F.stddev_samp("lap_time") / F.avg("lap_time")).alias("cv_pct"), n.alias("n_laps")
    )


def coasting_shares(t: DataFrame, throttle_on: float = 5.0, brake_on: float = 2.0, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Shares of rows that coast, overlap, are on throttle or brake, of rows with both signals."""
    rows = t.dropna(subset=["throttle", "brake"])
    go, stop = F.col("throttle") > throttle_on, F.col("brake") > brake_on
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        _share(~go & ~stop, n).alias("coasting_pct"), _share(go & stop, n).alias("overlap_pct"), _share(go, n).alias("throttle_pct"), _share(stop, n).alias("brake_pct")
    )


def coasting_below(t: DataFrame, throttle_below: float = 5.0, brake_below: float = 5.0, keys: Sequence[str] = VEHICLE) -> DataFrame:
    rows = t.dropna(subset=["throttle", "brake"])
    both = (F.col("throttle") < throttle_below) & (F.col("brake") < brake_below)
    return rows.groupBy(*keys).agg(_share(both, F.count(F.lit(1))).alias("coasting_pct"))


def braking_summary(t: DataFrame, least: float = 20.0, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Largest pressure, mean of pressures above least, and how often braking begins."""
    w = Window.partitionBy(*keys).orderBy("n")
    on = F.col("brake") > least
    begins = on & ~F.coalesce(F.lag(on).over(w), F.lit(True))
    return t.withColumns({"__on": on, "__b": begins}).groupBy(*keys).agg(
        F.max("brake").alias("max_pressure"), F.avg(F.when(F.col("__on"), F.col("brake"))).alias("mean_pressure"), F.count_if("__b").alias("n_events")
    )


def brake_pulses(t: DataFrame, least: float = 20.0, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """How often pressure rises again inside one braking event.

    A small automaton over the ordered samples of a vehicle: onset remembers the pressure; falling below half
    of it lowers it, rising 30 % above it is a pulse and the new mark, else the larger one is kept. A fold
    over the group's sorted array: a vehicle's samples in one race, not the table.
    """
    listed = t.filter(F.col("brake").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "brake"))).alias("s"))
    start = F.struct(F.lit(False).alias("on"), F.lit(0.0).alias("mark"), F.lit(0).cast("bigint").alias("pulses"))

    def step(acc, x):
        b = x["brake"]
        on = b > least
        pulse = acc["on"] & on & (b >= 0.5 * acc["mark"]) & (b > 1.3 * acc["mark"])
        mark = (
            F.when(~on, acc["mark"])
            .when(~acc["on"], b)
            .when(b < 0.5 * acc["mark"], b)
            .when(pulse, b)
            .otherwise(F.greatest(acc["mark"], b))
        )
        return F.struct(on.alias("on"), mark.alias("mark"), (acc["pulses"] + pulse.cast("bigint")).alias("pulses"))

    tail = F.slice("s", 2, F.greatest(F.size("s"), F.lit(1)))
    return listed.select(*keys, F.aggregate(tail, start, step)["pulses"].alias("n_pulses"))


def brake_islands(t: DataFrame, threshold: float = 10.0, least_peak: float = 15.0, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Peaks of braking events and their deviation in percent of the mean.

    An event is a run above the threshold with a row before and after it. Its peak is the largest pressure
    from the row before the run up to the run's last row, that one left out: so an event of one row has none.
    """
    w = Window.partitionBy(*keys).orderBy("n")
    on = F.col("brake") > threshold
    marked = t.withColumns({"__on": on, "__begin": on & ~F.coalesce(F.lag(on).over(w), F.lit(True)), "__next": F.lead(on).over(w)})
    numbered = marked.withColumn("__event", F.sum(F.lead("__begin").over(w).cast("int")).over(w))
    inside = F.col("__on") & (F.col("__next").isNull() | F.col("__next"))  # all but the run's last row
    before = F.coalesce(F.lead("__begin").over(w), F.lit(False))
    part = numbered.withColumns({"__in": inside | before, "__open": F.col("__on") & F.col("__next").isNull()}).filter(F.col("__event") > 0)
    events = part.groupBy(*keys, "__event").agg(F.max(F.when(F.col("__in"), F.col("brake"))).alias("peak"), F.max("__open").alias("open"))
    peaks = events.filter(~F.col("open") & (F.col("peak") > least_peak))
    n = F.count(F.lit(1))
    return peaks.groupBy(*keys).agg(n.alias("n_peaks"), gated(n, 3, 100 * F.stddev_pop("peak") / F.avg("peak")).alias("peak_cv_pct"))


def throttle_control(t: DataFrame, full: float = 90.0, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Lift-offs per acceleration, share at full throttle, correlation of throttle with acceleration."""
    w = Window.partitionBy(*keys).orderBy("n")
    before = F.lag("throttle").over(w)
    rows = t.withColumns(
        {
            "__lift": (before > 20) & (F.col("throttle") > 20) & (before - F.col("throttle") > 5),
            "__rise": (before < 20) & (F.col("throttle") >= 20),
            "__x": F.when(F.col("throttle") > 20, F.col("throttle")),
        }
    )
    n = F.count("throttle")
    return rows.groupBy(*keys).agg(
        (F.count_if("__lift") / F.greatest(F.count_if("__rise"), F.lit(1))).alias("lift_offs"),
        _share(F.col("throttle") >= full, n).alias("full_pct"),
        gated(F.count("__x"), 11, F.corr("__x", "accx")).alias("throttle_accel_corr"),
    )


def throttle_lookahead(t: DataFrame, full: float = 95.0, rows: int = 200, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Seconds from each row to the first one at full throttle within the next rows, itself included."""
    ahead = Window.partitionBy(*keys).orderBy("n").rowsBetween(0, rows - 1)
    first = F.min(F.when(F.col("throttle") >= full, F.col("ts_us"))).over(ahead)
    return t.withColumn("seconds_to_full", seconds_between(first, F.col("ts_us")))


def centred_mean(t: DataFrame, column: str, width: int = 5, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Moving mean of an odd width; rows without a full window keep their value."""
    half = width // 2
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(-half, half)
    smooth = F.when(F.count(column).over(w) == width, F.avg(column).over(w)).otherwise(F.col(column))
    return t.withColumn(f"{column}_smooth", smooth)


def steering_smoothness(t: DataFrame, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Mean steering rate and change of rate per row; the score falls with the latter."""
    w = Window.partitionBy(*keys).orderBy("n")
    dt = seconds_between(F.col("ts_us"), F.lag("ts_us").over(w))
    rate = F.when(dt > 0, (F.col("steering") - F.lag("steering").over(w)) / dt).when(dt.isNotNull(), 0.0)
    rows = t.withColumn("__rate", rate)
    jerk = F.abs(F.col("__rate") - F.lag("__rate").over(w))
    return rows.withColumn("__jerk", jerk).groupBy(*keys).agg(
        F.avg(F.abs("__rate")).alias("mean_rate"),
        F.avg("__jerk").alias("mean_jerk"),
        F.greatest(F.lit(0.0), 100 - F.avg("__jerk") / 10).alias("smoothness"),
    )


def g_force(t: DataFrame, keys: Sequence[str] = VEHICLE) -> DataFrame:
    total = F.sqrt(F.pow("accx", F.lit(2)) + F.pow("accy", F.lit(2)))
    return t.dropna(subset=["accx", "accy"]).groupBy(*keys).agg(
        F.avg(total).alias("mean_g"), F.max(total).alias("max_g"), F.avg(F.abs("accx")).alias("mean_abs_x"), F.avg(F.abs("accy")).alias("mean_abs_y")
    )


def lap_time_from_samples(t: DataFrame, least: float = 60.0, most: float = 300.0, rows: int = 10) -> DataFrame:
    """Lap times as the span of a lap's samples, plausible ones of more than rows samples."""
    span = t.groupBy(*VEHICLE, "lap").agg(seconds_between(F.max("ts_us"), F.min("ts_us")).alias("lap_time"), F.count(F.lit(1)).alias("n"))
    return span.filter((F.col("n") > rows) & (F.col("lap_time") > least) & (F.col("lap_time") < most))


def all_metrics(t: DataFrame, keys: Sequence[str] = VEHICLE) -> DataFrame:
    """Every telemetry metric of a group in one row; what cannot be computed is NULL."""
    out = coasting_below(t, keys=keys)
    for part in (brake_islands(t, keys=keys), throttle_control(t, keys=keys), g_force(t, keys=keys)):
        out = out.join(part, list(keys), "left")
    return out


def driver_scores(t: DataFrame, laps: DataFrame) -> DataFrame:
    """Scores of 0 to 100 per technique: the better, the higher."""
    keys = list(VEHICLE)
    parts = consistency_by_position(laps).join(coasting_shares(t), keys, "left").join(steering_smoothness(t), keys, "left")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    return parts.select(*keys, clip(100 - F.col("cv") * 100).alias("consistency_score"), clip(100 - F.col("coasting_pct")).alias("pedal_score"), clip(F.col("smoothness")).alias("steering_score"))


def compare_pairs(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each pair of vehicles of a race: the sum of signs of their score differences."""
    a, b = scores.alias("a"), scores.alias("b")
    wins = sum((F.signum(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns), F.lit(0.0))
    on = (F.col("a.race") == F.col("b.race")) & (F.col("a.vehicle_number") < F.col("b.vehicle_number"))
    return a.join(b, on).select("a.race", F.col("a.vehicle_number").alias("vehicle_a"), F.col("b.vehicle_number").alias("vehicle_b"), wins.alias("net_wins"))


def winner_direction(scores: DataFrame, standings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether the first finisher beats the last one in most metrics of a race."""
    placed = scores.join(standings, list(VEHICLE))
    ends = placed.groupBy("race").agg(*[f(c, "final_position").alias(f"{n}_{c}") for c in columns for n, f in (("first", F.min_by), ("last", F.max_by))])
    wins = sum((F.when(F.col(f"first_{c}") > F.col(f"last_{c}"), 1).otherwise(0) for c in columns), F.lit(0))
    return ends.select("race", wins.cast("bigint").alias("wins"), F.when(wins * 2 > len(columns), "SUCCESS").otherwise("MIXED").alias("verdict"))


def average_rank(df: DataFrame, column: str, out: str, over: Sequence[str]) -> DataFrame:
    """Ranks in which ties share the mean of their places; NULL for NULL."""
    w = Window.partitionBy(*over)
    rank = F.rank().over(w.orderBy(F.col(column).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*over, column)) - 1) / 2.0
    return df.withColumn(out, F.when(F.col(column).isNotNull(), rank))


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null where one side does not vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, over: Sequence[str]) -> DataFrame:
    """Rank correlation per group, with the t statistic of its significance."""
    ranked = average_rank(average_rank(df.dropna(subset=[x, y]), x, "__x", over), y, "__y", over)
    rho, n = pearson("__x", "__y"), F.count(F.lit(1))
    out = ranked.groupBy(*over).agg(rho.alias("rho"), n.alias("n"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    return out.withColumn("t", gated(F.col("n"), 3, t))


def variance_ratio(df: DataFrame, columns: Sequence[str], over: Sequence[str] = RACE) -> DataFrame:
    """Between-vehicle over within-vehicle deviation of each metric: a trait, a state, or mixed."""
    long = df.unpivot([*over, "vehicle_number"], list(columns), "metric", "x")
    each = long.groupBy(*over, "metric", "vehicle_number").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    both = each.groupBy(*over, "metric").agg(F.avg("std").alias("within"), F.stddev_samp("mean").alias("across"))
    ratio = F.col("across") / F.nullif("within", F.lit(0.0))
    kind = F.when(ratio > 1.5, "PROFILE").when(ratio < 0.7, "STATE").when(ratio.isNotNull(), "MIXED")
    return both.select(*over, "metric", "within", "across", ratio.alias("ratio"), kind.alias("kind"))
