"""What-if scenarios: controllable features, a regression per race by sums, interventions, traffic from positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators import RACE
from lapforge.operators import least_squares as LS
from lapforge.operators.compare import clean_consistency, degradation, standings, traffic_cost

FEATURES = ("degradation", "consistency", "traffic_laps")


def baseline_pace(laps: DataFrame, early: int = 5, race: Sequence[str] = RACE) -> DataFrame:
    """Median of the clean early laps; of all clean laps, or of all, where there are none."""
    w = Window.partitionBy(*race, "vehicle_number")
    clean = F.col("lap_time") < 1.3 * F.col("__m")
    return (
        laps.withColumn("__m", F.median("lap_time").over(w))
        .groupBy(*race, "vehicle_number")
        .agg(
            F.coalesce(
                F.median(F.when(clean & (F.col("lap") <= early), F.col("lap_time"))), F.median(F.when(clean, F.col("lap_time"))), F.median("lap_time")
            ).alias("baseline_pace")
        )
    )


def stint_filter(laps: DataFrame, stint: str, race: Sequence[str] = RACE) -> DataFrame:
    """Laps of a stint: full, early (to 5), mid (6 to 15), late (from 16; the last lap of shorter races)."""
    if stint == "full":
        return laps
    lap = F.col("lap")
    if stint == "early":
        return laps.filter(lap <= 5)
    if stint == "mid":
        return laps.filter(lap.between(6, 15))
    last = F.max("lap").over(Window.partitionBy(*race, "vehicle_number"))
    return laps.withColumn("__l", last).filter(lap >= F.least(F.lit(16), F.col("__l"))).drop("__l")


def race_features(gapped: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """One row per driver: controllable features (missing consistency takes the race's median), average lap time,
    final position, gap to the winner, and the lap-time difference to the race's median driver."""
    keys = [*race, "vehicle_number"]
    out = (
        degradation(gapped, keys)
        .join(clean_consistency(gapped, race), keys)
        .join(traffic_cost(gapped, race).select(*keys, "traffic_laps"), keys)
        .join(baseline_pace(gapped, race=race), keys)
        .join(gapped.groupBy(*keys).agg(F.avg("lap_time").alias("avg_lap_time")), keys)
        .join(standings(gapped, race), keys)
    )
    w = Window.partitionBy(*race)
    winner = F.min(F.when(F.col("final_position") == 1, F.col("avg_lap_time"))).over(w)
    return out.withColumns(
        {
            "consistency": F.coalesce("consistency", F.median("consistency").over(w)),
            "lap_time_delta": F.col("avg_lap_time") - F.median("avg_lap_time").over(w),
            "gap_to_winner": (F.col("avg_lap_time") - winner) * F.col("laps_completed"),
        }
    )


def normal_sums(features: DataFrame, columns: Sequence[str] = FEATURES, target: str = "lap_time_delta", by: Sequence[str] = ()) -> DataFrame:
    """The sums of a least-squares fit in one aggregation: one row per group, whatever the number of drivers."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    y = F.col(target)
    sums = {f"a{i}{j}": F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))}
    sums |= {f"b{i}": F.sum(cols[i] * y) for i in range(len(cols))} | {"yy": F.sum(y * y), "n": F.count(F.lit(1))}
    return features.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])


def race_fits(features: DataFrame, columns: Sequence[str] = FEATURES, race: Sequence[str] = RACE, least: int = 10) -> DataFrame:
    """One fit per race over its drivers with all values: intercept, a coefficient per column, r2, n, and what leverages need
    (inverse, means). Races with fewer than `least` such drivers have no fit and no row."""
    sums = features.dropna(subset=[*columns, "lap_time_delta"]).groupBy(*race).agg(*LS.sums([F.col(c) for c in columns], F.col("lap_time_delta")))
    solved = LS.solve(sums, len(columns), inverse=True).filter(F.col("n_rows") >= least)
    named = {f"b{i}": c for i, c in enumerate(("intercept", *columns))}
    r2 = 1 - F.col("rss") / F.nullif(F.col("tss"), F.lit(0.0))
    return solved.withColumns({"r2": r2, "n": F.col("n_rows")}).withColumnsRenamed(named)


def model_validation(features: DataFrame, fits: DataFrame, columns: Sequence[str] = FEATURES, race: Sequence[str] = RACE) -> DataFrame:
    """One row per fitted race: r2, mae, leave-one-out r2 and mae, and whether each coefficient has the expected (positive) sign.

    Leaving a driver out changes its error to e / (1 - h) with h its leverage, so no fit is repeated. loo_r2 is one less
    the sum of those squares over the spread of the target; a driver whose leverage is 1 decides its own
    prediction and makes both null.
    """
    keys = [*race, "vehicle_number"]
    whole = features.dropna(subset=[*columns, "lap_time_delta"]).select(*keys, *columns, "lap_time_delta")
    model = fits.select(*race, F.col("intercept").alias("b0"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(columns, 1)], *[c for c in fits.columns if c.startswith("v_") or c in {f"m{i}" for i in range(1, len(columns) + 1)}], "n_rows", "tss", "r2")
    met = whole.join(model, list(race))
    cols = [F.col(c).cast("double") for c in columns]
    e = F.col("lap_time_delta") - LS.fitted(cols)
    free = 1 - LS.leverage(cols)
    rows = met.withColumns({"__e": e, "__l": F.when(free > 1e-9, e / free)})
    all_known = F.count("__l") == F.count(F.lit(1))
    out = rows.groupBy(*race).agg(
        F.first("r2").alias("r2"),
        F.avg(F.abs("__e")).alias("mae"),
        F.when(all_known, 1 - F.sum(F.col("__l") * F.col("__l")) / F.nullif(F.first("tss"), F.lit(0.0))).alias("loo_r2"),
        F.when(all_known, F.avg(F.abs("__l"))).alias("loo_mae"),
        *[(F.first(f"b{i}") > 0).alias(f"{c}_positive") for i, c in enumerate(columns, 1)],
        F.first("n_rows").alias("n"),
    )
    passed = F.lit(True)
    for c in columns:
        passed = passed & F.col(f"{c}_positive")
    return out.withColumn("passed", passed)


def predict(features: DataFrame, model: Mapping[str, float] | DataFrame, columns: Sequence[str] = FEATURES, race: Sequence[str] = RACE) -> DataFrame:
    """Adds predicted and the coefficients as __b_ columns. model: one model for all races, or the fits of race_fits;
    with these, drivers of a race without a fit have no row, as nothing can be predicted for them."""
    names = ("intercept", *columns)
    if isinstance(model, DataFrame):
        based = features.join(model.select(*race, *[F.col(c).alias(f"__b_{c}") for c in names]), list(race))
    else:
        based = features.withColumns({f"__b_{c}": F.lit(model[c]) for c in names})
    value = F.col("__b_intercept")
    for c in columns:
        value = value + F.col(f"__b_{c}") * F.col(c)
    return based.withColumn("predicted", value)


def interventions(features: DataFrame, model: Mapping[str, float] | DataFrame, laps: int = 20, race: Sequence[str] = RACE) -> DataFrame:
    """What each driver would save by reaching the field's lower quartile of degradation and consistency, and its
    least traffic. The saving is the actual delta minus the prediction, so each one counts the residual.
    model: one for all races, or the fits of race_fits."""
    w = Window.partitionBy(*race)
    goal = {
        "degradation": F.percentile("degradation", F.lit(0.25)).over(w),
        "consistency": F.percentile("consistency", F.lit(0.25)).over(w),
        "traffic_laps": F.min("traffic_laps").over(w).cast("double"),
    }
    based = predict(features, model, race=race).withColumns({f"__goal_{c}": g for c, g in goal.items()})
    entries = []
    for c in FEATURES:
        target = F.col(f"__goal_{c}")
        moved = F.col("predicted") + F.col(f"__b_{c}") * (target - F.col(c))
        saving = (F.col("lap_time_delta") - moved) * laps
        entry = F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("original"), target.alias("target"), saving.alias("savings"))
        entries.append(F.when(F.col(c) > target, entry))
    return based.withColumn("interventions", F.array_compact(F.array(*entries))).select(*features.columns, "interventions")


def scenarios(planned: DataFrame, laps: int = 20, race: Sequence[str] = RACE) -> DataFrame:
    """Total savings, best intervention and places gained per driver.

    Places are gained one after the other, nearest car first, while the savings left exceed the gap to it: the
    longest run of cars ahead whose gaps, added up, stay below the savings.
    """
    total = F.aggregate("interventions", F.lit(0.0), lambda a, x: a + x["savings"])
    best = F.array_max(F.transform("interventions", lambda x: F.struct(x["savings"].alias("savings"), x["feature"].alias("feature"))))["feature"]
    own = planned.withColumns({"total_savings": total, "best_intervention": best})
    keys = [*race, "vehicle_number"]
    ahead = own.select(*race, F.col("final_position").alias("__p"), F.col("avg_lap_time").alias("__t"))
    met = own.join(ahead, list(race)).filter(F.col("__p") < F.col("final_position"))  # within one race
    run = Window.partitionBy(*keys).orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    need = F.sum(F.abs(F.col("avg_lap_time") - F.col("__t")) * laps).over(run)
    gained = met.withColumn("__need", need).groupBy(*keys).agg(F.count_if(F.col("total_savings") > F.col("__need")).alias("positions_gained"))
    return own.join(gained, keys, "left").select(
        *keys, F.col("final_position").alias("original_position"), "total_savings", "best_intervention", F.coalesce("positions_gained", F.lit(0)).alias("positions_gained"), "interventions"
    )


def flatten_interventions(planned: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """One row per driver and intervention, largest saving first, with its share of the driver's total."""
    rows = planned.select(*race, "vehicle_number", F.explode("interventions").alias("i")).select(*race, "vehicle_number", "i.*")
    w = Window.partitionBy(*race, "vehicle_number")
    return rows.withColumns(
        {
            "share": F.col("savings") / F.nullif(F.sum("savings").over(w), F.lit(0.0)),
            "place": F.row_number().over(w.orderBy(F.desc(F.round("savings", 9)), "feature")).cast("bigint"),
        }
    )


def traffic_from_positions(samples: DataFrame, distance: str, within: float, share: float = 0.3, stride: int = 10, least: int = 10, keys: Sequence[str] = (*RACE, "vehicle_number", "lap")) -> DataFrame:
    """Whether each lap was in traffic: over share of every stride-th sample has another car of the race, in the same
    lap number, less than within away.

    The nearest other car on a line is the last one before or the first one behind in distance order, so one
    ordered window over a lap's samples finds it; no pairs are formed.
    """
    group = [k for k in keys if k != "vehicle_number"]
    w = Window.partitionBy(*group).orderBy(distance, "vehicle_number", "n")
    here = F.struct(F.col(distance).alias("d"), F.col("vehicle_number").alias("v"))
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    # of the neighbour's own car the nearest sample of any other car: the last one, and the last of another car than it
    marked = samples.withColumn("__h", here)
    last, first = F.last("__h").over(before), F.first("__h").over(behind)
    marked = marked.withColumns({"__b": last, "__a": first})
    change_b = F.when(F.col("__b.v") != F.col("vehicle_number"), F.col("__b.d"))
    change_a = F.when(F.col("__a.v") != F.col("vehicle_number"), F.col("__a.d"))
    near = marked.withColumns({"__lo": F.last(change_b, ignorenulls=True).over(w), "__hi": F.first(change_a, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    nearest = F.least(F.col(distance) - F.col("__lo"), F.col("__hi") - F.col(distance))
    order = Window.partitionBy(*keys).orderBy("n")
    picked = near.withColumns({"__near": nearest, "__k": F.row_number().over(order)}).filter((F.col("__k") - 1) % stride == 0)
    n = F.count(F.lit(1))
    hits = F.count_if(F.coalesce(F.col("__near") < within, F.lit(False)))
    return picked.groupBy(*keys).agg(n.alias("n_samples"), hits.alias("n_near"), F.when(n >= least, hits > share * n).otherwise(False).alias("in_traffic"))
