"""Expanding-window validation of regression models: each lap is predicted by a fit of the laps before it.

Sums of products per race and lap are added up over earlier laps in one window, so the fit of every training end
comes from one pass and one solve per race and lap. No loop over laps, no training set built twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators import RACE
from lapforge.operators import least_squares as LS

RELATIVE_FEATURES = ("position", "gap_to_ahead", "gap_to_behind", "driver_baseline", "prev_relative")
STEPS = (1, 3, 5, 10)


def _centre(rows: DataFrame, columns: Sequence[str], until: int, race: Sequence[str]) -> DataFrame:
    """Columns less their mean over the laps up to `until` of their race: the same fits, with less cancellation in the sums."""
    first = Window.partitionBy(*race)
    return rows.withColumns({f"__{c}": F.col(c).cast("double") - F.coalesce(F.avg(F.when(F.col("lap") <= until, F.col(c))).over(first), F.lit(0.0)) for c in columns})


def running_fits(rows: DataFrame, columns: Sequence[str], target: str, race: Sequence[str] = RACE) -> DataFrame:
    """race, since and the solved fit over all rows of laps up to since, for every lap that occurs."""
    cols = [F.col(c) for c in columns]
    whole = rows.dropna(subset=[*columns, target])
    per_lap = whole.groupBy(*race, "lap").agg(*LS.sums(cols, F.col(target)))
    upto = Window.partitionBy(*race).orderBy("lap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = per_lap.select(*race, F.col("lap").alias("since"), *[F.sum(g).over(upto).alias(g) for g in LS.names(len(columns))])
    return LS.solve(total, len(columns))


def relative_features(relative: DataFrame, early: tuple[int, int] = (3, 5), race: Sequence[str] = RACE) -> DataFrame:
    """Adds driver_baseline, the mean relative time of the early laps (0 without any), and prev_relative, the lap before
    (the baseline for a vehicle's first row)."""
    vehicle = Window.partitionBy(*race, "vehicle_number")
    base = F.coalesce(F.avg(F.when(F.col("lap").between(*early), F.col("relative_time"))).over(vehicle), F.lit(0.0))
    previous = F.lag("relative_time").over(vehicle.orderBy("lap"))
    out = relative.withColumn("driver_baseline", base)
    return out.withColumn("prev_relative", F.coalesce(previous, F.col("driver_baseline")))


def expanding_relative(
    relative: DataFrame,
    least: int = 5,
    early: tuple[int, int] = (3, 5),
    horizons: Sequence[int] = (1,),
    known_previous: bool = False,
    race: Sequence[str] = RACE,
) -> DataFrame:
    """One row per race, vehicle, training end and horizon: the relative time of lap train_end + horizon from a fit over laps up to train_end.

    Features: position, gaps to both neighbours, driver baseline, previous relative time. For the lap to predict the
    published form takes the baseline as previous relative time; known_previous takes the value at train_end, if
    the vehicle has that lap. Training ends before the early laps are over would let later laps into the baseline and
    are refused. relative: race, vehicle_number, lap, position, gap_to_ahead, gap_to_behind, relative_time.
    """
    if least < early[1]:
        raise ValueError(f"the baseline needs laps up to {early[1]}; the first training end must not come before")
    rows = _centre(relative_features(relative, early, race), RELATIVE_FEATURES[:3], least, race)
    inputs = [*[f"__{c}" for c in RELATIVE_FEATURES[:3]], *RELATIVE_FEATURES[3:]]
    fits = running_fits(rows, inputs, "relative_time", race)
    steps = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    keys = [*race, "vehicle_number"]
    tests = rows.select(*keys, "lap", "position", "relative_time", *inputs, steps).withColumn("train_end", F.col("lap") - F.col("horizon")).filter(F.col("train_end") >= least)
    if known_previous:
        now = rows.select(*keys, F.col("lap").alias("train_end"), F.col("relative_time").alias("__now"))
        tests = tests.join(now, [*keys, "train_end"], "left")
    else:
        tests = tests.withColumn("__now", F.lit(None).cast("double"))
    met = _as_of(tests, fits, list(race), [f"b{i}" for i in range(len(inputs) + 1)])
    used = [*[F.col(c) for c in inputs[:-1]], F.coalesce("__now", "driver_baseline")]
    scored = met.withColumn("predicted", LS.fitted(used)).filter("predicted is not null")
    return scored.select(*keys, "train_end", F.col("lap").alias("target_lap"), "horizon", "position", F.col("relative_time").alias("actual"), "predicted", (F.col("relative_time") - F.col("predicted")).alias("error"))


def least_norm_pair(s: dict[str, Column]) -> tuple[Column, Column]:
    """Slopes of lap and position of the published model, whose third column is the laps left (minus lap): of all
    equally good triples it takes the one of least norm. s: centred sums ll, pp, lp, ly, py."""
    det = s["ll"] * s["pp"] - s["lp"] * s["lp"]
    free = det > 1e-9 * s["ll"] * s["pp"]
    c = s["lp"] / s["ll"]
    tied = (s["ly"] / s["ll"]) / (1 + c * c / 2)  # position is a line in lap: its slope shares the change
    lap = F.when(free, (s["ly"] * s["pp"] - s["py"] * s["lp"]) / det).when(s["ll"] > 0, tied).otherwise(0.0)
    position = F.when(free, (s["py"] * s["ll"] - s["ly"] * s["lp"]) / det).when(s["ll"] > 0, tied * c / 2).otherwise(0.0)
    return lap, position


_PAIR = ("n", "l", "p", "y", "ll", "pp", "lp", "ly", "py")


def _pair_sums(lap: Column, position: Column, y: Column) -> dict[str, Column]:
    lap, position = lap.cast("double"), position.cast("double")
    return dict(zip(_PAIR, (F.lit(1.0), lap, position, y, lap * lap, position * position, lap * position, lap * y, position * y), strict=True))


def _pair_fit(rows: DataFrame, prefix: str) -> DataFrame:
    """Adds <prefix>n, <prefix>b0, <prefix>b1, <prefix>b2 from the sums of _pair_sums."""
    n = F.nullif(F.col("n"), F.lit(0.0))
    mean = {c: F.col(c) / n for c in ("l", "p", "y")}
    centred = {a + b: F.col(a + b) - F.col(a) * F.col(b) / n for a, b in (("l", "l"), ("p", "p"), ("l", "p"), ("l", "y"), ("p", "y"))}
    lap, position = least_norm_pair(centred)
    out = rows.withColumns({f"{prefix}n": F.col("n").cast("bigint"), f"{prefix}b1": lap, f"{prefix}b2": position})
    return out.withColumn(f"{prefix}b0", mean["y"] - F.col(f"{prefix}b1") * mean["l"] - F.col(f"{prefix}b2") * mean["p"]).drop(*_PAIR)


def expanding_baseline(features: DataFrame, least: int = 5, horizons: Sequence[int] = STEPS, race: Sequence[str] = RACE) -> DataFrame:
    """Lap times from each vehicle's own regression on lap, position and laps left over laps up to train_end, for every training end
    and horizon; a vehicle with fewer than three laps by then is predicted by the regression over all vehicles of its race.

    features: race, vehicle_number, lap, position, lap_time.
    """
    keys = [*race, "vehicle_number"]
    rows = features.select(*keys, "lap", "position", "lap_time").dropna()
    y = F.col("lap_time")
    terms = _pair_sums(F.col("lap"), F.col("position"), y)
    vehicle = Window.partitionBy(*keys).orderBy("lap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select(*keys, F.col("lap").alias("since"), *[F.sum(v).over(vehicle).alias(k) for k, v in terms.items()])
    own = _pair_fit(own, "own_")
    per_lap = rows.groupBy(*race, "lap").agg(*[F.sum(v).alias(k) for k, v in terms.items()])
    field = Window.partitionBy(*race).orderBy("lap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everyone = _pair_fit(per_lap.select(*race, F.col("lap").alias("since"), *[F.sum(k).over(field).alias(k) for k in terms]), "all_")
    tests = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("train_end", F.col("lap") - F.col("horizon")).filter(F.col("train_end") >= least)
    tests = _as_of(tests, own, keys, [c for c in own.columns if c.startswith("own_")])
    tests = _as_of(tests, everyone, list(race), [c for c in everyone.columns if c.startswith("all_")])
    use = lambda b: F.when(F.col("own_n") >= 3, F.col(f"own_{b}")).otherwise(F.col(f"all_{b}"))
    predicted = use("b0") + use("b1") * F.col("lap") + use("b2") * F.col("position")
    out = tests.withColumns({"predicted": predicted, "own_model": F.coalesce(F.col("own_n") >= 3, F.lit(False))}).filter("predicted is not null")
    return out.select(*keys, "train_end", F.col("lap").alias("target_lap"), "horizon", "position", F.col("lap_time").alias("actual"), "predicted", (y - F.col("predicted")).alias("error"), "own_model")


def _as_of(tests: DataFrame, fits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds to each test the columns of the last fit of its key with since <= train_end: one union and one ordered window."""
    rest = [c for c in tests.columns if c not in keys]
    both = tests.select(*keys, *rest, *[F.lit(None).cast(fits.schema[c].dataType).alias(c) for c in columns], F.col("train_end").alias("__at"), F.lit(1).alias("__test")).unionByName(
        fits.select(*keys, *[F.lit(None).cast(tests.schema[c].dataType).alias(c) for c in rest], *columns, F.col("since").alias("__at"), F.lit(0).alias("__test"))
    )
    w = Window.partitionBy(*keys).orderBy("__at", "__test").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return filled.filter("__test = 1").drop("__at", "__test")


def cross_race(train: DataFrame, test: DataFrame, match: Sequence[str], race: Sequence[str] = RACE) -> DataFrame:
    """Each row of test predicted by the fit of its vehicle in the matching training race, or by that race's own over all
    vehicles where it has fewer than three laps there.

    match: the columns that say which training race goes with a test race (a track, say); both tables have them.
    """
    on = [*match, "vehicle_number"]
    terms = _pair_sums(F.col("lap"), F.col("position"), F.col("lap_time"))
    known = train.dropna(subset=["lap", "position", "lap_time"])
    own = _pair_fit(known.groupBy(*on).agg(*[F.sum(v).alias(k) for k, v in terms.items()]), "own_")
    everyone = _pair_fit(known.groupBy(*match).agg(*[F.sum(v).alias(k) for k, v in terms.items()]), "all_")
    use = lambda b: F.when(F.col("own_n") >= 3, F.col(f"own_{b}")).otherwise(F.col(f"all_{b}"))
    met = test.join(everyone, list(match)).join(own, on, "left")
    predicted = use("b0") + use("b1") * F.col("lap") + use("b2") * F.col("position")
    own_columns = [c for c in met.columns if c.startswith(("own_", "all_"))]
    return met.withColumns({"predicted": predicted, "own_model": F.coalesce(F.col("own_n") >= 3, F.lit(False))}).withColumn("error", F.col("lap_time") - F.col("predicted")).drop(*own_columns)


def step_errors(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    """rmse, mae and count of errors by any columns."""
    e = F.col("error")
    return errors.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n"))
