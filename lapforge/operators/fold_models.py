"""Models fitted once per fold: each fold is predicted by a model of all other folds.

The linear form needs no loop: the sums of all rows less those of a fold are the training sums of that fold. Trees
need a fit per fold and feature set; the fits are independent and run at the same time from a bounded pool
of driver threads, each as Spark jobs of its own. Their rows are computed once and written, and fewer fits run
at a time on large tables, since each keeps its rows in memory from tree to tree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators import RACE, boosting
from lapforge.operators import least_squares as LS
from lapforge.sources.session import kept

MAX_FOLDS = 64
#: Rows that the fits of one moment hold together.
ROWS_AT_ONCE = 40_000_000


def linear_folds(rows: DataFrame, columns: Sequence[str], fold: str, target: str = "lap_time") -> DataFrame:
    """rows with all values, with predicted (by least squares over the other folds), error and train_rmse. A lone fold has no others and no row.

    Columns that depend on those before them have coefficient 0, so a list may hold several forms of one quantity.
    """
    cols = [F.col(c).cast("double") for c in columns]
    whole = rows.dropna(subset=[*columns, target])
    per = whole.groupBy(fold).agg(*LS.sums(cols, F.col(target)))
    everywhere = Window.partitionBy(F.lit(0))  # one row a fold
    rest = per.select(fold, *[(F.sum(g).over(everywhere) - F.col(g)).alias(g) for g in LS.names(len(columns))])
    fits = LS.solve(rest.filter("g_0_0 > 0"), len(columns)).withColumn("train_rmse", F.sqrt(F.col("rss") / F.col("n_rows")))
    coefficients = [f"b{i}" for i in range(len(columns) + 1)]
    met = whole.join(fits.select(fold, *coefficients, "train_rmse"), fold)
    out = met.withColumn("predicted", LS.fitted(cols)).withColumn("error", F.col(target) - F.col("predicted"))
    return out.drop(*coefficients)


def boosted_folds(
    rows: DataFrame, feature_sets: Mapping[str, Sequence[str]], fold: str, target: str = "lap_time", parallel: int = 4, max_folds: int = MAX_FOLDS, **trees
) -> tuple[DataFrame, DataFrame]:
    """(scored, importances). scored: feature_set, the row's fold, predicted, error, train_rmse for each row of each fold, by gradient-boosted
    trees fitted on the other folds. importances: feature_set, fold, feature, importance, place; they add up to 1 a model.

    More than max_folds folds are refused: fold by a coarser column then. trees: as boosting.fit takes them.
    """
    spark = rows.sparkSession
    rows = kept(rows)
    sizes = {r[0]: r[1] for r in rows.groupBy(fold).count().limit(max_folds + 1).collect()}
    if len(sizes) > max_folds:
        raise ValueError(f"more than {max_folds} folds in {fold}")
    names = rows.columns

    def fit(task: tuple[str, object]):
        name, left_out = task
        columns = list(feature_sets[name])
        whole = rows.dropna(subset=[*columns, target])
        train, test = whole.filter(F.col(fold) != left_out), whole.filter(F.col(fold) == left_out)
        model = boosting.fit(train, columns, target, **trees)
        if model is None:
            return None
        guess = test.select(*names, F.lit(name).alias("feature_set"), model.predicted().alias("predicted"))
        scored = guess.withColumns({"error": F.col(target) - F.col("predicted"), "train_rmse": F.lit(model.train_rmse)})
        return scored, [(name, str(left_out), c, w) for c, w in zip(columns, model.importances, strict=True)]

    tasks = [(name, f) for name in feature_sets for f in sorted(f for f in sizes if f is not None)]
    largest = max([sum(sizes.values()) - sizes[f] for _, f in tasks], default=0)
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, ROWS_AT_ONCE // max(1, largest)))) as pool:
        done = [x for x in pool.map(inheritable_thread_target(spark)(fit), tasks) if x]
    if not done:
        none = rows.limit(0)
        empty = none.select(*names, F.lit("").alias("feature_set"), *[F.lit(0.0).alias(c) for c in ("predicted", "error", "train_rmse")])
        return empty, spark.createDataFrame([], "feature_set string, fold string, feature string, importance double, place bigint")
    weights = spark.createDataFrame([w for _, some in done for w in some], "feature_set string, fold string, feature string, importance double")
    order = Window.partitionBy("feature_set", "fold").orderBy(F.desc("importance"), "feature")
    return reduce(DataFrame.unionByName, [s for s, _ in done]), weights.withColumn("place", F.row_number().over(order).cast("bigint"))


def fold_errors(scored: DataFrame, by: Sequence[str], target: str = "lap_time") -> DataFrame:
    """train_rmse, test_rmse, mae, mean of the target and the error as a percentage of it."""
    e = F.col("error")
    rmse = F.sqrt(F.avg(e * e))
    return scored.groupBy(*by).agg(
        F.first("train_rmse").alias("train_rmse"), rmse.alias("test_rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(target).alias("mean_target"),
        (100 * rmse / F.nullif(F.avg(target), F.lit(0.0))).alias("pct_error"), F.count(F.lit(1)).alias("n"),
    )


def winner_accuracy(predicted: DataFrame, from_laps: Sequence[int] = (5, 10, 15, 20), race: Sequence[str] = RACE) -> DataFrame:
    """Per race and starting lap: the winner by the time so far plus predicted times of the laps left, the one by actual times, whether they agree, and the predicted margin.

    A vehicle without the starting lap has no time so far, as published. predicted: race, vehicle_number, lap, lap_time, cumulative_time, predicted.
    """
    at = F.explode(F.array(*[F.lit(x) for x in from_laps])).alias("from_lap")
    keys = [*race, "from_lap"]
    later = F.col("lap") > F.col("from_lap")
    total = (
        predicted.select(*race, "vehicle_number", "lap", "lap_time", "cumulative_time", "predicted", at)
        .filter(F.col("lap") >= F.col("from_lap"))
        .groupBy(*keys, "vehicle_number")
        .agg(
            F.coalesce(F.max(F.when(F.col("lap") == F.col("from_lap"), F.col("cumulative_time"))), F.lit(0.0)).alias("so_far"),
            F.sum(F.when(later, F.col("predicted"))).alias("predicted"),
            F.sum(F.when(later, F.col("lap_time"))).alias("actual"),
        )
        .filter("predicted is not null")
    )
    best = lambda c: F.struct((F.col("so_far") + F.col(c)).alias("t"), F.col("vehicle_number").alias("v"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(best("predicted")))
    ranked = total.withColumn("__k", place)  # a race's cars
    guess = F.col("so_far") + F.col("predicted")
    out = ranked.groupBy(*keys).agg(
        F.min(best("predicted"))["v"].alias("predicted_winner"),
        F.min(best("actual"))["v"].alias("actual_winner"),
        F.coalesce(F.max(F.when(F.col("__k") == 2, guess)) - F.min(guess), F.lit(0.0)).alias("predicted_margin"),
    )
    return out.withColumn("correct", F.col("predicted_winner") == F.col("actual_winner"))
