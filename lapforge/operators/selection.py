"""Exact quantiles and ranks of a whole table without one task that holds it.

`exact_quantiles` selects by value ranges: a range is cut into BUCKETS, counted, and only the bucket that holds a
wanted rank is looked at further, until it has at most LEAF values or one value. A pass returns one row per wanted rank.
`global_rank` deals rows out by ranges of the order, numbers them inside their part and adds what the parts before hold.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.sources.session import shared_dir

BUCKETS = 4096
LEAF = 2048
#: Most ranks that one call looks for; they are what the driver holds.
MAX_RANKS = 10_000


def _bucket(x: Column, low: Column, high: Column) -> Column:
    """0 for the lower end, BUCKETS + 1 for the upper end, 1 to BUCKETS between; both ends are values that occur."""
    share = (x / 2 - low / 2) / (high / 2 - low / 2)  # halves, so that the width does not overflow
    inner = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)) + 1
    return F.when(x == low, 0).when(x == high, BUCKETS + 1).when(F.isnan(share), 1).otherwise(inner).cast("int")


def exact_quantiles(rows: DataFrame, signal: str, value: str, shares: Sequence[float]) -> DataFrame:
    """signal, share, quantile: quantiles of value per signal with linear interpolation, as `percentile` has them.

    Nulls and NaN are left out; a signal without values has no row. Meant for few signals with very many rows each (a row is
    looked at once a pass); for many small groups use `percentile`.
    """
    spark = rows.sparkSession
    kind = rows.schema[signal].dataType
    table = rows.select(F.col(signal).alias("s"), F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = table.groupBy("s").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    if len(ends) * len(shares) * 2 > MAX_RANKS:
        raise ValueError(f"more than {MAX_RANKS} ranks to look for; these groups are many and small, use percentile")
    size = {r["s"]: r["n"] for r in ends}
    wanted = {(s, k) for s, n in size.items() for q in shares for k in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}
    found: dict[tuple, float] = {}
    # (signal, low, high, values before low, values inside) -> ranks looked for inside
    ranges = {(r["s"], r["lo"], r["hi"], 0, r["n"]): sorted(k for s, k in wanted if s == r["s"]) for r in ends}
    while ranges:
        for key in [key for key in ranges if key[1] == key[2]]:
            found.update(((key[0], k), key[1]) for k in ranges.pop(key))
        small = {key: ranks for key, ranks in ranges.items() if key[4] <= LEAF}
        large = {key: ranks for key, ranks in ranges.items() if key[4] > LEAF}
        if small:
            for r in _inside(table, small).groupBy("s", "lo", "hi", "before").agg(F.sort_array(F.collect_list("x")).alias("x")).collect():  # LEAF values at most
                for k in next(ranks for key, ranks in small.items() if key[:4] == (r["s"], r["lo"], r["hi"], r["before"])):
                    found[r["s"], k] = r["x"][k - r["before"]]
        ranges = _narrowed(table, large) if large else {}
    out = []
    for s, n in size.items():
        for q in shares:
            at = (n - 1) * q
            low, high = found[s, math.floor(at)], found[s, math.ceil(at)]
            out.append((s, float(q), low if low == high else low * (math.ceil(at) - at) + high * (at - math.floor(at))))
    return spark.createDataFrame(out, _schema(signal, kind))


def _schema(signal: str, kind):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(signal, kind), T.StructField("share", T.DoubleType()), T.StructField("quantile", T.DoubleType())])


def _inside(table: DataFrame, ranges: dict) -> DataFrame:
    """s, x and lo, hi, before, ranks of each range that the value lies in. Ranges of a signal do not overlap but at single values."""
    by_signal: dict = {}
    for (s, lo, hi, before, _), ranks in ranges.items():
        one = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(before).cast("bigint").alias("before"), F.array(*[F.lit(k).cast("bigint") for k in ranks]).alias("ranks"))
        by_signal.setdefault(s, []).append(one)
    options = F.array().cast("array<struct<lo:double,hi:double,before:bigint,ranks:array<bigint>>>")
    for s, some in by_signal.items():
        options = F.when(F.col("s").eqNullSafe(F.lit(s)), F.array(*some)).otherwise(options)
    met = F.filter(options, lambda r: F.col("x").between(r["lo"], r["hi"]))
    return table.select("s", "x", F.explode(met).alias("r")).select("s", "x", "r.*")


def _narrowed(table: DataFrame, ranges: dict) -> dict:
    """The bucket of each rank: one scan, at most BUCKETS + 2 counts a range, one row a rank back."""
    counted = (
        _inside(table, ranges)
        .groupBy("s", "lo", "hi", "before", "ranks", _bucket(F.col("x"), F.col("lo"), F.col("hi")).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    )
    run = Window.partitionBy("s", "lo", "hi", "before").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n").over(run), F.lit(0))
    placed = counted.withColumn("start", start)
    ranks = F.filter("ranks", lambda k: (k >= F.col("start")) & (k < F.col("start") + F.col("n")))
    hit = placed.withColumn("hit", ranks).filter(F.size("hit") > 0)
    return {(r["s"], r["low"], r["high"], r["start"], r["n"]): list(r["hit"]) for r in hit.select("s", "low", "high", "start", "n", "hit").collect()}


def overall_median(rows: DataFrame, column: str) -> DataFrame:
    """One row, `median`: the exact median of a column over all rows, null without values."""
    one = exact_quantiles(rows.select(F.lit("all").alias("signal"), column), "signal", column, [0.5])
    return one.agg(F.max("quantile").alias("median"))


def global_rank(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """rows with their number from 1 in the given order, which must decide all ties for a stable result.

    Parts are ranges of the order, written once, so that counts and numbers speak of the same parts; offsets are one row a part.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/lapforge-ranked-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = parts.withColumn(name, inside.cast("bigint")).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
