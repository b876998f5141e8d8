"""Read-side queries of a race: lap cards, histories, neighbours, sector losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.functions.scalars import bands
from lapforge.operators import RACE


def _vs_field(column: str, race: Sequence[str], *more: str):
    return F.col(column) - F.median(column).over(Window.partitionBy(*race, "lap", *more))


def lap_card(features: DataFrame, lap: int, race: Sequence[str] = RACE) -> DataFrame:
    """Everyone's position, gaps and pace against the field at one lap."""
    at = features.filter(F.col("lap") == lap).withColumn("vs_field", _vs_field("lap_time", race))
    return at.withColumn("band", bands(F.col("vs_field"), [(-0.5, "fast"), (0.5, "even")], "slow"))


def history(features: DataFrame, lap: int) -> DataFrame:
    return features.filter(F.col("lap") <= lap)


def sector_deltas(laps: DataFrame, sectors: Sequence[str], race: Sequence[str] = RACE) -> DataFrame:
    keys = [*race, "vehicle_number", "lap"]
    long = laps.unpivot(keys, list(sectors), "sector", "seconds")
    return long.withColumn("delta", _vs_field("seconds", race, "sector"))


def neighbours(features: DataFrame, lap: int, places: int, race: Sequence[str] = RACE) -> DataFrame:
    """Cars within a number of places: each position meets the few positions around it by equality."""
    at = features.filter(F.col("lap") == lap).select(*race, "vehicle_number", "position")
    around = F.sequence(F.col("position") - places, F.col("position") + places)
    wanted = at.select(*race, "vehicle_number", F.col("position").alias("__own"), F.explode(around).alias("position"))
    other = at.withColumnRenamed("vehicle_number", "neighbour")
    met = wanted.join(other, [*race, "position"]).filter(F.col("vehicle_number") != F.col("neighbour"))
    return met.select(*race, "vehicle_number", "neighbour", (F.col("position") - F.col("__own")).alias("places"))


def against_field(df: DataFrame, column: str, race: Sequence[str] = RACE) -> DataFrame:
    w = Window.partitionBy(*race)
    return df.withColumns(
        {"vs_median": F.col(column) - F.median(column).over(w), "vs_p25": F.col(column) - F.percentile(column, F.lit(0.25)).over(w)}
    )


def coaching_message(laps: DataFrame, sectors: Sequence[str], race: Sequence[str] = RACE) -> DataFrame:
    """A pace band, and the sector that lost most against the whole field if it lost over 0.2 s."""
    marked = laps.withColumns({"__v": _vs_field("lap_time", race), **{f"__{s}": _vs_field(s, race) for s in sectors}})
    worst = F.array_max(F.array(*[F.struct(F.col(f"__{s}").alias("d"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(sectors)]))
    loss = F.when(worst["d"] > 0.2, F.concat(F.lit("; lost most in "), worst["s"])).otherwise("")
    return marked.withColumn("message", F.concat(bands(F.col("__v"), [(-0.5, "Fast lap"), (0.5, "On pace")], "Off pace"), loss))


def roll_forward(features: DataFrame, total_laps: int, race: Sequence[str] = RACE) -> DataFrame:
    """The last row of each vehicle repeated for the laps left, at its mean pace of the last three laps."""
    last = features.groupBy(*race, "vehicle_number").agg(F.max("lap").alias("last"), F.max_by("rolling_avg_3", "lap").alias("pace"), F.max("cumulative_time").alias("so_far"))
    ahead = last.filter(F.col("last") < total_laps).withColumn("lap", F.explode(F.sequence(F.col("last") + 1, F.lit(total_laps).cast("bigint"))))
    return ahead.select(*race, "vehicle_number", "lap", (F.col("so_far") + F.col("pace") * (F.col("lap") - F.col("last"))).alias("forecast_time"))
