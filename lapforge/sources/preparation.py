"""Features of many races from their folders, with races that cannot be read set aside and explained.

Folders lie under <root>/<track>/race<number>. A race needs a lap-time file; weather and endurance tables are used where they
are. A race that lacks a file, a column or any usable lap does not stop the others: it becomes a row of why.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.operators.race import race_features
from lapforge.operators.repair import union_ragged
from lapforge.sources import readers

REASONS = "track string, race_num int, reason string"
NEEDED = ("lap", "vehicle_number", "timestamp")


@dataclass(frozen=True)
class Track:
    """A track's folders: name, patterns of its files, and the laps that each race is known to have."""

    key: str
    name: str
    races: Sequence[int] = (1, 2)
    lap_times: Sequence[str] = ("*lap_time*R{race}*.csv", "*lap_time*.csv")
    weather: Sequence[str] = ("*weather*race*{race}*.csv", "*weather*.csv")
    endurance: Sequence[str] = ("*analysisendurance*race*{race}*.csv", "*analysisendurance*.csv")
    total_laps: dict[int, int] = field(default_factory=dict)


class Rejected(Exception):
    """A race that cannot be prepared, with the reason."""


def resolve(spark: SparkSession, root: str, track: Track, race: int) -> dict[str, str | None]:
    """Paths of a race's files: lap_times, weather, endurance; None for those that are not there."""
    folder = f"{root.rstrip('/')}/{track.key}/race{race}"
    if not readers.file_names(spark, folder):
        raise Rejected(f"no folder race{race}")
    find = lambda patterns: readers.find_file(spark, folder, *[p.format(race=race) for p in patterns])
    return {"lap_times": find(track.lap_times), "weather": find(track.weather), "endurance": find(track.endurance)}


def prepare_race(spark: SparkSession, root: str, track: Track, race: int) -> DataFrame:
    """Features of one race under track, track_name, race_num and race_id; Rejected if it cannot be prepared."""
    files = resolve(spark, root, track, race)
    if files["lap_times"] is None:
        raise Rejected("no lap-time file")
    there = readers.delimited(spark, files["lap_times"]).columns
    if gone := [c for c in NEEDED if c not in there]:
        raise Rejected(f"columns missing: {', '.join(gone)}")
    laps = readers.lap_times(spark, files["lap_times"])
    last = laps.agg(F.max("lap")).first()[0]
    if last is None:
        raise Rejected("no usable lap")
    total = min(last, track.total_laps.get(race, last))
    rows = race_features(laps.filter(F.col("lap") <= total).withColumn("race", F.lit(race)), total)
    if files["endurance"]:
        flags = readers.endurance(spark, files["endurance"])
        some = [c for c in ("top_speed", "s1", "s2", "s3", "is_under_yellow") if c in flags.columns]
        flags = flags.groupBy("vehicle_number", "lap").agg(*[F.max(c).alias(c) for c in some])
        rows = rows.join(flags, ["vehicle_number", "lap"], "left")
    if "is_under_yellow" not in rows.columns:
        rows = rows.withColumn("is_under_yellow", F.lit(0))
    rows = rows.withColumn("is_under_yellow", F.coalesce("is_under_yellow", F.lit(0)))
    if files["weather"]:
        rows = rows.crossJoin(F.broadcast(readers.weather_summary(spark, files["weather"])))  # one row
    return rows.drop("race").withColumns({"track": F.lit(track.key), "track_name": F.lit(track.name), "race_num": F.lit(race), "race_id": F.lit(f"{track.key}_r{race}"), "total_laps": F.lit(total)})


def prepare_races(spark: SparkSession, root: str, tracks: Sequence[Track]) -> tuple[DataFrame | None, DataFrame]:
    """(features of all races that could be prepared, or None without any; one row of track, race_num and reason for each other).

    A column whose kind differs from that of the races before it sets its race aside, as a union would fail. Columns that a race lacks are null.
    """
    good: list[DataFrame] = []
    kinds: dict[str, str] = {}
    rejected = []
    for track in tracks:
        for race in track.races:
            try:
                rows = prepare_race(spark, root, track, race)
                if clash := [f"{c} is {k}, not {kinds[c]}" for c, k in rows.dtypes if kinds.get(c, k) != k]:
                    raise Rejected("; ".join(clash))
            except Rejected as why:
                rejected.append((track.key, race, str(why)))
                continue
            except PySparkException as why:
                rejected.append((track.key, race, f"cannot be read: {why.getCondition() or type(why).__name__}"))
                continue
            good.append(rows)
            kinds |= dict(rows.dtypes)
    return (union_ragged(good) if good else None), spark.createDataFrame(rejected, REASONS)
