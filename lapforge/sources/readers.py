"""Scans of race files: long telemetry, lap times, weather, sector and endurance tables, Parquet.

Every scan gives the column types itself instead of letting Spark guess them, and filters before it
pivots. Names of files are found through Spark's own file system, so folders may lie in any store it reads.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapforge.functions.scalars import clock_seconds, integer, micros, number, strip_headers
from lapforge.operators import repair
from lapforge.operators.race import LAP_SENTINEL, keep_last, lap_time_diff, valid_laps

TELEMETRY = "lap int, vehicle_number int, vehicle_id string, telemetry_name string, telemetry_value double, timestamp string, meta_time string"
WEATHER = {"TIME_UTC_STR": "timestamp", "AIR_TEMP": "air_temp", "TRACK_TEMP": "track_temp", "HUMIDITY": "humidity", "PRESSURE": "pressure", "WIND_SPEED": "wind_speed", "RAIN": "rain"}
ENDURANCE = {"NUMBER": "vehicle_number", "LAP_NUMBER": "lap", "S1_SECONDS": "s1", "S2_SECONDS": "s2", "S3_SECONDS": "s3", "KPH": "kph", "TOP_SPEED": "top_speed"}
YELLOW_FLAGS = ("FCY", "SC")
GPS = {"VBOX_Lat_Min": "latitude", "VBOX_Long_Minutes": "longitude", "speed": "speed"}


def delimited(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Text columns under stripped names; types are for the caller to give."""
    return strip_headers(spark.read.option("header", True).option("sep", sep).option("escape", "\"").csv(path))


def typed(df: DataFrame, ddl: str) -> DataFrame:
    """The columns that ddl names and df has, cast; what cannot be cast is NULL."""
    kinds = [x.strip().split(" ") for x in ddl.split(",")]
    return df.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in kinds if c in df.columns])


def _wanted(column: str, value):
    values = value if isinstance(value, (list, tuple, set)) else [value]
    return F.col(column).isin(*values)


def telemetry(spark: SparkSession, path: str, vehicle=None, lap=None, parameters: Sequence[str] | None = None, wide: Sequence[str] | None = None) -> DataFrame:
    """Long telemetry with ts_us, filtered by vehicle, lap (one or several) and signal; wide: the signals to pivot."""
    rows = typed(delimited(spark, path), TELEMETRY).withColumn("ts_us", micros(F.col("timestamp").try_cast("timestamp")))
    for column, value in (("vehicle_number", vehicle), ("lap", lap), ("telemetry_name", parameters or wide)):
        rows = rows.filter(_wanted(column, list(value) if isinstance(value, (list, tuple)) else value)) if value is not None else rows
    if wide is None:
        return rows.orderBy("ts_us")
    return repair.pivot_signals(repair.rename_long(rows), ["vehicle_number", "lap", "ts_us"], wide, ["ts_us"]).orderBy("vehicle_number", "lap", "ts_us")


def gps(spark: SparkSession, path: str, vehicle=None, lap=None) -> DataFrame:
    """Positions and speed with both coordinates; an error if the file has no position signals."""
    there = set(distinct_values(typed(delimited(spark, path), TELEMETRY), "telemetry_name"))
    if missing := [s for s in GPS if s not in there]:
        raise ValueError(f"signals missing: {', '.join(missing)}")
    return telemetry(spark, path, vehicle, lap, wide=list(GPS)).withColumnsRenamed(GPS).dropna(subset=["latitude", "longitude"])


def lap_times(spark: SparkSession, path: str, vehicle=None, max_lap: int | None = None, least: float = 60.0, most: float = 300.0) -> DataFrame:
    """Lap ends: the last row of each (vehicle, lap), times by difference, implausible laps left out."""
    rows = delimited(spark, path)
    known = typed(rows, "lap int, vehicle_number int, vehicle_id string, timestamp string")
    fixed = known.withColumn("ts_us", micros(F.col("timestamp").try_cast("timestamp"))).filter(F.col("lap") < LAP_SENTINEL)
    fixed = repair.repair_vehicle(fixed, mode="chassis") if "vehicle_id" in known.columns else fixed
    fixed = fixed.filter(_wanted("vehicle_number", vehicle)) if vehicle is not None else fixed
    one = keep_last(fixed, ["vehicle_number", "lap"], [F.desc_nulls_last("ts_us")])
    return valid_laps(lap_time_diff(one, ()), least, most, max_lap)


def weather(spark: SparkSession, path: str) -> DataFrame:
    rows = delimited(spark, path, ";")
    return rows.select(*[(F.col(a) if b == "timestamp" else number(F.col(a))).alias(b) for a, b in WEATHER.items() if a in rows.columns])


def weather_summary(spark: SparkSession, path: str) -> DataFrame:
    rows = weather(spark, path)
    return rows.agg(*[F.avg(c).alias(c) for c in ("air_temp", "track_temp", "humidity", "pressure", "wind_speed") if c in rows.columns])


def endurance(spark: SparkSession, path: str, vehicle=None) -> DataFrame:
    """Sector times, speeds and whether the lap ended under yellow."""
    rows = delimited(spark, path, ";")
    ints = ("vehicle_number", "lap")
    known = [(integer(F.trim(a)) if b in ints else number(F.trim(a))).alias(b) for a, b in ENDURANCE.items() if a in rows.columns]
    flag = F.trim("FLAG_AT_FL").isin(*YELLOW_FLAGS) if "FLAG_AT_FL" in rows.columns else F.lit(False)
    time = [clock_seconds(F.col("LAP_TIME")).alias("lap_time")] if "LAP_TIME" in rows.columns else []
    out = rows.select(*known, *time, F.coalesce(flag, F.lit(False)).cast("int").alias("is_under_yellow")).filter("vehicle_number is not null")
    return out.filter(_wanted("vehicle_number", vehicle)) if vehicle is not None else out


def sectors(spark: SparkSession, path: str) -> DataFrame:
    """One row per (vehicle, lap): the first in the file."""
    rows = endurance(spark, path).withColumn("__at", F.monotonically_increasing_id())
    return keep_last(rows, ["vehicle_number", "lap"], [F.col("__at")]).drop("__at")


def best_laps(spark: SparkSession, path: str) -> DataFrame:
    """(vehicle_number, best_lap) with times of "M:SS.mmm" or seconds."""
    rows = delimited(spark, path, ";")
    return rows.select(integer(F.trim("NUMBER")).alias("vehicle_number"), clock_seconds(F.col("BESTLAP_1")).alias("best_lap")).dropna()


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def distinct_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values of a column of few values (vehicles, signals)."""
    return [r[0] for r in df.select(column).dropna().distinct().orderBy(column).collect()]


def signals(spark: SparkSession, path: str, rows: int = 10_000) -> list[str]:
    """Sorted signal names: among the first rows of a long file, in the first row's payload of a JSON file; none if there is neither, or the payload cannot be read."""
    table = delimited(spark, path)
    if "telemetry_name" in table.columns:
        return distinct_values(table.limit(rows), "telemetry_name")
    if "value" not in table.columns:
        return []
    parsed = [F.from_json(text, repair.JSON_SIGNALS)["name"] for text in (F.col("value"), F.regexp_replace("value", '""', '"'))]  # as it is, or with doubled quotes
    first = table.select(F.coalesce(*[F.when(~F.exists(names, lambda x: x.isNull()), names) for names in parsed]).alias("names")).first()
    return sorted(first["names"]) if first and first["names"] else []


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted paths in a folder of any store Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(x.getPath().toString()) for x in fs.listStatus(path)) if fs.exists(path) else []


def find_file(spark: SparkSession, folder: str, *patterns: str) -> str | None:
    """The first file that matches the first pattern that any file matches; letter case does not count."""
    names = file_names(spark, folder)
    for p in patterns:
        hit = [n for n in names if fnmatch.fnmatch(n.rsplit("/", 1)[-1].lower(), p.lower())]
        if hit:
            return hit[0]
    return None


def race_folder(spark: SparkSession, folder: str, wide: Sequence[str], vehicle=None, laps=None, starts: DataFrame | None = None) -> DataFrame:
    """All telemetry files of a folder, long or JSON by their header; vehicles and laps repaired, then pivoted."""
    files = [n for n in file_names(spark, folder) if fnmatch.fnmatch(n.rsplit("/", 1)[-1].lower(), "*telemetry*.csv")]
    if not files:
        raise FileNotFoundError(f"no telemetry file in {folder}")
    rows = delimited(spark, files)
    if "telemetry_name" in rows.columns:
        long = repair.rename_long(rows)
    elif "value" in rows.columns:
        long = repair.explode_json_signals(rows)
    else:
        raise ValueError(f"unknown telemetry format: {', '.join(rows.columns)}")
    time = F.coalesce(*[F.col(c).try_cast("timestamp") for c in ("meta_time", "timestamp") if c in long.columns])
    long = long.withColumns({"ts_us": micros(time), "value": F.col("value").try_cast("double"), "lap": integer(F.col("lap"))})
    long = long.withColumn("vehicle_number", integer(F.col("vehicle_number"))) if "vehicle_number" in long.columns else long
    long = repair.repair_vehicle(long) if "vehicle_id" in long.columns else long
    long = repair.repair_laps(long, starts, ["vehicle_number"]) if starts is not None else long.filter(F.col("lap") < repair.CORRUPT_LAP)
    for column, value in (("vehicle_number", vehicle), ("lap", laps)):
        long = long.filter(_wanted(column, value)) if value is not None else long
    return repair.normalise_signals(repair.pivot_signals(long, ["vehicle_number", "lap", "ts_us"], wide, ["ts_us"]))


def lap_times_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Lap times of a folder: the endurance table if there, else differences of lap ends; nothing filtered."""
    if path := find_file(spark, folder, "*AnalysisEndurance*.csv"):
        return endurance(spark, path).select("vehicle_number", "lap", "lap_time")
    path = find_file(spark, folder, "*lap_time*.csv")
    if path is None:
        raise FileNotFoundError(f"no lap times in {folder}")
    rows = delimited(spark, path)
    if "value" in rows.columns and "timestamp" not in rows.columns:
        return rows.select(integer(F.col("vehicle_number")).alias("vehicle_number"), integer(F.col("lap")).alias("lap"), (number(F.col("value")) / 1000).alias("lap_time"))
    known = typed(rows, "lap int, vehicle_number int, timestamp string").withColumn("ts_us", micros(F.col("timestamp").try_cast("timestamp")))
    return lap_time_diff(known, ()).select("vehicle_number", "lap", "lap_time")


def sample_per_lap(df: DataFrame, k: int, keys: Sequence[str] = ("vehicle_number", "lap"), seed: int = 42) -> DataFrame:
    """Up to k rows of each key, the same at every run: a sampling operator."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *df.columns))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def audit_sample(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """The first rows of a file with commas, or with semicolons if commas give one column: a sampling operator."""
    comma = delimited(spark, path)
    return (comma if len(comma.columns) > 1 else delimited(spark, path, ";")).limit(rows)


def tagged(features: DataFrame, track: str, race: int) -> DataFrame:
    """features of one race under track, race_num and race_id."""
    return features.withColumns({"track": F.lit(track), "race_num": F.lit(race), "race_id": F.lit(f"{track}_R{race}")})
