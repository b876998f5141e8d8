"""Repair and reshaping of raw telemetry: pivots, JSON payloads, identifiers, lap numbers, gaps in values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.functions.scalars import integer, vehicle_from_id
from lapforge.operators.selection import overall_median

CORRUPT_LAP = 100
JSON_SIGNALS = "array<struct<name:string,value:double>>"


def pivot_signals(
    long: DataFrame, keys: Sequence[str], signals: Sequence[str], order: Sequence[str], name: str = "signal", value: str = "value"
) -> DataFrame:
    """Long to wide: the first non-null value of each signal in the given order; rows with a null key go.

    The list of signals is fixed by the caller, so the plan is one aggregation with no extra pass to find them.
    """
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    first = [F.min_by(value, F.when((F.col(name) == s) & F.col(value).isNotNull(), at)).alias(s) for s in signals]
    return long.dropna(subset=list(keys)).filter(F.col(name).isin(*signals)).groupBy(*keys).agg(*first)


def rename_long(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"telemetry_name": "signal", "telemetry_value": "value"})


def explode_json_signals(df: DataFrame, payload: str = "value") -> DataFrame:
    """One row per entry of a JSON array of {name, value}; malformed payloads drop out."""
    rest = [c for c in df.columns if c != payload]
    return df.select(*rest, F.explode(F.from_json(payload, JSON_SIGNALS)).alias("__s")).select(
        *rest, F.col("__s.name").alias("signal"), F.col("__s.value").alias("value")
    )


def vehicle_from_last_token(vehicle_id: Column) -> Column:
    """The last dash-separated token of an id of three parts or more; 0 where it is no number."""
    parts = F.split(vehicle_id, "-")
    return F.when(F.size(parts) >= 3, F.coalesce(integer(F.element_at(parts, -1)), F.lit(0))).otherwise(0)


def repair_vehicle(df: DataFrame, column: str = "vehicle_number", id_column: str = "vehicle_id", mode: str = "car") -> DataFrame:
    """Fill a missing vehicle number from the id; a car number of 0 takes the chassis token."""
    known = F.col(column) if column in df.columns else F.lit(None).cast("int")
    from_id = F.coalesce(known, vehicle_from_id(F.col(id_column), mode))
    chassis = vehicle_from_id(F.col(id_column), "chassis")
    return df.withColumn(column, F.when(from_id == 0, F.coalesce(chassis, F.lit(0))).otherwise(from_id))


def asof_laps(samples: DataFrame, starts: DataFrame, keys: Sequence[str], at: str = "ts_us") -> DataFrame:
    """The lap of the last start strictly before each sample, 0 before the first one.

    A union and one ordered window instead of a range join: linear in the rows of a vehicle.
    starts: keys, at, lap.
    """
    left = samples.drop("lap").withColumns({"__lap": F.lit(None).cast("bigint"), "__start": F.lit(0)})
    right = starts.select(*keys, at, F.col("lap").cast("bigint").alias("__lap"), F.lit(1).alias("__start"))
    w = Window.partitionBy(*keys).orderBy(at, "__start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right, allowMissingColumns=True)
    return (
        both.withColumn("lap", F.coalesce(F.last("__lap", ignorenulls=True).over(w), F.lit(0).cast("bigint")))
        .filter("__start = 0")
        .drop("__lap", "__start")
    )


def repair_laps(samples: DataFrame, starts: DataFrame, keys: Sequence[str], at: str = "ts_us") -> DataFrame:
    """As-of laps for vehicles with a corrupt lap number; vehicles without starts keep plausible laps."""
    w = Window.partitionBy(*keys)
    marked = samples.withColumns({"__bad": F.max("lap").over(w) >= CORRUPT_LAP, "__lap0": F.col("lap")})
    known = starts.select(*keys).distinct().withColumn("__has", F.lit(True))
    found = asof_laps(marked, starts, keys, at).join(known, list(keys), "left")
    fixed = F.when(F.col("__bad") & F.col("__has").isNotNull(), F.col("lap")).otherwise(F.col("__lap0"))
    return found.withColumn("lap", fixed).filter(F.col("lap") < CORRUPT_LAP).drop("__bad", "__lap0", "__has")


def normalise_signals(df: DataFrame) -> DataFrame:
    """GPS names and one throttle column: ath if there, else aps; with both, aps becomes throttle_pedal."""
    gps = {"VBOX_Lat_Min": "latitude", "VBOX_Long_Minutes": "longitude", "Laptrigger_lapdist_dls": "lap_distance"}
    out = df.withColumnsRenamed({a: b for a, b in gps.items() if a in df.columns})
    if "ath" in df.columns:
        out = out.withColumnRenamed("ath", "throttle")
        return out.withColumnRenamed("aps", "throttle_pedal") if "aps" in df.columns else out
    return out.withColumnRenamed("aps", "throttle") if "aps" in df.columns else out


def throttle_column(df: DataFrame) -> str | None:
    return next((c for c in ("throttle", "ath", "aps") if c in df.columns), None)


def fill_with_medians(df: DataFrame, column: str, group: Sequence[str]) -> DataFrame:
    """Nulls become the group's median, then the median of all rows.

    The overall median is selected by value ranges and joined by broadcast, one row.
    """
    w = Window.partitionBy(*group)
    overall = overall_median(df, column).select(F.col("median").alias("__all"))
    return df.crossJoin(F.broadcast(overall)).withColumn(column, F.coalesce(column, F.median(column).over(w), "__all")).drop("__all")


def interpolate(df: DataFrame, column: str, keys: Sequence[str], order: str) -> DataFrame:
    """Linear interpolation between known values by row; leading gaps stay, trailing ones take the last value."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("__n").alias("n"), F.col(column).alias("v")))
    marked = df.withColumn("__n", n).withColumn("__k", known)
    marked = marked.withColumns(
        {
            "__p": F.last("__k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "__q": F.first("__k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    slope = (F.col("__q.v") - F.col("__p.v")) / F.nullif(F.col("__q.n") - F.col("__p.n"), F.lit(0))
    between = F.col("__p.v") + slope * (F.col("__n") - F.col("__p.n"))
    filled = F.coalesce(column, between, "__p.v")
    return marked.withColumn(column, filled).drop("__n", "__k", "__p", "__q")


def unpivot_sectors(df: DataFrame, keys: Sequence[str], sectors: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(sectors), "sector", "seconds")


def with_track_constants(df: DataFrame, lengths_km: dict[str, float], track: str = "track") -> DataFrame:
    """Track length from a small table, expected lap time at 25 s a kilometre, z-score of lap time by track."""
    table = F.create_map(*[F.lit(x) for pair in lengths_km.items() for x in pair])
    w = Window.partitionBy(track)
    z = (F.col("lap_time") - F.avg("lap_time").over(w)) / F.nullif(F.stddev_samp("lap_time").over(w), F.lit(0.0))
    out = df.withColumn("track_length_km", table[F.col(track)])
    return out.withColumns({"expected_lap_time": F.col("track_length_km") * 25, "lap_time_z": z})


def union_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
