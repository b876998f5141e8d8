"""Scalar column functions: dirty text to values, geometry, banding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_000.0


def number(text: Column) -> Column:
    """A double, or NULL for text that is no number; NaN counts as NULL."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def integer(text: Column) -> Column:
    return text.try_cast("int")


def padded(value: Column, width: int) -> Column:
    """Digits of a number from 0 up with leading zeros; longer numbers stay whole, which lpad would cut."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def clock_seconds(text: Column) -> Column:
    """Seconds of "M:SS.mmm" or of a plain number; NULL for anything else."""
    parts = F.split(F.trim(text), ":")
    clock = F.get(parts, F.lit(0)).try_cast("double") * 60 + F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 2, clock).when(F.size(parts) == 1, F.get(parts, F.lit(0)).try_cast("double"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later_us: Column, earlier_us: Column) -> Column:
    return (later_us - earlier_us) / F.lit(1_000_000.0)


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def planar_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def bands(value: Column, upper: list[tuple[float, str]], otherwise: str, closed: bool = False) -> Column:
    """The label of the first upper bound above value (or at it, if closed); NULL stays NULL."""
    out = None
    for bound, label in upper:
        test = value <= bound if closed else value < bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.when(value.isNotNull(), otherwise)


def gated(count: Column, least: int, value: Column) -> Column:
    """value where a group has at least that many rows, else NULL."""
    return F.when(count >= least, value)


def vehicle_from_id(vehicle_id: Column, mode: str = "car") -> Column:
    """The number inside ids such as "GR86-004-78": car takes the last token, chassis the middle one."""
    pattern = r"-(\d+)$" if mode == "car" else r"-(\d+)-"
    return F.regexp_extract(vehicle_id, pattern, 1).try_cast("int")
