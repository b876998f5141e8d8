"""Alerts on a driver's state, lap by lap: one rule, as batch windows and as a stateful stream.

Input: one row per (race, vehicle_number, lap) with brake_cv and coasting (NULL where they could not be
measured) and the driver's own baseline brake_mean, brake_std, coast_mean, coast_std. A value that is
missing is the vehicle's last one, before the first its baseline mean. z is 0 without a deviation.

Both over 2: one combined CRITICAL. Else each over 1: INFO, from 2 WARNING, from 3 CRITICAL. A brake alert is
rising if the last three laps' values grow strictly, by more than 30 % in all.

The stream keeps three numbers and two lists of at most two values per vehicle. Rows that come at or
behind a vehicle's last lap are late and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("race", "vehicle_number")
SEVERITY = {"INFO": 1, "WARNING": 2, "CRITICAL": 3}
_ALERT = "array<struct<kind:string,severity:string,z:double>>"
ALERTS = "race bigint, vehicle_number bigint, lap bigint, kind string, severity string, z double, rising boolean"
_STATE = "lap bigint, brake array<double>, coast array<double>"
RISE = 1.3


def _z(value: Column, mean: str, std: str) -> Column:
    return F.when(F.col(std) > 0, (value - F.col(mean)) / F.col(std)).otherwise(0.0)


def _severity(z: Column) -> Column:
    return F.when(z >= 3, "CRITICAL").when(z >= 2, "WARNING").otherwise("INFO")


def _one(kind: str, severity: Column, z: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), z.alias("z")))


def state_scores(laps: DataFrame) -> DataFrame:
    """laps with filled brake and coast values, their z and whether the brake value keeps rising."""
    w = Window.partitionBy(*KEYS).orderBy("lap")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = laps.withColumns(
        {
            "brake": F.coalesce(F.last("brake_cv", ignorenulls=True).over(so_far), "brake_mean"),
            "coast": F.coalesce(F.last("coasting", ignorenulls=True).over(so_far), "coast_mean"),
        }
    )
    one, two = F.lag("brake", 1).over(w), F.lag("brake", 2).over(w)
    rising = (F.col("brake") > one) & (one > two) & (F.col("brake") > two * RISE)
    return filled.withColumns(
        {
            "brake_z": _z(F.col("brake"), "brake_mean", "brake_std"),
            "coast_z": _z(F.col("coast"), "coast_mean", "coast_std"),
            "rising": F.coalesce(rising, F.lit(False)),
        }
    )


def state_alerts(laps: DataFrame) -> DataFrame:
    """race, vehicle_number, lap, kind, severity, z, rising: the batch form."""
    b, c = F.col("brake_z"), F.col("coast_z")
    none = F.array().cast(_ALERT)
    each = F.concat(
        F.when(b > 1, _one("brake", _severity(b), b)).otherwise(none), F.when(c > 1, _one("coasting", _severity(c), c)).otherwise(none)
    )
    alerts = F.when((b > 2) & (c > 2), _one("combined", F.lit("CRITICAL"), F.greatest(b, c))).otherwise(each)
    rows = state_scores(laps).select(*KEYS, "lap", "rising", F.explode(alerts).alias("a"))
    return rows.select(*KEYS, "lap", "a.kind", "a.severity", "a.z", (F.col("rising") & (F.col("a.kind") == "brake")).alias("rising"))


def health(laps: DataFrame) -> DataFrame:
    """race, vehicle_number, lap, health: the larger absolute z of each lap."""
    return state_scores(laps).select(*KEYS, "lap", F.greatest(F.abs("brake_z"), F.abs("coast_z")).alias("health"))


def field_alerts(alerts: DataFrame) -> DataFrame:
    """All alerts, the gravest first, then the latest."""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[F.col("severity")]
    return alerts.orderBy(rank.desc(), F.desc("lap"), "vehicle_number", "kind")


def _lap_alerts(brake: float, coast: float, row, past: list[float]) -> list[tuple[str, str, float, bool]]:
    b = (brake - row.brake_mean) / row.brake_std if row.brake_std > 0 else 0.0
    c = (coast - row.coast_mean) / row.coast_std if row.coast_std > 0 else 0.0
    if b > 2 and c > 2:
        return [("combined", "CRITICAL", max(b, c), False)]
    name = lambda z: "CRITICAL" if z >= 3 else "WARNING" if z >= 2 else "INFO"
    rising = len(past) == 2 and brake > past[1] > past[0] and brake > past[0] * RISE
    return [(kind, name(z), z, rising and kind == "brake") for kind, z in (("brake", b), ("coasting", c)) if z > 1]


def _advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    lap, past, coast = state.get if state.exists else (-1, [], [])
    past, coast = list(past), list(coast)
    out = []
    for row in pd.concat(list(batches)).sort_values("lap").itertuples():
        if row.lap <= lap:
            continue
        lap = int(row.lap)
        brake = row.brake_cv if pd.notna(row.brake_cv) else past[-1] if past else row.brake_mean
        now = row.coasting if pd.notna(row.coasting) else coast[-1] if coast else row.coast_mean
        out += [(*key, lap, *alert) for alert in _lap_alerts(brake, now, row, past)]
        past, coast = [*past, float(brake)][-2:], [float(now)]
    state.update((lap, past, coast))
    yield pd.DataFrame(out, columns=["race", "vehicle_number", "lap", "kind", "severity", "z", "rising"])


def stream_alerts(laps: DataFrame) -> DataFrame:
    """The same alerts from a stream of laps, append mode: each is given once, as its lap arrives."""
    return laps.groupBy(*KEYS).applyInPandasWithState(_advance, ALERTS, _STATE, "append", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all input there is, into Parquet files at path; a restart goes on where it stopped."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def replay_laps(spark, path: str, schema, files_per_batch: int | None = 1) -> DataFrame:
    """A stream over a folder of lap files, oldest first, some files a batch; None: all that are there in one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)
