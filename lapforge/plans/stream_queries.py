"""Queries of state alerts, batch and streamed, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lapforge.plans.adapter import TELEMETRY_SQL, telemetry
from lapforge.sources.session import shared_dir
from lapforge.streaming import field_monitor
from lapforge.streaming import state_monitor as M

SKIPPED = 4  # every so many laps one measure is missing
READ_EVERY = 6  # laps between two reads of a vehicle's alerts


def lap_states(s, d):
    """Ten samples a lap: brake_cv and coasting; the baseline is the vehicle's first three laps."""
    per_lap = telemetry(s, d).groupBy("race", "vehicle_number", "lap").agg(
        (100 * F.stddev_pop("brake") / F.nullif(F.avg("brake"), F.lit(0.0))).alias("cv"), (100.0 * F.count_if(F.expr("throttle < 60 and brake < 50")) / F.count(F.lit(1))).alias("coasting")
    )
    base = per_lap.filter("lap <= 3").groupBy("race", "vehicle_number").agg(
        F.avg("cv").alias("brake_mean"), F.stddev_samp("cv").alias("brake_std"), F.avg("coasting").alias("coast_mean"), F.stddev_samp("coasting").alias("coast_std")
    )
    measured = F.when(F.col("lap") % SKIPPED != 0, F.col("cv"))
    rows = per_lap.join(base, ["race", "vehicle_number"])
    return rows.select("race", "vehicle_number", "lap", measured.alias("brake_cv"), "coasting", "brake_mean", "brake_std", "coast_mean", "coast_std")


def _rounded(alerts):
    return alerts.select("race", "vehicle_number", "lap", "kind", "severity", F.round(F.col("z") + 1.7e-10, 6).alias("z"), "rising")


def alerts(s, d):
    return _rounded(M.state_alerts(lap_states(s, d)))


def health(s, d):
    return M.health(lap_states(s, d)).select("race", "vehicle_number", "lap", F.round(F.col("health") + 1.7e-10, 6).alias("health"))


def streamed(s, d):
    """The laps written as files, then replayed through the stateful stream."""
    at = f"{shared_dir(s)}/lapforge-stream-{uuid.uuid4().hex}"
    rows = lap_states(s, d)
    rows.write.parquet(f"{at}/laps")
    stream = M.stream_alerts(M.replay_laps(s, f"{at}/laps", rows.schema, files_per_batch=1000))
    return _rounded(M.run_to_table(stream, f"{at}/alerts", f"{at}/progress"))


def trend(s, d):
    """The newest values of each lap, one row a value."""
    rows = field_monitor.trend(lap_states(s, d)).select("race", "vehicle_number", "lap", F.posexplode("recent").alias("place", "v"))
    return rows.select("race", "vehicle_number", "lap", F.col("place").cast("bigint").alias("place"), F.round(F.col("v.brake") + 1.7e-10, 6).alias("brake"), F.round(F.col("v.coast") + 1.7e-10, 6).alias("coast"))


def _reads(laps):
    """Every vehicle's alerts are read after every sixth lap it drives."""
    return laps.filter(F.col("lap") % READ_EVERY == 0).select("race", "vehicle_number", "lap")


def _drained(alerts):
    return alerts.select("race", "vehicle_number", "lap", "kind", "severity", F.round(F.col("z") + 1.7e-10, 6).alias("z"), "rising", "read_lap")


def drained(s, d):
    rows = lap_states(s, d)
    return _drained(field_monitor.drained_alerts(rows, _reads(rows)))


def _timed(rows):
    """Laps and, of every sixth one, its read, a minute a lap: one pass over rows."""
    twice = F.when(F.col("lap") % READ_EVERY == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    timed = rows.withColumn("read", F.explode(twice))
    measures = {c: F.when(~F.col("read"), F.col(c)) for c in rows.columns if c not in ("race", "vehicle_number", "lap")}
    return timed.withColumns(measures | {"at": F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("lap"))})


def _monitored(s, d):
    """Laps and reads written as files and replayed: alerts given out, and the monitor's checkpoint.

    Files hold vehicles, not times. So all of them are one batch: in a later one the watermark of the first would make
    the early laps of its vehicles late.
    """
    at = f"{shared_dir(s)}/lapforge-stream-{uuid.uuid4().hex}"
    timed = _timed(lap_states(s, d))
    timed.write.parquet(f"{at}/laps")
    stream = M.replay_laps(s, f"{at}/laps", timed.schema, files_per_batch=None)
    given = field_monitor.run_monitor(stream, f"{at}/alerts", f"{at}/progress", hold_seconds=30 * 86400)
    return given, f"{at}/progress"


def streamed_drained(s, d):
    """What reads gave out, and what the monitor still holds."""
    given, progress = _monitored(s, d)
    return _drained(given.unionByName(field_monitor.pending_alerts(s, progress), allowMissingColumns=True))


def _status(rows):
    return rows.select("race", "vehicle_number", "lap", F.round(F.col("health") + 1.7e-10, 6).alias("health"), "status")


def health_status(s, d):
    return _status(field_monitor.health_status(lap_states(s, d)))


def streamed_health(s, d):
    """Health of the field, read from the state store of a monitor."""
    return _status(field_monitor.field_health(s, _monitored(s, d)[1]))


SCORES_SQL = f"""{TELEMETRY_SQL},
per_lap AS (SELECT race, vehicle_number, lap, 100 * stddev_pop(brake) / nullif(avg(brake), 0) AS cv, 100.0 * count(*) FILTER (throttle < 60 AND brake < 50) / count(*) AS coasting
  FROM telemetry GROUP BY race, vehicle_number, lap),
base AS (SELECT race, vehicle_number, avg(cv) AS bm, stddev_samp(cv) AS bs, avg(coasting) AS cm, stddev_samp(coasting) AS cs FROM per_lap WHERE lap <= 3 GROUP BY race, vehicle_number),
filled AS (SELECT race, vehicle_number, lap, bm, bs, cm, cs, coalesce(last_value(CASE WHEN lap % {SKIPPED} <> 0 THEN cv END IGNORE NULLS) OVER (PARTITION BY race, vehicle_number ORDER BY lap), bm) AS brake,
  coasting AS coast FROM per_lap JOIN base USING (race, vehicle_number)),
scores AS (SELECT race, vehicle_number, lap, CASE WHEN bs > 0 THEN (brake - bm) / bs ELSE 0 END AS b, CASE WHEN cs > 0 THEN (coast - cm) / cs ELSE 0 END AS c,
  coalesce(brake > lag(brake) OVER w AND lag(brake) OVER w > lag(brake, 2) OVER w AND brake > lag(brake, 2) OVER w * 1.3, false) AS rising
  FROM filled WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY lap))"""
_BAND = "CASE WHEN {z} >= 3 THEN 'CRITICAL' WHEN {z} >= 2 THEN 'WARNING' ELSE 'INFO' END"
ALERTS_SQL = f"""WITH {SCORES_SQL}, a AS (
SELECT race, vehicle_number, lap, 'combined' AS kind, 'CRITICAL' AS severity, greatest(b, c) AS z, false AS rising FROM scores WHERE b > 2 AND c > 2
UNION ALL SELECT race, vehicle_number, lap, 'brake', {_BAND.format(z="b")}, b, rising FROM scores WHERE b > 1 AND NOT (b > 2 AND c > 2)
UNION ALL SELECT race, vehicle_number, lap, 'coasting', {_BAND.format(z="c")}, c, false FROM scores WHERE c > 1 AND NOT (b > 2 AND c > 2))
SELECT race, vehicle_number, lap, kind, severity, round(z + 1.7e-10, 6) AS z, rising FROM a"""
DRAINED_SQL = f"""WITH alerts AS ({ALERTS_SQL}),
reads AS (WITH {SCORES_SQL} SELECT race, vehicle_number, lap AS read_lap FROM scores WHERE lap % {READ_EVERY} = 0)
SELECT a.race, a.vehicle_number, a.lap, kind, severity, z, rising, min(read_lap) AS read_lap
FROM (SELECT *, row_number() OVER () AS k FROM alerts) a LEFT JOIN reads r ON r.race = a.race AND r.vehicle_number = a.vehicle_number AND r.read_lap >= a.lap
GROUP BY k, a.race, a.vehicle_number, a.lap, kind, severity, z, rising"""
STATUS_SQL = f"""WITH {SCORES_SQL}, newest AS (SELECT race, vehicle_number, lap, greatest(abs(b), abs(c)) AS health FROM scores
  QUALIFY row_number() OVER (PARTITION BY race, vehicle_number ORDER BY lap DESC) = 1)
SELECT race, vehicle_number, lap, round(health + 1.7e-10, 6) AS health, CASE WHEN health >= 3 THEN 'critical' WHEN health >= 2 THEN 'warning' ELSE 'good' END AS status FROM newest"""
TREND_SQL = f"""WITH {SCORES_SQL}, numbered AS (SELECT race, vehicle_number, lap, brake, coast, row_number() OVER (PARTITION BY race, vehicle_number ORDER BY lap) AS n FROM filled)
SELECT l.race, l.vehicle_number, l.lap, v.n - greatest(l.n - 4, 1) AS place, round(v.brake + 1.7e-10, 6) AS brake, round(v.coast + 1.7e-10, 6) AS coast
FROM numbered l JOIN numbered v ON v.race = l.race AND v.vehicle_number = l.vehicle_number AND v.n BETWEEN l.n - 4 AND l.n"""

QUERIES = {
    "state_alerts": (alerts, ALERTS_SQL),
    "stream_state_alerts": (streamed, ALERTS_SQL),
    "state_health": (health, f"WITH {SCORES_SQL} SELECT race, vehicle_number, lap, round(greatest(abs(b), abs(c)) + 1.7e-10, 6) AS health FROM scores"),
    "state_trend": (trend, TREND_SQL),
    "drained_alerts": (drained, DRAINED_SQL),
    "stream_drained_alerts": (streamed_drained, DRAINED_SQL),
    "state_health_status": (health_status, STATUS_SQL),
    "stream_field_health": (streamed_health, STATUS_SQL),
}
