"""Alerts held until somebody reads them, recent values and health of every driver: batch and stateful stream.

The rule of state_monitor decides which alerts there are. Here an alert is pending until a read of its vehicle
at its lap or a later one; that read gives it out and it is pending no longer. The stream also gives out
what nobody read for hold_seconds of event time (read_lap is NULL then).

State of the stream, by vehicle: a list of the newest laps (at least three, for the rising rule) and a list of pending alerts with
the time they fall due; one event-time timer per due time. The state store's reader shows both lists
between runs, so health and unread alerts of the whole field are a table, not a call to each vehicle.

Input rows are laps as in state_monitor, plus at (timestamp) and read (boolean). A row with read is a request and only
needs race, vehicle_number, lap and at. In one batch a request sees the lap of its own number. Laps at or
behind a vehicle's last one are dropped, and so are, as Spark does, rows behind the watermark.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lapforge.streaming import state_monitor as M

KEYS = M.KEYS
TREND_LAPS = 5
HOLD_SECONDS = 3600
GIVEN = M.ALERTS + ", read_lap bigint"
_HISTORY = "lap bigint, brake double, coast double, health double"
_PENDING = "lap bigint, kind string, severity string, z double, rising boolean, due bigint"
_AT = "__at_ms"
_Given = Row("race", "vehicle_number", "lap", "kind", "severity", "z", "rising", "read_lap")
_Lap = namedtuple("_Lap", ["brake_cv", "coasting", "brake_mean", "brake_std", "coast_mean", "coast_std"])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _status(health):
    return F.when(health >= 3, "critical").when(health >= 2, "warning").otherwise("good")


def trend(laps: DataFrame, n_laps: int = TREND_LAPS) -> DataFrame:
    """race, vehicle_number, lap, recent: brake and coast of the newest n_laps laps up to each lap, oldest first."""
    recent = Window.partitionBy(*KEYS).orderBy("lap").rowsBetween(1 - n_laps, Window.currentRow)
    return M.state_scores(laps).select(*KEYS, "lap", F.collect_list(F.struct("brake", "coast")).over(recent).alias("recent"))


def health_status(laps: DataFrame) -> DataFrame:
    """race, vehicle_number, lap, health, status of each vehicle's newest lap."""
    newest = M.health(laps).groupBy(*KEYS).agg(F.max_by(F.struct("lap", "health"), "lap").alias("s"))
    return newest.select(*KEYS, "s.lap", "s.health", _status(F.col("s.health")).alias("status"))


def drained_alerts(laps: DataFrame, reads: DataFrame) -> DataFrame:
    """Every alert with read_lap, the lap of the read that gives it out; NULL while it is pending.

    reads: race, vehicle_number, lap.
    """
    alerts = M.state_alerts(laps).withColumn("read", F.lit(False))
    rows = alerts.unionByName(reads.select(*KEYS, "lap", F.lit(True).alias("read")), allowMissingColumns=True)
    ahead = Window.partitionBy(*KEYS).orderBy("lap").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("read_lap", F.min(F.when(F.col("read"), F.col("lap"))).over(ahead)).filter("NOT read").drop("read")


class DriverMonitor(StatefulProcessor):
    """One vehicle's newest laps and pending alerts.

    A vehicle has a few rows a batch: they come as rows, since a frame a vehicle costs far more than its rows."""

    def __init__(self, hold_seconds: float = HOLD_SECONDS, n_laps: int = TREND_LAPS):
        self.hold_ms = int(hold_seconds * 1000)
        self.n_laps = max(3, n_laps)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", _HISTORY)
        self.pending = handle.getListState("pending", _PENDING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        history, pending, given = list(self.history.get()), list(self.pending.get()), []
        known = {a[5] for a in pending}
        numbered = (r for r in rows if r.lap is not None)
        for row in sorted(numbered, key=lambda r: (r.lap, bool(r.read))):
            if row.read:
                given += [(*key, *a[:5], row.lap) for a in pending if a[0] <= row.lap]
                pending = [a for a in pending if a[0] > row.lap]
            elif not history or row.lap > history[-1][0]:
                lap = _Lap(*(float("nan") if row[c] is None else row[c] for c in _Lap._fields))
                brake = lap.brake_cv if lap.brake_cv == lap.brake_cv else history[-1][1] if history else lap.brake_mean
                coast = lap.coasting if lap.coasting == lap.coasting else history[-1][2] if history else lap.coast_mean
                due = row[_AT] + self.hold_ms
                alerts = M._lap_alerts(brake, coast, lap, [h[1] for h in history[-2:]])
                pending += [(row.lap, kind, severity, float(z), bool(rising), due) for kind, severity, z, rising in alerts]
                z = [(v - m) / s if s > 0 else 0.0 for v, m, s in ((brake, lap.brake_mean, lap.brake_std), (coast, lap.coast_mean, lap.coast_std))]
                history = [*history, (row.lap, float(brake), float(coast), float(max(map(abs, z))))][-self.n_laps :]
        due = {a[5] for a in pending}
        for at in known - due:
            self.handle.deleteTimer(at)
        for at in due - known:
            self.handle.registerTimer(at)
        self._keep(self.history, history)
        self._keep(self.pending, pending)
        yield from (_Given(*g) for g in given)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        pending = list(self.pending.get())
        self._keep(self.pending, [a for a in pending if a[5] > at])
        yield from (_Given(*key, *a[:5], None) for a in pending if a[5] <= at)

    @staticmethod
    def _keep(state, values: list) -> None:
        if values:
            state.put([tuple(v) for v in values])
        else:
            state.clear()


def stream_drained(rows: DataFrame, hold_seconds: float = HOLD_SECONDS, late_seconds: int = 600, n_laps: int = TREND_LAPS) -> DataFrame:
    """Alerts as they are read, or fall due, from a stream of laps and reads."""
    timed = rows.withWatermark("at", f"{late_seconds} seconds").withColumn(_AT, F.unix_millis("at"))
    return timed.groupBy(*KEYS).transformWithState(DriverMonitor(hold_seconds, n_laps), GIVEN, "append", "EventTime")


@contextmanager
def state_lists(spark: SparkSession):
    """A monitor that starts in here keeps its lists in RocksDB; the earlier provider is set again afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_monitor(rows: DataFrame, path: str, checkpoint: str, **options) -> DataFrame:
    """stream_drained over all input there is, into Parquet files at path; a restart goes on where it stopped."""
    with state_lists(rows.sparkSession):
        return M.run_to_table(stream_drained(rows, **options), path, checkpoint)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).option("flattenCollectionTypes", "true")
    return reader.load().select(*[F.col(f"key.{k}").alias(k) for k in KEYS], "list_element.*")


def field_health(spark: SparkSession, checkpoint: str) -> DataFrame:
    """race, vehicle_number, lap, health, status of the field, out of the state of a monitor."""
    newest = _state(spark, checkpoint, "history").groupBy(*KEYS).agg(F.max_by(F.struct("lap", "health"), "lap").alias("s"))
    return newest.select(*KEYS, "s.lap", "s.health", _status(F.col("s.health")).alias("status"))


def pending_alerts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Alerts that a monitor holds because nobody has read them."""
    return _state(spark, checkpoint, "pending").drop("due")
