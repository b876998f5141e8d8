"""Alerts that are held until read: batch, stream, timers, restarts and the state's reader."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lapforge.streaming import field_monitor, state_monitor

LAPS = "race long, vehicle_number long, lap long, brake_cv double, coasting double, brake_mean double, brake_std double, coast_mean double, coast_std double"
START = datetime(2024, 5, 1, 12)
Z = [(2.5, 1.2), (2.1, 2.2), (0.9, 0.9), (None, 3.5), (1.5, 0.0), (4.0, 0.0), (0.0, -2.4)]


def laps(spark):
    rows = [(0, v, n, None if b is None else 10 + b, 10 + c, 10.0, 1.0, 10.0, 1.0) for v in (1, 2) for n, (b, c) in enumerate(Z, 1)]
    return spark.createDataFrame(rows, LAPS)


def timed(spark, df, reads):
    """laps and reads, a minute a lap."""
    rows = [(*r, START + timedelta(minutes=r["lap"]), False) for r in df.collect()]
    rows += [(0, v, n, *[None] * 6, START + timedelta(minutes=n), True) for v, n in reads]
    return spark.createDataFrame(rows, LAPS + ", at timestamp, read boolean")


def alerts(df):
    return sorted(tuple(r) for r in df.select("vehicle_number", "lap", "kind", "severity", "rising", "read_lap").collect())


def test_drain_in_batch(spark):
    reads = spark.createDataFrame([(0, 1, 2), (0, 1, 4), (0, 1, 4)], "race long, vehicle_number long, lap long")
    got = {(r["vehicle_number"], r["lap"]): r["read_lap"] for r in field_monitor.drained_alerts(laps(spark), reads).collect()}
    assert got == {(1, 1): 2, (1, 2): 2, (1, 4): 4, (1, 5): None, (1, 6): None, **{(2, n): None for n in (1, 2, 4, 5, 6)}}


def test_trend_and_health(spark):
    rows = {(r["vehicle_number"], r["lap"]): [tuple(v) for v in r["recent"]] for r in field_monitor.trend(laps(spark), 3).collect()}
    assert rows[1, 1] == [(12.5, 11.2)]
    assert rows[2, 4] == [(12.1, 12.2), (10.9, 10.9), (10.9, 13.5)]
    status = {r["vehicle_number"]: (r["lap"], r["status"]) for r in field_monitor.health_status(laps(spark)).collect()}
    assert status == {1: (7, "warning"), 2: (7, "warning")}
    assert field_monitor.health_status(laps(spark).limit(0)).count() == 0


@pytest.mark.parametrize("n_files", [1, 3])
def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path, n_files):
    df = laps(spark)
    asked = [(1, 2), (1, 4), (2, 6), (2, 6)]
    every = timed(spark, df, asked)
    cut = [0, 3, 5, 9] if n_files == 3 else [0, 9]
    for low, high in zip(cut[:-1], cut[1:], strict=True):  # each part is a run of its own over the same checkpoint
        every.filter(f"lap > {low} AND lap <= {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        stream = state_monitor.replay_laps(spark, f"{tmp_path}/rows", every.schema)
        out = field_monitor.run_monitor(stream, f"{tmp_path}/alerts", f"{tmp_path}/progress", hold_seconds=86400)
    reads = spark.createDataFrame([(0, *a) for a in asked], "race long, vehicle_number long, lap long")
    batch = field_monitor.drained_alerts(df, reads)
    assert alerts(out) == alerts(batch.filter("read_lap IS NOT NULL"))
    held = field_monitor.pending_alerts(spark, f"{tmp_path}/progress")
    assert sorted(held.select("vehicle_number", "lap", "kind").collect()) == sorted(batch.filter("read_lap IS NULL").select("vehicle_number", "lap", "kind").collect())
    keys = ["race", "vehicle_number", "lap", "health", "status"]
    assert sorted(field_monitor.field_health(spark, f"{tmp_path}/progress").select(keys).collect()) == sorted(field_monitor.health_status(df).select(keys).collect())


def test_timer_gives_out_what_nobody_reads(spark, tmp_path):
    every = timed(spark, laps(spark), [(1, 2)])
    every.coalesce(1).write.parquet(f"{tmp_path}/rows")
    stream = state_monitor.replay_laps(spark, f"{tmp_path}/rows", every.schema)
    # the watermark ends at minute 7: alerts up to minute 4 are due by then
    out = field_monitor.run_monitor(stream, f"{tmp_path}/alerts", f"{tmp_path}/progress", hold_seconds=180, late_seconds=0)
    got = sorted((r["vehicle_number"], r["lap"], r["read_lap"] or 0) for r in out.collect())
    assert got == [(1, 1, 2), (1, 1, 2), (1, 2, 2), (1, 4, 0), (2, 1, 0), (2, 1, 0), (2, 2, 0), (2, 4, 0)]
    held = field_monitor.pending_alerts(spark, f"{tmp_path}/progress").select("vehicle_number", "lap").distinct()
    assert sorted(tuple(r) for r in held.collect()) == [(1, 5), (1, 6), (2, 5), (2, 6)]


def test_replay_is_one_batch_however_many_files(spark, monkeypatch):
    """Files hold vehicles, not times: behind a limit of files a batch the watermark would make early laps of the rest late."""
    from lapforge.plans import stream_queries

    replay, asked = state_monitor.replay_laps, []

    def few_files(s, path, schema, files_per_batch=1):
        asked.append(files_per_batch)
        return replay(s, path, schema, files_per_batch and 1)  # a limit, if there is one, is met

    monkeypatch.setattr(stream_queries.M, "replay_laps", few_files)
    some = stream_queries.lap_states(spark, "/root/testdata/sf0.001").repartition(7, "vehicle_number").persist()
    monkeypatch.setattr(stream_queries, "lap_states", lambda s, d: some)
    got = stream_queries.streamed_drained(spark, "").collect()
    assert asked == [None]
    assert sorted(map(str, got)) == sorted(map(str, stream_queries.drained(spark, "").collect())) and got
    some.unpersist()


def test_monitor_takes_missing_values_and_laps(spark, tmp_path):
    """Rows without a lap are passed over; without a deviation there is no alert."""
    some = timed(spark, laps(spark), [(1, 6)])
    odd = some.withColumn("lap", F.when(~((F.col("vehicle_number") == 2) & (F.col("lap") > 3)), F.col("lap"))).withColumn("brake_std", F.when(F.col("vehicle_number") == 1, F.col("brake_std")))
    odd.coalesce(1).write.parquet(f"{tmp_path}/rows")
    out = field_monitor.run_monitor(state_monitor.replay_laps(spark, f"{tmp_path}/rows", odd.schema), f"{tmp_path}/alerts", f"{tmp_path}/progress", hold_seconds=86400)
    assert {r["read_lap"] for r in out.collect()} == {6}
    status = {r["vehicle_number"]: r["lap"] for r in field_monitor.field_health(spark, f"{tmp_path}/progress").collect()}
    assert status[2] == 3
    assert field_monitor.pending_alerts(spark, f"{tmp_path}/progress").filter("vehicle_number = 2 AND kind = 'brake'").count() == 0
