"""Hand-made cases: readers and sinks, repair, positions, spatial kernels, streamed alerts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.functions.scalars import clock_seconds
from lapforge.operators import race, repair, spatial
from lapforge.sources import readers, sinks
from lapforge.streaming import state_monitor


def test_clock_strings(spark):
    df = spark.createDataFrame([("1:40.123",), ("100.5",), ("",), ("x",)], "t string")
    assert [r[0] for r in df.select(clock_seconds(F.col("t"))).collect()] == [pytest.approx(100.123), 100.5, None, None]


def test_lap_times_file(spark, tmp_path):
    lines = ["lap, vehicle_number,vehicle_id,timestamp"]
    ends = {1: "10:00:00", 2: "10:01:40", 4: "10:04:00"}
    lines += [f"{lap},7,GR86-004-7,2024-01-01 {t}" for lap, t in ends.items()]
    lines += ["2,7,GR86-004-7,2024-01-01 10:01:30", "32768,7,GR86-004-7,2024-01-01 10:02:00", "1,8,GR86-005-8,2024-01-01 10:00:00"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    got = {(r["vehicle_number"], r["lap"]): r["lap_time"] for r in readers.lap_times(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {(7, 2): 100.0, (7, 4): 140.0}


def test_telemetry_file(spark, tmp_path):
    lines = ["lap,vehicle_number,vehicle_id,telemetry_name,telemetry_value,timestamp"]
    for lap in (1, 2):
        for name, v in (("speed", 10.0 * lap), ("VBOX_Lat_Min", 1.5), ("VBOX_Long_Minutes", 2.5)):
            lines.append(f"{lap},7,GR86-004-7,{name},{v},2024-01-01 10:0{lap}:00")
    path = str(tmp_path / "telemetry.csv")
    (tmp_path / "telemetry.csv").write_text("\n".join(lines))
    assert [r["speed"] for r in readers.gps(spark, path, lap=[2]).collect()] == [20.0]
    assert readers.telemetry(spark, path, parameters=["speed"]).count() == 2
    assert readers.signals(spark, path) == ["VBOX_Lat_Min", "VBOX_Long_Minutes", "speed"]
    assert readers.race_folder(spark, str(tmp_path), ["speed"], laps=1).collect()[0]["speed"] == 10.0
    assert readers.find_file(spark, str(tmp_path), "*lap*.csv", "TELEMETRY*.csv").endswith("telemetry.csv")


def test_endurance_and_weather_files(spark, tmp_path):
    (tmp_path / "x_AnalysisEndurance.CSV").write_text("NUMBER; LAP_NUMBER; LAP_TIME;S1_SECONDS; FLAG_AT_FL\n7;1;1:40.5;30.0;GF\n7;2;x;31.0;FCY\nbad;3;;;\n")
    got = readers.endurance(spark, str(tmp_path / "x_AnalysisEndurance.CSV")).orderBy("lap").collect()
    assert [(r["lap"], r["lap_time"], r["is_under_yellow"]) for r in got] == [(1, 100.5, 0), (2, None, 1)]
    assert readers.lap_times_folder(spark, str(tmp_path)).count() == 2
    (tmp_path / "w.csv").write_text("TIME_UTC_STR;AIR_TEMP;HUMIDITY\na;20;x\nb;22;50\n")
    assert readers.weather_summary(spark, str(tmp_path / "w.csv")).first()["air_temp"] == 21.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", 1, 7, 1), ("t", 1, 8, 2), ("u", 2, 7, 1)], "track string, race int, vehicle_number int, lap int")
    sinks.write_parquet(df, f"file://{tmp_path}/p")
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 3
    sinks.write_manifest(df, f"file://{tmp_path}/m")
    entry = sinks.read_manifest(spark, f"file://{tmp_path}/m")["t"]["1"]
    assert (entry["total_laps"], entry["num_drivers"], entry["num_samples"]) == (2, 2, 2)


def test_as_of_laps_are_strict(spark):
    samples = spark.createDataFrame([(1, t) for t in (5, 10, 11, 20, 21)], "v int, ts_us long").withColumn("lap", F.lit(0))
    starts = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "v int, ts_us long, lap long")
    got = repair.asof_laps(samples, starts, ["v"]).orderBy("ts_us").collect()
    assert [r["lap"] for r in got] == [0, 0, 1, 1, 2]


def test_json_signals_skip_broken_rows(spark):
    df = spark.createDataFrame([('[{"name":"a","value":1.0},{"name":"b","value":2.0}]',), ("{broken",)], "value string")
    assert repair.explode_json_signals(df).count() == 2


def test_retired_car_ranks_behind_on_every_lap(spark):
    rows = [(0, v, lap, lap * 100 + v * d) for v, laps, d in ((1, 3, 2), (2, 3, 3), (3, 2, -9)) for lap in range(1, laps + 1)]
    df = spark.createDataFrame(rows, "race int, vehicle_number int, lap int, ts_us long")
    got = {(r["lap"], r["vehicle_number"]): r["position"] for r in race.race_position(df).collect()}
    assert [got[(1, v)] for v in (1, 2, 3)] == [1, 2, 3]


def test_peaks():
    x = np.array([0, 2, 2, 2, 0, 5, 1, 4, 0, 0, 3.0])
    assert spatial.local_maxima(x).tolist() == [2, 5, 7]
    assert spatial.peaks(x, height=3).tolist() == [5, 7]
    assert spatial.peaks(x, distance=3).tolist() == [2, 5]
    assert spatial.peaks(x, prominence=4).tolist() == [5]


def test_density_labels():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 0.01, (30, 2)), rng.normal(1, 0.01, (20, 2))
    label = spatial.density_labels(np.vstack([a, b, [[5, 5]]]), 0.1, 4)
    assert len(set(label[:30])) == 1 and len(set(label[30:50])) == 1 and label[0] != label[30] and label[50] == -1
    assert spatial.density_labels(np.zeros((0, 2)), 1.0, 2).tolist() == []


def test_corners_of_a_made_up_track(spark):
    rows = []
    for lap in range(1, 5):
        for i in range(200):
            p = i / 200
            dip = max(60 * np.exp(-(((p - c) / 0.03) ** 2)) for c in (0.15, 0.35, 0.65, 0.85))
            rows.append((0, 55, lap, i, float(np.cos(2 * np.pi * p)) / 100, float(np.sin(2 * np.pi * p)) / 100, float(130 - dip)))
    df = spark.createDataFrame(rows, "race int, vehicle_number int, lap int, ts_us long, latitude double, longitude double, speed double")
    found = spatial.corners(df).collect()
    assert len(found) == 4 and {r["n_observations"] for r in found} == {4} and {r["corner_type"] for r in found} == {"medium"}


LAPS = "race long, vehicle_number long, lap long, brake_cv double, coasting double, brake_mean double, brake_std double, coast_mean double, coast_std double"


def test_alerts_in_batch_and_stream(spark, tmp_path):
    z = [(2.5, 1.2), (2.1, 2.2), (0.9, 0.9), (None, 3.5), (1.5, 0.0), (4.0, 0.0)]
    rows = [(0, v, lap, None if b is None else 10 + b, 10 + c, 10.0, 1.0, 10.0, 1.0) for v in (1, 2) for lap, (b, c) in enumerate(z, 1)]
    df = spark.createDataFrame(rows, LAPS)
    batch = sorted(state_monitor.state_alerts(df).collect())
    one = [(r["lap"], r["kind"], r["severity"]) for r in batch if r["vehicle_number"] == 1]
    assert one == [(1, "brake", "WARNING"), (1, "coasting", "INFO"), (2, "combined", "CRITICAL"), (4, "coasting", "CRITICAL"), (5, "brake", "INFO"), (6, "brake", "CRITICAL")]
    for k, half in enumerate((df.filter("lap <= 3"), df.filter("lap > 3"))):
        half.coalesce(1).write.mode("append").parquet(f"{tmp_path}/laps")
        stream = state_monitor.stream_alerts(state_monitor.replay_laps(spark, f"{tmp_path}/laps", df.schema))
        out = state_monitor.run_to_table(stream, f"{tmp_path}/alerts", f"{tmp_path}/progress")
    assert sorted(out.collect()) == batch
    assert state_monitor.field_alerts(out).first()["severity"] == "CRITICAL"


def test_llm_operators_are_optional():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    import lapforge

    root = Path(lapforge.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lapforge.llm" not in path.read_text(), path


@pytest.mark.parametrize("rows", [0])
def test_empty_input(spark, rows):
    df = spark.createDataFrame([], LAPS)
    assert state_monitor.state_alerts(df).count() == rows
    points = spark.createDataFrame([], "race long, point_id long, latitude double, longitude double")
    assert spatial.close_pairs(points, 10.0).count() == rows
