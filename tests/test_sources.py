"""Readers, sinks and small repairs on files: each case writes what it reads."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from lapforge.operators import repair
from lapforge.sources import preparation as prep
from lapforge.sources import readers, sinks
from lapforge.sources.zip_source import representative_sample, zipped


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def long_csv(n=200):
    rows = [f"{i % 7 + 1},{i % 3},speed,{i / 2},2025-01-01 10:00:{i % 60:02d}" for i in range(n)]
    return " lap,vehicle_number ,telemetry_name,telemetry_value,timestamp\n" + "\n".join(rows) + "\n"


@pytest.mark.parametrize("step", [50, 977, 1 << 20])
def test_zip_member_in_parts(spark, tmp_path, step):
    path = tmp_path / "race.zip"
    text = long_csv()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("inner/R1_Telemetry_data.csv", text)
        z.writestr("inner/readme.txt", "not this")
    table = zipped(spark, str(path), bytes_per_part=step)
    assert table.columns == ["lap", "vehicle_number", "telemetry_name", "telemetry_value", "timestamp"]
    assert table.rdd.getNumPartitions() >= max(1, len(text) // step)
    want = sorted(tuple(line.split(",")) for line in text.splitlines()[1:])
    assert sorted(tuple(r) for r in table.collect()) == want
    assert sorted(tuple(r) for r in zipped(spark, f"file://{path}", bytes_per_part=step).collect()) == want


def test_zip_odd_members(spark, tmp_path):
    path = tmp_path / "odd.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a_telemetry.csv", '﻿x;y\r\n1;"a;b"\r\n\r\n;2\r\n3')
        z.writestr("b_telemetry.csv", "y;x\nB;9")  # other order, no last line break
        z.writestr("c_telemetry.csv", "")
    got = zipped(spark, str(path), sep=";", bytes_per_part=7).collect()
    assert sorted(((r["x"], r["y"]) for r in got), key=str) == sorted([("1", "a;b"), (None, "2"), ("3", None), ("9", "B")], key=str)
    with pytest.raises(Exception, match="no member"):
        zipped(spark, str(path), member="*.parquet").collect()


def test_representative_sample(spark, tmp_path):
    path = tmp_path / "race.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("telemetry.csv", long_csv(420))
    rows = [representative_sample(spark, str(path), 4).collect() for _ in range(2)]
    assert sorted(map(tuple, rows[0])) == sorted(map(tuple, rows[1]))
    per = {}
    for r in rows[0]:
        per[r["lap"], r["vehicle_number"]] = per.get((r["lap"], r["vehicle_number"]), 0) + 1
    assert len(per) == 21 and set(per.values()) == {4}


LAPS = "lap,vehicle_number,vehicle_id,timestamp\n" + "".join(f"{lap},{v},GR86-00{v}-{v},2025-01-01T10:{lap * 2 + (lap * v) // 60:02d}:{lap * v % 60:02d}\n" for v in (4, 9) for lap in range(1, 8))


def test_prepare_races_sets_broken_ones_aside(spark, tmp_path):
    write(tmp_path / "vir/race1/vir_lap_time_R1.csv", LAPS)
    write(tmp_path / "vir/race1/weather.csv", "TIME_UTC_STR;AIR_TEMP;TRACK_TEMP\n1;20;30\n2;22;31\n")
    write(tmp_path / "vir/race1/23_AnalysisEndurance_race1.csv", "NUMBER; LAP_NUMBER;LAP_TIME;FLAG_AT_FL;TOP_SPEED\n4;3;2:00.5;FCY;150.5\n")
    write(tmp_path / "vir/race2/vir_lap_time_R2.csv", "lap,timestamp\n1,2025-01-01T10:00:00\n")
    write(tmp_path / "cota/race1/notes.txt", "none")
    write(tmp_path / "cota/race2/cota_lap_time.csv", "lap,vehicle_number,timestamp\n32768,4,2025-01-01T10:00:00\nx,y,z\n")
    tracks = [prep.Track("vir", "Virginia", total_laps={1: 6}), prep.Track("cota", "Austin"), prep.Track("sebring", "Sebring", races=(1,))]
    good, bad = prep.prepare_races(spark, str(tmp_path), tracks)
    assert {(r["track"], r["race_num"]): r["reason"] for r in bad.collect()} == {
        ("vir", 2): "columns missing: vehicle_number", ("cota", 1): "no lap-time file", ("cota", 2): "no usable lap", ("sebring", 1): "no folder race1",
    }
    rows = good.collect()
    assert {(r["race_id"], r["track_name"], r["total_laps"]) for r in rows} == {("vir_r1", "Virginia", 6)}
    assert max(r["lap"] for r in rows) == 6 and all(r["air_temp"] == 21 for r in rows)
    assert [(r["vehicle_number"], r["lap"], r["top_speed"]) for r in rows if r["is_under_yellow"]] == [(4, 3, 150.5)]
    none, all_bad = prep.prepare_races(spark, str(tmp_path / "nowhere"), tracks)
    assert none is None and all_bad.count() == 5


def test_prepare_races_keeps_kinds_apart(spark, tmp_path, monkeypatch):
    write(tmp_path / "t/race1/lap_time.csv", LAPS)
    write(tmp_path / "t/race2/lap_time.csv", LAPS)
    plain = prep.race_features
    seen = []

    def second_as_text(rows, total):
        seen.append(1)
        out = plain(rows, total)
        return out.withColumn("position", F.col("position").cast("string")) if len(seen) == 2 else out

    monkeypatch.setattr(prep, "race_features", second_as_text)
    good, bad = prep.prepare_races(spark, str(tmp_path), [prep.Track("t", "T")])
    assert good.select("race_num").distinct().count() == 1 and bad.first()["reason"] == "position is string, not bigint"


def test_signals(spark, tmp_path):
    assert readers.signals(spark, write(tmp_path / "long.csv", long_csv())) == ["speed"]
    payload = '"[{""name"": ""speed"", ""value"": 1.5}, {""name"": ""ath"", ""value"": 2}]"'
    assert readers.signals(spark, write(tmp_path / "json.csv", f"lap,value\n1,{payload}\n2,broken\n")) == ["ath", "speed"]
    assert readers.signals(spark, write(tmp_path / "bad.csv", "lap,value\n1,oops\n")) == []
    assert readers.signals(spark, write(tmp_path / "other.csv", "a,b\n1,2\n")) == []


def test_sectors_take_the_first_row(spark, tmp_path):
    path = write(tmp_path / "s.csv", "NUMBER; LAP_NUMBER;S1_SECONDS;S2_SECONDS\n7;1;30.5;41\n7;1;99;99\n7;2;31;x\nbad;1;1;1\n")
    got = {(r["vehicle_number"], r["lap"]): (r["s1"], r["s2"]) for r in readers.sectors(spark, path).collect()}
    assert got == {(7, 1): (30.5, 41.0), (7, 2): (31.0, None)}


def test_best_laps(spark, tmp_path):
    path = write(tmp_path / "b.csv", "NUMBER;BESTLAP_1\n 7;1:40.123\n8;99.5\n9;none\nx;1:00\n")
    assert sorted(map(tuple, readers.best_laps(spark, path).collect())) == [(7, pytest.approx(100.123)), (8, 99.5)]


def test_audit_sample_finds_the_separator(spark, tmp_path):
    comma, semicolon = write(tmp_path / "c.csv", "a,b\n1,2\n3,4\n"), write(tmp_path / "d.csv", "a;b\n1;2\n")
    assert readers.audit_sample(spark, comma, 1).collect()[0].asDict() == {"a": "1", "b": "2"}
    assert readers.audit_sample(spark, semicolon).columns == ["a", "b"]


def test_csv_sink_and_coefficients(spark, tmp_path):
    rows = spark.createDataFrame([("vir", 1, 2.5), ("cota", 2, 3.5)], "track string, race int, x double")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(p.name for p in (tmp_path / "csv").glob("track=*")) == ["track=cota", "track=vir"]
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv"))
    assert sorted((r["track"], r["race"], r["x"]) for r in back.collect()) == [("cota", 2, 3.5), ("vir", 1, 2.5)]
    sinks.save_model(rows, str(tmp_path / "fit"))
    assert sorted(map(tuple, sinks.load_coefficients(spark, str(tmp_path / "fit")).collect())) == sorted(map(tuple, rows.collect()))


def test_signal_names_and_throttle(spark):
    one = lambda names: spark.createDataFrame([tuple(range(len(names)))], list(names))
    gps = repair.normalise_signals(one(["VBOX_Lat_Min", "VBOX_Long_Minutes", "Laptrigger_lapdist_dls", "ath", "aps"]))
    assert gps.columns == ["latitude", "longitude", "lap_distance", "throttle", "throttle_pedal"]
    assert repair.normalise_signals(one(["aps"])).columns == ["throttle"] and repair.normalise_signals(one(["x"])).columns == ["x"]
    assert [repair.throttle_column(one(c)) for c in (["ath", "throttle"], ["aps"], ["aps", "ath"], ["x"])] == ["throttle", "aps", "ath", None]


def test_track_constants(spark):
    rows = spark.createDataFrame([("vir", 100.0), ("vir", 110.0), ("cota", 90.0), ("new", 1.0)], "track string, lap_time double")
    got = sorted((r["track"], r["track_length_km"], r["expected_lap_time"], r["lap_time_z"]) for r in repair.with_track_constants(rows, {"vir": 5.0, "cota": 4.0}).collect())
    assert got[0] == ("cota", 4.0, 100.0, None) and got[1] == ("new", None, None, None)
    assert [g[3] for g in got[2:]] == pytest.approx([-(0.5**0.5), 0.5**0.5]) and got[2][2] == 125.0
