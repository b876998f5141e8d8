"""What only shows on tables larger than the smallest: longer ids, ties, tasks that hold too much."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lapforge.functions.scalars import padded
from lapforge.operators import spatial as G
from lapforge.plans import adapter, repair_queries, spatial_queries, walk_queries

DATA = "/root/testdata/sf0.001"


def test_ids_of_more_than_three_digits_stay_whole(spark, tmp_path):
    text = spark.createDataFrame([(0,), (7,), (999,), (1000,), (12345,)], "v bigint").select(padded(F.col("v"), 3).alias("t"))
    assert [r.t for r in text.collect()] == ["000", "007", "999", "1000", "12345"]

    rows = [(5, "2024-01-01 00:00:00", 7), (6, "2024-01-01 00:00:01", 1234), (8, "2024-01-01 00:00:02", 98765)]
    table = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint")
    table.select("event_id", F.to_timestamp("ts").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.vehicle_number, r.chassis, r.last_token) for r in repair_queries.vehicle_repair(spark, str(tmp_path)).collect()}
    assert got == {5: (5, 7, 5), 6: (6, 1234, 6), 8: (98765, 98765, 0)}


def test_parts_follow_the_number_of_rows(spark, monkeypatch):
    """A fixed number of parts lets every task hold more of a larger table."""
    rows = adapter.events(spark, DATA).count()
    monkeypatch.setattr(adapter, "ROWS_PER_TASK", rows // 9, raising=False)
    for table in (adapter.laps(spark, DATA), adapter.telemetry(spark, DATA)):
        assert table.rdd.getNumPartitions() >= 9
        assert table.count() == rows
    # the whole walk stays on that one deal
    assert walk_queries.baseline_walk(spark, DATA).rdd.getNumPartitions() >= 9
    assert walk_queries.relative_walk(spark, DATA).rdd.getNumPartitions() >= 9


def test_corners_of_a_race_are_found_in_the_tasks_of_its_rows(spark, monkeypatch):
    """The few candidates are not dealt anew, which adaptive execution does into one task."""
    rows = adapter.events(spark, DATA).count()
    monkeypatch.setattr(adapter, "ROWS_PER_TASK", rows // 9)
    for table in (spatial_queries.speed_corners(spark, DATA), spatial_queries.corner_sweep(spark, DATA)):
        assert table.rdd.getNumPartitions() >= 9


def test_points_at_one_place_count_as_many(spark):
    """Clusters of places with counts are those of all points, looked at one by one."""
    rng = np.random.default_rng(11)
    for n, cells, eps, least in ((200, 6, 1.0, 9), (120, 12, 1.0, 3), (60, 30, 1.5, 2), (1, 3, 1.0, 1)):
        xy = rng.integers(0, cells, (n, 2)).astype(float)
        near = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= eps
        core, want, number = near.sum(1) >= least, np.full(n, -1), 0
        for i in range(n):
            if core[i] and want[i] < 0:
                reach = np.zeros(n, bool)
                reach[i] = True
                while (more := core & near[reach].any(0) & ~reach).any():
                    reach |= more
                want[reach] = number
                number += 1
        got = G.density_labels(xy, eps, least)
        assert got[core].tolist() == want[core].tolist()
        for i in np.flatnonzero(~core):
            mine = np.flatnonzero(near[i] & core)
            d = np.hypot(*(xy[mine] - xy[i]).T)
            assert got[i] in (set(want[mine[d == d.min()]]) if len(mine) else {-1})


def test_walk_queries_stay_on_their_deal(spark, monkeypatch):
    """The registered queries, errors included: a shuffle behind the windows would gather their rows in parts that the session fixes."""
    monkeypatch.setattr(adapter, "ROWS_PER_TASK", adapter.events(spark, DATA).count() // 9, raising=False)
    for name in ("expanding_relative_model", "expanding_baseline_model"):
        assert walk_queries.QUERIES[name][0](spark, DATA).rdd.getNumPartitions() >= 9
