"""Exact quantiles and global ranks against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from lapforge.operators import selection


@pytest.fixture
def small_ranges(monkeypatch):
    """Few buckets and small leaves, so that ranges are narrowed several times."""
    monkeypatch.setattr(selection, "BUCKETS", 4)
    monkeypatch.setattr(selection, "LEAF", 3)


def values_of(seed):
    rng = np.random.default_rng(seed)
    return {
        "even": rng.uniform(-5, 5, 400),
        "tied": np.repeat([1.0, 1.0, 1.0, 2.0, 7.5], 60),
        "steep": 10.0 ** rng.uniform(-200, 200, 150),
        "wide": np.array([-1.7e308, 1.7e308, 0.0, 5.0, -3.0]),
        "one": np.array([4.25]),
        "pair": np.array([-0.0, 3.0]),
        "ends": np.array([-np.inf, 1.0, 2.0, 3.0, 4.0, 5.0, np.inf]),
    }


def check(spark, seed):
    shares = [0.0, 0.01, 0.05, 0.5, 0.95, 1.0]
    values = values_of(seed)
    rows = [(s, float(x)) for s, some in values.items() for x in some] + [("even", None), ("even", float("nan")), ("empty", None)]
    np.random.default_rng(0).shuffle(rows)
    table = spark.createDataFrame([(s, None if x is None else float(x)) for s, x in rows], "signal string, x double").repartition(5)
    got = {(r["signal"], r["share"]): r["quantile"] for r in selection.exact_quantiles(table, "signal", "x", shares).collect()}
    assert len(got) == len(values) * len(shares)
    for s, some in values.items():
        ordered = np.sort(some)
        for q in shares:
            at = (len(some) - 1) * q
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            want = low if low == high else low * (np.ceil(at) - at) + high * (at - np.floor(at))
            assert got[s, q] == pytest.approx(want, rel=1e-12) or got[s, q] == want


def test_quantiles(spark):
    check(spark, 1)


def test_quantiles_narrow_several_times(spark, small_ranges):
    check(spark, 2)


def test_quantiles_of_nothing_and_of_too_much(spark):
    empty = spark.createDataFrame([], "signal string, x double")
    assert selection.exact_quantiles(empty, "signal", "x", [0.5]).collect() == []
    assert selection.overall_median(empty, "x").first()["median"] is None
    many = spark.range(20_000).selectExpr("id AS signal", "0.0D AS x")
    with pytest.raises(ValueError):
        selection.exact_quantiles(many, "signal", "x", [0.5])


def test_no_group_holds_a_signal(spark):
    table = spark.range(50_000).selectExpr("'a' AS signal", "CAST(id AS DOUBLE) AS x")
    plan = selection._narrowed.__doc__ and selection._inside(table.withColumnsRenamed({"signal": "s"}), {("a", 0.0, 49_999.0, 0, 50_000): [7]})
    assert "percentile" not in plan._jdf.queryExecution().toString()
    assert selection.exact_quantiles(table, "signal", "x", [0.25]).first()["quantile"] == 12_499.75


def test_global_rank(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), float(v)) for i, v in enumerate(rng.integers(0, 40, 500))]
    table = spark.createDataFrame(rows, "id bigint, v double").repartition(6)
    from pyspark.sql import functions as F

    got = {r["id"]: r["place"] for r in selection.global_rank(table, [F.col("v"), F.col("id")]).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert selection.global_rank(table.limit(0), [F.col("v")]).collect() == []
