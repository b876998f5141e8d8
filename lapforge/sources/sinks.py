"""Sinks: partitioned Parquet and CSV, JSON manifests, coefficient tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ("track", "race"), mode: str = "overwrite") -> None:
    """Parquet under one folder per value of by; rows are dealt out by those columns first, so a folder gets few files."""
    keys = [c for c in by if c in df.columns]
    (df.repartition(*keys).write.partitionBy(*keys) if keys else df.write).mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, by: Sequence[str] = ("track",), mode: str = "overwrite") -> None:
    keys = [c for c in by if c in df.columns]
    (df.repartition(*keys).write.partitionBy(*keys) if keys else df.write).mode(mode).option("header", True).csv(path)


def race_manifest(features: DataFrame) -> DataFrame:
    """One JSON line per race: laps, drivers, samples."""
    rows = features.groupBy("track", "race").agg(
        F.max("lap").alias("total_laps"), F.countDistinct("vehicle_number").alias("num_drivers"), F.count(F.lit(1)).alias("num_samples")
    )
    return rows.select("track", "race", F.to_json(F.struct(*rows.columns)).alias("entry"))


def write_manifest(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    race_manifest(features).select(F.col("entry").alias("value")).write.mode(mode).text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """{track: {race: entry}} of the written lines, one a race."""
    out: dict = {}
    for row in spark.read.text(path).collect():
        entry = json.loads(row["value"])
        out.setdefault(entry["track"], {})[str(entry["race"])] = entry
    return out


def save_model(model, path: str) -> None:
    """A pyspark.ml model, or a DataFrame of coefficients."""
    if isinstance(model, DataFrame):
        model.write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
