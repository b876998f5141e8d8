"""The driver's tables seen as races: events are laps and telemetry, embeddings are track positions.

Twenty-five neighbouring users form a race, so every group that an operator looks at has a size that
does not grow with the data. Rows are dealt out by race once; windows by (race, vehicle) and by
(race, lap) then need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapforge.functions.scalars import micros

CARS_PER_RACE = 25
TOTAL_LAPS = 60
#: An error of at least this value brings out the yellow flag (about a fifth of the laps).
YELLOW_VALUE = 150
#: Rows of events that a task gets on average: what one task sorts and holds does not grow with the table.
ROWS_PER_TASK = 25_000
SIGNALS = ["click", "error", "purchase", "signup", "view"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def dealt_by_race(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows, made of table, dealt out by race into parts that follow the number of rows.

    All windows behind it stay on this shuffle, so a task holds its rows once a window. A number of parts left to the
    session is fixed, and adaptive execution joins parts by the bytes they have before the windows.
    """
    return rows.repartition(max(1, -(-table.count() // ROWS_PER_TASK)), "race")


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race, vehicle_number, lap, ts_us, lap_time, is_under_yellow, event_type."""
    table = events(spark, sf_dir)
    rows = table.select(
        F.expr(f"user_id div {CARS_PER_RACE}").alias("race"),
        F.col("user_id").alias("vehicle_number"),
        "event_id",
        micros(F.col("ts")).alias("ts_us"),
        F.col("value").alias("lap_time"),
        ((F.col("event_type") == "error") & (F.col("value") >= YELLOW_VALUE)).cast("int").alias("is_under_yellow"),
        "event_type",
    )
    order = Window.partitionBy("race", "vehicle_number").orderBy("ts_us", "event_id")
    return dealt_by_race(rows, table).withColumn("lap", F.row_number().over(order).cast("bigint")).drop("event_id")


LAPS_SQL = f"""
laps AS (
  SELECT user_id // {CARS_PER_RACE} AS race, user_id AS vehicle_number,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS lap,
         epoch_us(ts) AS ts_us, value AS lap_time,
         CASE WHEN event_type = 'error' AND value >= {YELLOW_VALUE} THEN 1 ELSE 0 END AS is_under_yellow, event_type
  FROM events)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race, vehicle_number, lap (ten samples each), n, ts_us and the signals of a wide telemetry table."""
    table = events(spark, sf_dir)
    rows = table.select(
        F.expr(f"user_id div {CARS_PER_RACE}").alias("race"),
        F.col("user_id").alias("vehicle_number"),
        "event_id",
        micros(F.col("ts")).alias("ts_us"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    order = Window.partitionBy("race", "vehicle_number").orderBy("ts_us", "event_id")
    placed = dealt_by_race(rows, table).withColumn("n", F.row_number().over(order).cast("bigint"))
    return placed.select(
        "race",
        "vehicle_number",
        F.expr("(n - 1) div 10 + 1").alias("lap"),
        "n",
        "ts_us",
        F.least(F.col("value") * 1.5, F.lit(100.0)).alias("throttle"),
        F.col("k").alias("brake"),
        F.least(F.col("value") + F.col("k"), F.lit(200.0)).alias("speed"),
        (F.col("value") - F.col("k")).alias("steering"),
        ((F.col("k") - 50) / 25).alias("accx"),
        ((F.col("value") - 50) / 50).alias("accy"),
    )


TELEMETRY_SQL = f"""
placed AS (
  SELECT user_id // {CARS_PER_RACE} AS race, user_id AS vehicle_number,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n,
         epoch_us(ts) AS ts_us, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events),
telemetry AS (
  SELECT race, vehicle_number, (n - 1) // 10 + 1 AS lap, n, ts_us, least(value * 1.5, 100.0) AS throttle, k AS brake,
         least(value + k, 200.0) AS speed, value - k AS steering, (k - 50) / 25 AS accx, (value - 50) / 50 AS accy
  FROM placed)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, track, latitude, longitude."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("point_id"),
        F.col("label").cast("bigint").alias("track"),
        F.col("embedding")[0].cast("double").alias("latitude"),
        F.col("embedding")[1].cast("double").alias("longitude"),
    )


POINTS_SQL = """
points AS (
  SELECT vec_id AS point_id, CAST(label AS BIGINT) AS track, CAST(embedding[1] AS DOUBLE) AS latitude,
         CAST(embedding[2] AS DOUBLE) AS longitude
  FROM embeddings)"""
