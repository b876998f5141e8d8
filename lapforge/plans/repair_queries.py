"""Queries of repair, reshaping, joins and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.functions.scalars import clock_seconds, haversine_m, integer, number, padded, vehicle_from_id
from lapforge.operators import repair as P
from lapforge.operators.compare import standings
from lapforge.operators.race import keep_last
from lapforge.operators.selection import overall_median
from lapforge.plans.adapter import CARS_PER_RACE, LAPS_SQL, SIGNALS, events, laps

KEY = ["race", "vehicle_number", "lap"]
RACE_EVENTS_SQL = f"ev AS (SELECT user_id // {CARS_PER_RACE} AS race, user_id AS vehicle_number, event_id, epoch_us(ts) AS ts_us, event_type, value, props FROM events)"


def race_events(s, d):
    from lapforge.functions.scalars import micros

    return events(s, d).select(
        F.expr(f"user_id div {CARS_PER_RACE}").alias("race"),
        F.col("user_id").alias("vehicle_number"),
        "event_id",
        micros(F.col("ts")).alias("ts_us"),
        "event_type",
        "value",
        "props",
    )


def pivot_long_wide(s, d):
    long = race_events(s, d).withColumn("day", F.expr("ts_us div 86400000000"))
    return P.pivot_signals(long, ["vehicle_number", "day"], SIGNALS, ["ts_us", "event_id"], "event_type", "value")


def json_signals(s, d):
    ev = race_events(s, d)
    payload = F.when(
        F.col("event_id") % 7 == 0, F.lit("{broken")
    ).otherwise(F.to_json(F.array(F.struct(F.lit("v").alias("name"), F.col("value").alias("value")), F.struct(F.lit("k").alias("name"), F.get_json_object("props", "$.k").cast("double").alias("value")))))
    rows = P.explode_json_signals(ev.select("vehicle_number", payload.alias("value")))
    return rows.groupBy("vehicle_number", "signal").agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def starts(s, d):
    ev = race_events(s, d).filter("event_type = 'signup'")
    from pyspark.sql import Window

    w = Window.partitionBy("race", "vehicle_number").orderBy("ts_us", "event_id")
    return ev.withColumn("lap", F.row_number().over(w).cast("bigint")).select("race", "vehicle_number", "ts_us", "lap")


STARTS_SQL = (
    RACE_EVENTS_SQL
    + ", st AS (SELECT race, vehicle_number, ts_us, CAST(row_number() OVER (PARTITION BY vehicle_number ORDER BY ts_us, event_id) AS BIGINT) AS lap FROM ev WHERE event_type = 'signup')"
)


def asof_lap_repair(s, d):
    rows = race_events(s, d).select("race", "vehicle_number", "event_id", "ts_us")
    return P.asof_laps(rows, starts(s, d), ["race", "vehicle_number"]).select("vehicle_number", "event_id", "lap")


def corrupt_lap_repair(s, d):
    rows = race_events(s, d).select(
        "race", "vehicle_number", "event_id", "ts_us", F.when((F.col("vehicle_number") % 3 == 0) & (F.col("event_id") % 5 == 0), 32768).otherwise(F.col("event_id") % 50).cast("bigint").alias("lap")
    )
    few = starts(s, d).filter("vehicle_number % 2 = 0")
    return P.repair_laps(rows, few, ["race", "vehicle_number"]).select("vehicle_number", "event_id", "lap")


def ids(s, d):
    return race_events(s, d).select(
        "event_id",
        F.concat_ws("-", F.lit("GR86"), padded(F.col("vehicle_number"), 3), F.when(F.col("event_id") % 4 == 0, "0").otherwise((F.col("event_id") % 97).cast("string"))).alias("vehicle_id"),
    )


IDS_SQL = "ids AS (SELECT event_id, 'GR86-' || CASE WHEN user_id < 1000 THEN lpad(CAST(user_id AS VARCHAR), 3, '0') ELSE CAST(user_id AS VARCHAR) END || '-' || CASE WHEN event_id % 4 = 0 THEN '0' ELSE CAST(event_id % 97 AS VARCHAR) END AS vehicle_id FROM events)"


def vehicle_repair(s, d):
    rows = ids(s, d)
    fixed = P.repair_vehicle(rows)
    return fixed.select(
        "event_id",
        F.col("vehicle_number").cast("bigint").alias("vehicle_number"),
        vehicle_from_id(F.col("vehicle_id"), "chassis").cast("bigint").alias("chassis"),
        P.vehicle_from_last_token(F.col("vehicle_id")).cast("bigint").alias("last_token"),
    )


def clock_strings(s, d):
    text = (
        F.when(F.col("event_id") % 5 == 0, F.lit("x"))
        .when(F.col("event_id") % 5 == 1, F.lit(""))
        .when(F.col("event_id") % 5 == 2, F.col("value").cast("string"))
        .otherwise(F.concat_ws(":", (F.col("event_id") % 3 + 1).cast("string"), F.format_string("%06.3f", F.col("value") % 60)))
    )
    return events(s, d).select("event_id", F.round(clock_seconds(text), 3).alias("seconds"), number(F.regexp_extract("props", r"(\d+)", 1)).alias("k"), integer(F.lit("1x")).isNull().alias("bad"))


def median_fill(s, d):
    rows = laps(s, d).withColumn("lap_time", F.when(F.col("lap") % 4 == 0, None).otherwise(F.col("lap_time")))
    return P.fill_with_medians(rows, "lap_time", ["race", "vehicle_number"]).select(*KEY, F.round(F.col("lap_time") + 1.7e-10, 6).alias("lap_time"))


def interpolated(s, d):
    rows = laps(s, d).withColumn("lap_time", F.when(F.col("lap") % 3 != 0, F.col("lap_time")))
    return P.interpolate(rows, "lap_time", ["race", "vehicle_number"], "lap").select(*KEY, F.round(F.col("lap_time") + 1.7e-10, 6).alias("lap_time"))


def endurance(s, d):
    return laps(s, d).filter("lap % 2 = 0").select(*KEY, (F.col("lap_time") * 2).alias("top_speed"), F.col("is_under_yellow").alias("flag"))


def left_join_flags(s, d):
    """Laps with the flags of a second source: missing flags 0, missing speeds the median of all."""
    joined = laps(s, d).select(*KEY, "lap_time").join(endurance(s, d), KEY, "left")
    overall = overall_median(endurance(s, d), "top_speed").select(F.col("median").alias("m"))
    return joined.crossJoin(F.broadcast(overall)).select(
        *KEY, F.coalesce("flag", F.lit(0)).alias("flag"), F.round(F.coalesce("top_speed", "m") + 1.7e-10, 6).alias("top_speed")
    )


def sector_unpivot(s, d):
    rows = laps(s, d).select(*KEY, (F.col("lap_time") * 0.3).alias("s1"), (F.col("lap_time") * 0.45).alias("s2"), (F.col("lap_time") * 0.25).alias("s3"))
    return P.unpivot_sectors(rows, KEY, ["s1", "s2", "s3"]).select(*KEY, "sector", F.round(F.col("seconds") + 1.7e-10, 6).alias("seconds"))


def union_of_races(s, d):
    rows = laps(s, d)
    a = rows.filter("race % 2 = 0").select("race", "lap_time")
    b = rows.filter("race % 2 = 1").select("race", "event_type")
    return P.union_ragged([a, b]).groupBy("race").agg(F.count(F.lit(1)).alias("n"), F.count("lap_time").alias("n_times"), F.count("event_type").alias("n_types"))


def missing_laps(s, d):
    """Laps between a vehicle's first and last that have no row under green: expected minus actual."""
    green = laps(s, d).filter("is_under_yellow = 0").select(*KEY)
    span = green.groupBy("race", "vehicle_number").agg(F.min("lap").alias("a"), F.max("lap").alias("b"))
    expected = span.select("race", "vehicle_number", F.explode(F.sequence("a", "b")).alias("lap"))
    return expected.join(green, KEY, "left_anti")


def podium_sets(s, d):
    """Overlap of two top-three sets per race: by total value and by number of laps."""
    g = laps(s, d).groupBy("race", "vehicle_number").agg(F.sum("lap_time").alias("t"), F.count(F.lit(1)).alias("n"))
    top = lambda c: F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("k"), "vehicle_number"))), lambda x: x["vehicle_number"]), 1, 3)
    both = g.withColumn("t", F.round("t", 4)).groupBy("race").agg(top("t").alias("a"), top("n").alias("b"))
    return both.select("race", F.size(F.array_intersect("a", "b")).cast("bigint").alias("n_common"), F.size(F.array_except("a", "b")).cast("bigint").alias("n_only"))


def driver_pair(s, d):
    """Each vehicle and the one a place behind it at the end, lap by lap, and where their difference turns by more than a half."""
    from pyspark.sql import Window

    rows = laps(s, d).select(*KEY, "lap_time")
    placed = rows.join(standings(rows).select("race", "vehicle_number", F.col("final_position").alias("place")), ["race", "vehicle_number"])
    a = placed.select("race", "lap", "place", F.col("lap_time").alias("time_a"))
    b = placed.select("race", "lap", (F.col("place") - 1).alias("place"), F.col("lap_time").alias("time_b"))
    j = a.join(b, ["race", "lap", "place"]).withColumn("delta", F.col("time_a") - F.col("time_b"))
    w = Window.partitionBy("race", "place").orderBy("lap")
    return j.select("race", "place", "lap", F.round(F.col("delta") + 1.7e-10, 6).alias("delta"), (F.abs(F.col("delta") - F.lag("delta").over(w)) > 0.5).alias("crossover"))


def first_and_last(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("race").orderBy("ts_us", "vehicle_number", "lap")
    rows = laps(s, d).withColumns({"n": F.row_number().over(w), "m": F.count(F.lit(1)).over(Window.partitionBy("race"))})
    return rows.filter("n <= 2 or n > m - 2").select(*KEY, "ts_us")


def top_k(s, d):
    return laps(s, d).orderBy(F.desc("lap_time"), "vehicle_number", "lap").limit(25).select(*KEY, "lap_time")


def stride(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("race", "vehicle_number").orderBy("lap")
    return laps(s, d).withColumn("n", F.row_number().over(w)).filter("(n - 1) % 10 = 0").select(*KEY, "lap_time")


def stratified(s, d):
    """Up to two rows of each (vehicle, event type), picked by a seeded hash."""
    from pyspark.sql import Window

    order = F.md5(F.concat(F.lit("42-"), F.col("event_id").cast("string")))
    w = Window.partitionBy("vehicle_number", "event_type").orderBy(order)
    return race_events(s, d).withColumn("n", F.row_number().over(w)).filter("n <= 2").select("vehicle_number", "event_type", "event_id")


def signal_names(s, d):
    return events(s, d).select("event_type").dropna().distinct().orderBy("event_type")


def completeness(s, d):
    """Counts, span and whether the expected signals are all there; always evaluated."""
    names = F.array(*[F.lit(x) for x in SIGNALS])
    return race_events(s, d).groupBy("race").agg(
        F.countDistinct("vehicle_number").alias("n_vehicles"), F.count(F.lit(1)).alias("n_rows"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        (F.size(F.array_except(names, F.collect_set("event_type"))) == 0).alias("complete"),
    )


def haversine(s, d):
    from lapforge.plans.adapter import points

    return points(s, d).select("point_id", F.round(haversine_m(F.col("latitude"), F.col("longitude"), F.lit(0.0), F.lit(0.0)), 3).alias("metres"))


def weather_summary(s, d):
    """Five means over the table, joined to every race as one row."""
    rows = events(s, d).select("user_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    one = rows.agg(F.avg("value").alias("a"), F.avg("k").alias("b"), F.max("value").alias("c"), F.min("k").alias("e"))
    return laps(s, d).select("race").distinct().crossJoin(F.broadcast(one)).select("race", *[F.round(F.col(c) + 1.7e-10, 6).alias(n) for c, n in (("a", "air_temp"), ("b", "humidity"), ("c", "wind"), ("e", "pressure"))])


def best_laps(s, d):
    """Laps against the vehicle's best and the race's fastest."""
    rows = laps(s, d)
    best = rows.groupBy("race", "vehicle_number").agg(F.min("lap_time").alias("best"))
    from pyspark.sql import Window

    fastest = F.min("best").over(Window.partitionBy("race"))
    dim = best.withColumn("fastest", fastest)
    return rows.join(dim, ["race", "vehicle_number"], "left").select(*KEY, F.round(F.col("lap_time") - F.col("best") + 1.7e-10, 6).alias("delta_from_best"), F.round(F.col("lap_time") - F.col("fastest") + 1.7e-10, 6).alias("delta_from_fastest"))


QUERIES = {
    "pivot_long_wide": (
        pivot_long_wide,
        f"""WITH {RACE_EVENTS_SQL} SELECT vehicle_number, ts_us // 86400000000 AS day, """
        + ", ".join(f"arg_min(value, ts_us) FILTER (event_type = '{x}') AS {x}" for x in SIGNALS)
        + " FROM ev GROUP BY vehicle_number, ts_us // 86400000000",
    ),
    "json_signals": (
        json_signals,
        """SELECT user_id AS vehicle_number, signal, count(*) AS n, round(sum(v), 4) AS total FROM (
SELECT user_id, 'v' AS signal, value AS v FROM events WHERE event_id % 7 <> 0
UNION ALL SELECT user_id, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events WHERE event_id % 7 <> 0) GROUP BY user_id, signal""",
    ),
    "asof_lap_repair": (
        asof_lap_repair,
        f"""WITH {STARTS_SQL} SELECT ev.vehicle_number, ev.event_id, coalesce(st.lap, 0) AS lap
FROM ev ASOF LEFT JOIN st ON ev.vehicle_number = st.vehicle_number AND ev.ts_us > st.ts_us""",
    ),
    "corrupt_lap_repair": (
        corrupt_lap_repair,
        f"""WITH {STARTS_SQL}, x AS (SELECT vehicle_number, event_id, ts_us, CASE WHEN vehicle_number % 3 = 0 AND event_id % 5 = 0 THEN 32768 ELSE event_id % 50 END AS lap FROM ev),
few AS (SELECT * FROM st WHERE vehicle_number % 2 = 0),
m AS (SELECT *, max(lap) OVER (PARTITION BY vehicle_number) >= 100 AS bad, vehicle_number IN (SELECT vehicle_number FROM few) AS has FROM x),
j AS (SELECT m.vehicle_number, m.event_id, CAST(CASE WHEN bad AND has THEN coalesce(few.lap, 0) ELSE m.lap END AS BIGINT) AS lap
      FROM m ASOF LEFT JOIN few ON m.vehicle_number = few.vehicle_number AND m.ts_us > few.ts_us)
SELECT * FROM j WHERE lap < 100""",
    ),
    "vehicle_repair": (
        vehicle_repair,
        f"""WITH {IDS_SQL}, t AS (SELECT event_id, CAST(split_part(vehicle_id, '-', 3) AS BIGINT) AS car, CAST(split_part(vehicle_id, '-', 2) AS BIGINT) AS chassis FROM ids)
SELECT event_id, CASE WHEN car = 0 THEN chassis ELSE car END AS vehicle_number, chassis, car AS last_token FROM t""",
    ),
    "clock_strings": (
        clock_strings,
        """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN round(value, 3)
ELSE round((event_id % 3 + 1) * 60 + round(value % 60, 3), 3) END AS seconds, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, true AS bad FROM events""",
    ),
    "median_fill": (
        median_fill,
        f"""WITH {LAPS_SQL}, x AS (SELECT race, vehicle_number, lap, CASE WHEN lap % 4 = 0 THEN NULL ELSE lap_time END AS t FROM laps)
SELECT race, vehicle_number, lap, round(coalesce(t, median(t) OVER (PARTITION BY race, vehicle_number), (SELECT median(t) FROM x)) + 1.7e-10, 6) AS lap_time FROM x""",
    ),
    "interpolate_gaps": (
        interpolated,
        f"""WITH {LAPS_SQL}, x AS (SELECT race, vehicle_number, lap, CASE WHEN lap % 3 <> 0 THEN lap_time END AS t FROM laps),
y AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS q FROM x WINDOW w AS (PARTITION BY vehicle_number ORDER BY lap))
SELECT race, vehicle_number, lap, round(coalesce(t, p + (q - p) / 2 * 1, p) + 1.7e-10, 6) AS lap_time FROM y""",
    ),
    "left_join_flags": (
        left_join_flags,
        f"""WITH {LAPS_SQL}, e AS (SELECT race, vehicle_number, lap, lap_time * 2 AS top_speed, is_under_yellow AS flag FROM laps WHERE lap % 2 = 0)
SELECT laps.race, laps.vehicle_number, laps.lap, coalesce(flag, 0) AS flag, round(coalesce(top_speed, (SELECT median(top_speed) FROM e)) + 1.7e-10, 6) AS top_speed
FROM laps LEFT JOIN e USING (race, vehicle_number, lap)""",
    ),
    "sector_unpivot": (
        sector_unpivot,
        f"""WITH {LAPS_SQL} SELECT race, vehicle_number, lap, 's1' AS sector, round(lap_time * 0.3 + 1.7e-10, 6) AS seconds FROM laps
UNION ALL SELECT race, vehicle_number, lap, 's2', round(lap_time * 0.45 + 1.7e-10, 6) FROM laps UNION ALL SELECT race, vehicle_number, lap, 's3', round(lap_time * 0.25 + 1.7e-10, 6) FROM laps""",
    ),
    "union_ragged": (
        union_of_races,
        f"""WITH {LAPS_SQL} SELECT race, count(*) AS n, count(*) FILTER (race % 2 = 0) AS n_times, count(*) FILTER (race % 2 = 1) AS n_types FROM laps GROUP BY race""",
    ),
    "missing_laps": (
        missing_laps,
        f"""WITH {LAPS_SQL}, g AS (SELECT race, vehicle_number, min(lap) FILTER (is_under_yellow = 0) AS a, max(lap) FILTER (is_under_yellow = 0) AS b FROM laps GROUP BY race, vehicle_number)
SELECT laps.race, laps.vehicle_number, laps.lap FROM laps JOIN g USING (race, vehicle_number) WHERE is_under_yellow = 1 AND lap BETWEEN a AND b""",
    ),
    "podium_sets": (
        podium_sets,
        f"""WITH {LAPS_SQL}, g AS (SELECT race, vehicle_number, round(sum(lap_time), 4) AS t, count(*) AS n FROM laps GROUP BY race, vehicle_number),
r AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY t DESC, vehicle_number) AS rt, row_number() OVER (PARTITION BY race ORDER BY n DESC, vehicle_number) AS rn FROM g)
SELECT race, count(*) FILTER (rt <= 3 AND rn <= 3) AS n_common, count(*) FILTER (rt <= 3 AND rn > 3) AS n_only FROM r GROUP BY race""",
    ),
    "driver_pair": (
        driver_pair,
        f"""WITH {LAPS_SQL}, t AS (SELECT race, vehicle_number, max(lap) AS n, sum(lap_time) AS total FROM laps GROUP BY race, vehicle_number),
p AS (SELECT race, vehicle_number, row_number() OVER (PARTITION BY race ORDER BY n DESC, total, vehicle_number) AS place FROM t),
x AS (SELECT race, lap, place, lap_time FROM laps JOIN p USING (race, vehicle_number)),
j AS (SELECT a.race, a.place, a.lap, a.lap_time - b.lap_time AS delta FROM x a JOIN x b ON b.race = a.race AND b.lap = a.lap AND b.place = a.place + 1)
SELECT race, place, lap, round(delta + 1.7e-10, 6) AS delta, abs(delta - lag(delta) OVER (PARTITION BY race, place ORDER BY lap)) > 0.5 AS crossover FROM j""",
    ),
    "first_and_last_rows": (
        first_and_last,
        f"""WITH {LAPS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY ts_us, vehicle_number, lap) AS n, count(*) OVER (PARTITION BY race) AS m FROM laps)
SELECT race, vehicle_number, lap, ts_us FROM n WHERE n <= 2 OR n > m - 2""",
    ),
    "slowest_laps_top_k": (top_k, f"WITH {LAPS_SQL} SELECT race, vehicle_number, lap, lap_time FROM laps ORDER BY lap_time DESC, vehicle_number, lap LIMIT 25"),
    "stride_sample": (stride, f"WITH {LAPS_SQL} SELECT race, vehicle_number, lap, lap_time FROM laps WHERE (lap - 1) % 10 = 0"),
    "stratified_sample": (
        stratified,
        """WITH n AS (SELECT user_id AS vehicle_number, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('42-' || CAST(event_id AS VARCHAR))) AS n FROM events)
SELECT vehicle_number, event_type, event_id FROM n WHERE n <= 2""",
    ),
    "signal_names": (signal_names, "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL"),
    "completeness_report": (
        completeness,
        f"""WITH {RACE_EVENTS_SQL} SELECT race, count(DISTINCT vehicle_number) AS n_vehicles, count(*) AS n_rows, min(ts_us) AS first_us, max(ts_us) AS last_us, count(DISTINCT event_type) = 5 AS complete FROM ev GROUP BY race""",
    ),
    "haversine_distance": (
        haversine,
        """SELECT vec_id AS point_id, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(0.0 - CAST(embedding[1] AS DOUBLE)) / 2), 2) + cos(radians(CAST(embedding[1] AS DOUBLE))) * cos(radians(0.0)) * pow(sin(radians(0.0 - CAST(embedding[2] AS DOUBLE)) / 2), 2))), 3) AS metres FROM embeddings""",
    ),
    "weather_summary": (
        weather_summary,
        f"""WITH {LAPS_SQL}, w AS (SELECT avg(value) AS a, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS b, max(value) AS c, min(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS e FROM events)
SELECT DISTINCT race, round(a + 1.7e-10, 6) AS air_temp, round(b + 1.7e-10, 6) AS humidity, round(c + 1.7e-10, 6) AS wind, round(e + 1.7e-10, 6) AS pressure FROM laps, w""",
    ),
    "best_lap_deltas": (
        best_laps,
        f"""WITH {LAPS_SQL} SELECT race, vehicle_number, lap, round(lap_time - min(lap_time) OVER (PARTITION BY race, vehicle_number) + 1.7e-10, 6) AS delta_from_best,
round(lap_time - min(lap_time) OVER (PARTITION BY race) + 1.7e-10, 6) AS delta_from_fastest FROM laps""",
    ),
}
