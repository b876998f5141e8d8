"""Queries of corners and positions, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapforge.operators import lap_distance as D
from lapforge.operators import spatial as G
from lapforge.plans.adapter import TELEMETRY_SQL, points, telemetry

ALONG_SQL = f"{TELEMETRY_SQL}, al AS (SELECT *, sum(abs(speed) / 5) OVER (PARTITION BY race, vehicle_number, lap ORDER BY n) AS dm FROM telemetry)"
R6 = lambda c: F.round(F.col(c) + 1.7e-10, 6).alias(c)
#: Two hundred neighbouring points form a race, so its size does not grow with the table.
POINTS_PER_RACE = 200
RADIUS_M = 3000.0
RACE_POINTS_SQL = f"""
points AS (
  SELECT vec_id // {POINTS_PER_RACE} AS race, vec_id AS point_id, CAST(label AS BIGINT) AS track, CAST(embedding[1] AS DOUBLE) AS latitude, CAST(embedding[2] AS DOUBLE) AS longitude
  FROM embeddings)"""
CORNERS_SQL = "corners AS (SELECT race, track AS corner_id, avg(latitude) AS latitude, avg(longitude) AS longitude FROM points GROUP BY race, track)"
HAVERSINE_SQL = "2 * 6371000.0 * asin(sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)))"


def race_points(s, d):
    return points(s, d).select(F.expr(f"point_id div {POINTS_PER_RACE}").alias("race"), "point_id", "latitude", "longitude")


def marks(s, d):
    """The centre of a race's points of one label as a corner."""
    labelled = points(s, d).withColumn("race", F.expr(f"point_id div {POINTS_PER_RACE}"))
    return labelled.groupBy("race", F.col("track").alias("corner_id")).agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def track(s, d):
    """Telemetry with positions made of its signals."""
    return telemetry(s, d).withColumns({"latitude": F.round(F.col("speed") / 50) / 1000, "longitude": F.round(F.col("brake") / 25) / 1000, "lap": F.lit(1).cast("bigint")})


RULE = G.CornerRule(least_rows=20, least_distance=3, most_corners=50, least_samples=3, prominence=5.0)


def nearest(s, d):
    return G.nearest_corner(race_points(s, d), marks(s, d), RADIUS_M).select("race", "point_id", "corner_id")


def near(s, d):
    found = G.near_corner(race_points(s, d), marks(s, d), RADIUS_M)
    return found.groupBy("race", "corner_id").agg(F.count(F.lit(1)).alias("n_rows"))


def pairs(s, d):
    return G.close_pairs(race_points(s, d), RADIUS_M).select("race", "a", "b", F.round("metres", 3).alias("metres"))


def far_corners(s, d):
    return G.corner_gaps(marks(s, d), 10_000.0).select("race", "corner_id", F.round("metres", 3).alias("metres"))


def angular(s, d):
    return G.angular_order(race_points(s, d)).select("race", "point_id", "place", R6("angle"))


def length(s, d):
    return G.path_length(track(s, d), ["race", "vehicle_number"], "n").select("race", "vehicle_number", F.round("metres", 4).alias("metres"))


def speed_corners(s, d):
    return G.corners(track(s, d), RULE, "n")


def brake_corners(s, d):
    rule = G.CornerRule(signal="brake", minima=False, percentile=60.0, least_rows=20, least_distance=3, most_corners=50, least_samples=3, retry=False, kinds=G.BRAKE_CORNERS.kinds, otherwise="heavy")
    return G.corners(track(s, d), rule, "n")


def corner_check(s, d):
    return G.check_corners(speed_corners(s, d))


def corner_sweep(s, d):
    rules = [G.CornerRule(least_rows=20, least_distance=3, most_corners=50, least_samples=k, prominence=5.0) for k in (2, 3, 5, 8)]
    return G.best_rule(track(s, d), rules, target=6, within=(1, 40), order="n")


def along(s, d):
    """Telemetry with the distance run since the lap began: metres by speed, at five samples a second."""
    run = F.sum(F.abs(F.col("speed")) / 5).over(Window.partitionBy("race", "vehicle_number", "lap").orderBy("n"))
    return telemetry(s, d).withColumns({"lap_distance": run, "latitude": F.col("speed") / 50_000, "longitude": F.col("brake") / 25_000})


def common_axis(s, d):
    return D.resampled(along(s, d), ["speed", "brake"], 25.0).select("race", "vehicle_number", "lap", "distance", R6("speed"), R6("brake"))


def line_corners(s, d):
    rows = along(s, d)
    places = D.braking_places(rows, apart=1, prominence=0.0, least_rows=5, width=3, ties=["n"])
    each = ["race", "vehicle_number"]  # corners of every vehicle from its own laps
    return D.distance_corners(places, D.lap_extent(rows, race=each), fewest=6, most=8, race=each)


def tuned_corners(s, d):
    """Braking corners of the tuned rule, over each vehicle's samples as one lap."""
    return G.corners(track(s, d), replace(G.TUNED_CORNERS, least_rows=20, least_distance=3), "n")


def speed_peaks(s, d):
    """Local maxima of speed along a vehicle's samples, flat tops once."""
    rule = G.CornerRule(minima=False, percentile=0.0, least_rows=3, least_distance=1, most_corners=10**9, prominence=0.0)
    found = G.corner_candidates(track(s, d), rule, "n")
    return found.groupBy("race", "vehicle_number").agg(F.count(F.lit(1)).alias("n_peaks"), F.round(F.sum("level"), 4).alias("total"))


QUERIES = {
    "nearest_corner": (
        nearest,
        f"""WITH {RACE_POINTS_SQL}, {CORNERS_SQL}, m AS (
SELECT p.point_id, c.corner_id, sqrt(pow(p.latitude - c.latitude, 2) + pow(p.longitude - c.longitude, 2)) AS d FROM points p JOIN corners c USING (race)),
b AS (SELECT point_id, arg_min(corner_id, (d, corner_id)) AS corner_id FROM m WHERE d < {RADIUS_M} / 111000 GROUP BY point_id)
SELECT race, point_id, corner_id FROM points LEFT JOIN b USING (point_id)""",
    ),
    "near_corner_counts": (
        near,
        f"""WITH {RACE_POINTS_SQL}, {CORNERS_SQL} SELECT race, corner_id, count(*) AS n_rows FROM points p JOIN corners c USING (race)
WHERE abs(p.latitude - c.latitude) < {RADIUS_M} / 111000 AND abs(p.longitude - c.longitude) < {RADIUS_M} / 111000 GROUP BY race, corner_id""",
    ),
    "close_pairs": (
        pairs,
        f"""WITH {RACE_POINTS_SQL}, m AS (SELECT a.race, a.point_id AS a, b.point_id AS b, {HAVERSINE_SQL.format(a="a", b="b")} AS metres
FROM points a JOIN points b ON a.race = b.race AND a.point_id < b.point_id) SELECT race, a, b, round(metres, 3) AS metres FROM m WHERE metres < {RADIUS_M}""",
    ),
    "corner_gaps": (
        far_corners,
        f"""WITH {RACE_POINTS_SQL}, {CORNERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY corner_id) AS k FROM corners),
m AS (SELECT b.race, b.corner_id, {HAVERSINE_SQL.format(a="a", b="b")} AS metres FROM n a JOIN n b ON a.race = b.race AND b.k = a.k + 1)
SELECT race, corner_id, round(metres, 3) AS metres FROM m WHERE metres > 10000""",
    ),
    "angular_order": (
        angular,
        f"""WITH {RACE_POINTS_SQL}, a AS (SELECT race, point_id, atan2(latitude - avg(latitude) OVER w, longitude - avg(longitude) OVER w) AS angle FROM points WINDOW w AS (PARTITION BY race))
SELECT race, point_id, row_number() OVER (PARTITION BY race ORDER BY angle, point_id) AS place, round(angle + 1.7e-10, 6) AS angle FROM a""",
    ),
    "path_length": (
        length,
        f"""WITH {TELEMETRY_SQL}, p AS (SELECT race, vehicle_number, n, round(speed / 50) / 1000 AS x, round(brake / 25) / 1000 AS y FROM telemetry),
s AS (SELECT race, vehicle_number, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) * 111000 AS step FROM p WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY n))
SELECT race, vehicle_number, round(coalesce(sum(step), 0.0), 4) AS metres FROM s GROUP BY race, vehicle_number""",
    ),
    "speed_peaks": (
        speed_peaks,
        f"""WITH {TELEMETRY_SQL}, c AS (SELECT race, vehicle_number, n, speed, coalesce(speed <> lag(speed) OVER w, true) AS fresh FROM telemetry WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY n)),
t AS (SELECT race, vehicle_number, n, speed, lag(speed) OVER w AS p, lead(speed) OVER w AS q FROM c WHERE fresh WINDOW w AS (PARTITION BY race, vehicle_number ORDER BY n)),
l AS (SELECT race, vehicle_number, min(speed) AS low FROM telemetry GROUP BY ALL)
SELECT race, vehicle_number, count(*) AS n_peaks, round(sum(speed), 4) AS total FROM t JOIN l USING (race, vehicle_number) WHERE speed > p AND speed > q AND speed > low GROUP BY race, vehicle_number""",
    ),
    "resampled_laps": (
        common_axis,
        f"""WITH {ALONG_SQL}, one AS (SELECT race, vehicle_number, lap, dm, avg(speed) AS speed, avg(brake) AS brake FROM al GROUP BY ALL),
g AS (SELECT race, vehicle_number, lap, unnest(generate_series(CAST(ceil(min(dm) / 25) AS BIGINT), CAST(floor(max(dm) / 25) AS BIGINT))) * 25.0::DOUBLE AS distance FROM one GROUP BY race, vehicle_number, lap),
p AS (SELECT g.*, o.dm AS a0, o.speed AS s0, o.brake AS b0 FROM g ASOF JOIN one o ON g.race = o.race AND g.vehicle_number = o.vehicle_number AND g.lap = o.lap AND g.distance >= o.dm),
q AS (SELECT p.*, o.dm AS a1, o.speed AS s1, o.brake AS b1 FROM p ASOF JOIN one o ON p.race = o.race AND p.vehicle_number = o.vehicle_number AND p.lap = o.lap AND p.distance <= o.dm)
SELECT race, vehicle_number, lap, distance, round(CASE WHEN a0 = a1 THEN s0 ELSE s0 + (s1 - s0) * (distance - a0) / (a1 - a0) END + 1.7e-10, 6) AS speed,
round(CASE WHEN a0 = a1 THEN b0 ELSE b0 + (b1 - b0) * (distance - a0) / (a1 - a0) END + 1.7e-10, 6) AS brake FROM q""",
    ),
    "distance_corners": (
        lambda s, d: line_corners(s, d).select("race", "vehicle_number", "corner_id", R6("distance"), R6("latitude"), R6("longitude"), "max_level", "median_level", "n_observations", "corner_type", "narrowed"),
        f"""WITH {ALONG_SQL}, sm AS (SELECT *, CASE WHEN count(brake) OVER w = 3 THEN avg(brake) OVER w ELSE brake END AS smooth, count(*) OVER (PARTITION BY race, vehicle_number, lap) AS k FROM al
  WINDOW w AS (PARTITION BY race, vehicle_number, lap ORDER BY dm, n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
lm AS (SELECT race, vehicle_number, lap, quantile_cont(smooth, 0.4) FILTER (smooth > 0) AS floor FROM sm WHERE k >= 5 GROUP BY ALL),
rn AS (SELECT *, row_number() OVER (PARTITION BY race, vehicle_number, lap ORDER BY dm, n) AS i FROM sm),
fr AS (SELECT *, coalesce(smooth <> lag(smooth) OVER (PARTITION BY race, vehicle_number, lap ORDER BY i), true) AS fresh FROM rn),
rg AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY race, vehicle_number, lap ORDER BY i) AS run FROM fr),
lv AS (SELECT race, vehicle_number, lap, run, any_value(smooth) AS smooth, (min(i) + max(i)) // 2 AS mid FROM rg GROUP BY ALL),
pk AS (SELECT *, lag(smooth) OVER v AS p, lead(smooth) OVER v AS q FROM lv WINDOW v AS (PARTITION BY race, vehicle_number, lap ORDER BY run)),
places AS (SELECT rn.race, rn.vehicle_number, rn.lap, rn.dm, rn.speed / 50000 AS latitude, rn.brake / 25000 AS longitude, rn.brake AS level FROM pk JOIN lm USING (race, vehicle_number, lap) JOIN rn ON rn.race = pk.race AND rn.vehicle_number = pk.vehicle_number AND rn.lap = pk.lap AND rn.i = pk.mid
  WHERE pk.smooth > p AND pk.smooth > q AND pk.smooth >= floor),
ex AS (SELECT race, vehicle_number, count(*) AS n_laps, max(m) AS length FROM (SELECT race, vehicle_number, lap, max(dm) AS m FROM al GROUP BY ALL) GROUP BY race, vehicle_number),
tr AS (SELECT places.*, row_number() OVER () AS id, narrowed, least(50.0, length / 8 / 3) * CASE narrowed WHEN 1 THEN 0.6 ELSE 1 END AS eps, greatest(2, n_laps // CASE narrowed WHEN 1 THEN 5 ELSE 4 END) AS need
  FROM places JOIN ex USING (race, vehicle_number), (SELECT unnest([0, 1]) AS narrowed) WHERE length > 0),
nb AS (SELECT *, dm / eps AS z, count(*) OVER (PARTITION BY race, vehicle_number, narrowed ORDER BY dm / eps RANGE BETWEEN 1.0 PRECEDING AND 1.0 FOLLOWING) >= need AS core FROM tr),
cs AS (SELECT *, CASE WHEN z - lag(z) OVER (PARTITION BY race, vehicle_number, narrowed ORDER BY z) <= 1 THEN 0 ELSE 1 END AS fresh FROM nb WHERE core),
cc AS (SELECT DISTINCT race, vehicle_number, narrowed, z, sum(fresh) OVER (PARTITION BY race, vehicle_number, narrowed ORDER BY z, id ROWS UNBOUNDED PRECEDING) AS cluster FROM cs),
jo AS (SELECT nb.race, nb.vehicle_number, nb.narrowed, nb.id, arg_min(cluster, (abs(nb.z - cc.z), cc.z)) AS cluster FROM nb JOIN cc ON cc.race = nb.race AND cc.vehicle_number = nb.vehicle_number AND cc.narrowed = nb.narrowed AND cc.z BETWEEN nb.z - 1 AND nb.z + 1 GROUP BY ALL),
co AS (SELECT nb.race, nb.vehicle_number, nb.narrowed, cluster, median(dm) AS distance, median(latitude) AS latitude, median(longitude) AS longitude, max(level) AS max_level, median(level) AS median_level, count(*) AS n_observations FROM nb JOIN jo ON jo.id = nb.id AND jo.narrowed = nb.narrowed GROUP BY ALL),
us AS (SELECT *, CASE WHEN count(*) FILTER (narrowed = 0) OVER w < 6 AND count(*) FILTER (narrowed = 1) OVER w > count(*) FILTER (narrowed = 0) OVER w THEN 1 ELSE 0 END AS use FROM co WINDOW w AS (PARTITION BY race, vehicle_number))
SELECT race, vehicle_number, row_number() OVER (PARTITION BY race, vehicle_number ORDER BY distance, cluster) AS corner_id, round(distance + 1.7e-10, 6) AS distance, round(latitude + 1.7e-10, 6) AS latitude, round(longitude + 1.7e-10, 6) AS longitude, max_level, median_level, n_observations,
CASE WHEN max_level < 30 THEN 'light' WHEN max_level < 60 THEN 'medium' ELSE 'heavy' END AS corner_type, narrowed = 1 AS narrowed FROM us WHERE narrowed = use""",
    ),
    "given_corner_check": (
        lambda s, d: G.check_corners(marks(s, d).withColumn("level", 30 + 2000 * F.col("latitude")), least=3, most=9),
        f"WITH {RACE_POINTS_SQL}, {CORNERS_SQL} SELECT race, count(*) AS n_corners, count(*) < 3 AS too_few, count(*) > 9 AS too_many, count(*) FILTER (30 + 2000 * latitude < 30) > 0.5 * count(*) AS too_slow FROM corners GROUP BY race",
    ),
    "tuned_corners": (tuned_corners, None),
    "speed_corners": (speed_corners, None),
    "brake_corners": (brake_corners, None),
    "corner_check": (corner_check, None),
    "corner_sweep": (corner_sweep, None),
}
