"""Corners and positions: peaks along a lap, density clusters, nearest and close points, angular order.

Peaks and clusters are grouped numpy kernels: a group is one vehicle's laps in a race, or the laps
of one race, so its size does not grow with the table. Searches by distance are equi-joins on grid cells,
never products of whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.functions.scalars import EARTH_RADIUS_M, METRES_PER_DEGREE, bands, haversine_m, planar_degrees
from lapforge.operators import RACE


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places higher than both neighbours; a flat top counts once, at its middle. Ends never count."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    last = np.append(first[1:], len(x)) - 1
    level = x[first]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (first[inner] + last[inner]) // 2


def peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Local maxima that reach height, then the highest of those closer than distance, then by prominence.

    Prominence: how far one must go down from a peak, to both sides, before higher ground.
    """
    at = local_maxima(x)
    if height is not None:
        at = at[x[at] >= height]
    if distance > 1 and len(at) > 1:
        gone = np.zeros(len(at), bool)
        for i in np.lexsort((at, x[at]))[::-1]:
            if not gone[i]:
                gone |= (np.abs(at - at[i]) < distance) & (np.arange(len(at)) != i)
        at = at[~gone]

    def deep(p: int) -> float:
        higher = np.flatnonzero(x > x[p])
        left, right = higher[higher < p], higher[higher > p]
        low = x[(left[-1] if len(left) else 0) : p + 1].min(), x[p : (right[0] if len(right) else len(x) - 1) + 1].min()
        return x[p] - max(low)

    return at[[deep(p) >= prominence for p in at.tolist()]] if prominence > 0 and len(at) else at


def density_labels(xy: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Cluster number per point, -1 for noise. Cores have at least `least` points within eps, themselves
    included; cores within eps share a cluster; a border point goes to its nearest core.

    Points at one place share all neighbours, so places are looked at, each with its number of points.
    """
    if not len(xy):
        return np.full(0, -1)
    place, first, of, weight = np.unique(xy, axis=0, return_index=True, return_inverse=True, return_counts=True)
    seen = np.argsort(first)  # places in the order of their first points
    place, first, weight = place[seen], first[seen], weight[seen]
    rank = np.empty_like(seen)
    rank[seen] = np.arange(len(seen))
    label = np.full(len(place), -1)
    order = np.argsort(place[:, 0], kind="stable")
    sorted_x = place[order, 0]
    near = []
    for p in place:
        band = order[np.searchsorted(sorted_x, p[0] - eps) : np.searchsorted(sorted_x, p[0] + eps, "right")]
        near.append(band[np.hypot(*(place[band] - p).T) <= eps])
    core = np.array([weight[b].sum() >= least for b in near])
    number = 0
    for i in range(len(place)):
        if not core[i] or label[i] >= 0:
            continue
        front = [i]
        label[i] = number
        while front:
            fresh = [j for j in near[front.pop()].tolist() if core[j] and label[j] < 0]
            label[fresh] = number
            front += fresh
        number += 1
    for i in np.flatnonzero(~core):
        mine = near[i][core[near[i]]]
        if len(mine):
            label[i] = label[mine[np.argmin(np.hypot(*(place[mine] - place[i]).T))]]
    return label[rank[of.reshape(-1)]]


@dataclass(frozen=True)
class CornerRule:
    """How corners are found. signal: what is looked at; minima: slow places rather than hard braking."""

    signal: str = "speed"
    minima: bool = True
    percentile: float = 40.0
    most_corners: int = 20
    least_distance: int = 10
    prominence: float = 5.0
    least_rows: int = 50
    eps: float = 2e-4
    least_samples: int | None = None  # default: a third of the laps, two at least
    retry: bool = True
    kinds: tuple[tuple[float, str], ...] = ((60.0, "slow"), (90.0, "medium"))
    otherwise: str = "fast"
    smooth: int = 1  # samples of the centred mean that peaks are looked for in; the level stays the raw value
    above_zero: bool = False  # the percentile is of the values above 0, and peaks reach it (or `floor`)
    floor: float = 0.0
    by_peak: bool = False  # a corner's level is its largest, not its median
    wider: float = 2.0  # radius of the second try, in which `retry_least` places make a core
    retry_least: int | None = 2  # None: as in the first
    number_by: str | None = None  # longitude or angle; default: latitude for slow places, as found for braking


SPEED_CORNERS = CornerRule()
BRAKE_CORNERS = CornerRule(
    signal="brake", minima=False, percentile=60.0, retry=False, kinds=((30.0, "light"), (60.0, "medium")), otherwise="heavy"
)
TUNED_CORNERS = CornerRule(
    signal="brake", minima=False, percentile=50.0, least_rows=100, least_distance=15, most_corners=10**9, prominence=3.0, eps=1.2e-4, least_samples=3, retry=False,
    kinds=BRAKE_CORNERS.kinds, otherwise="heavy", smooth=5, above_zero=True, by_peak=True, number_by="longitude",
)
FINAL_CORNERS = CornerRule(
    signal="brake", minima=False, percentile=40.0, least_rows=100, least_distance=10, most_corners=10**9, prominence=2.0, eps=1.2e-4, least_samples=2,
    kinds=BRAKE_CORNERS.kinds, otherwise="heavy", smooth=5, above_zero=True, floor=10.0, by_peak=True, wider=1.5, retry_least=None, number_by="angle",
)


def centred_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Mean of `width` values about each; the value itself near the ends and beside missing ones."""
    if width <= 1 or len(x) < width:
        return x
    mean = np.convolve(x, np.full(width, 1 / width), "valid")
    out, side = x.astype(float).copy(), width // 2
    out[side : side + len(mean)] = np.where(np.isnan(mean), out[side : side + len(mean)], mean)
    return out


def _filled(x: np.ndarray) -> np.ndarray:
    """Linear between known values; leading gaps stay unknown, trailing ones take the last value."""
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return x
    out = np.interp(np.arange(len(x)), known, x[known])
    out[: known[0]] = np.nan
    return out


def _lap_places(x: np.ndarray, rule: CornerRule) -> tuple[np.ndarray, np.ndarray]:
    """Candidate places of one lap's values in order, and the filled values there."""
    none = np.zeros(0, np.int64), np.zeros(0)
    if len(x) < rule.least_rows or np.isnan(x).mean() > 0.5:
        return none
    x = _filled(x)
    apart = max(len(x) // (2 * rule.most_corners), rule.least_distance)
    if rule.above_zero:
        soft = np.nan_to_num(centred_mean(x, rule.smooth), nan=0.0)
        if not (soft > 0).any():
            return none
        limit = max(float(np.percentile(soft[soft > 0], rule.percentile)), rule.floor)
        at = peaks(soft, limit, apart, rule.prominence)
        return at, x[at]
    limit = np.nanpercentile(x, rule.percentile)
    signed = np.nan_to_num(-x if rule.minima else x, nan=-np.inf)
    at = peaks(signed, distance=apart, prominence=rule.prominence)
    at = at[x[at] < limit] if rule.minima else at[x[at] > limit]
    return at, x[at]


def _candidates(part: pd.DataFrame, rule: CornerRule, order: str, keys: Sequence[str]) -> pd.DataFrame:
    """Candidates of all laps in part: keys, latitude, longitude, level."""
    part = part.sort_values(order, kind="stable")
    lap = part.groupby(["vehicle_number", "lap"], dropna=False, sort=False).ngroup().to_numpy()
    by_lap = np.argsort(lap, kind="stable")
    x = part[rule.signal].to_numpy(float)[by_lap]
    edges = np.flatnonzero(np.diff(lap[by_lap], prepend=-1, append=-1))
    found = [(i, *_lap_places(x[i:j], rule)) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    at = np.concatenate([i + places for i, places, _ in found])
    return part.iloc[by_lap[at]][[*keys, "latitude", "longitude"]].assign(level=np.concatenate([level for _, _, level in found]))


def _placed(telemetry: DataFrame, signals: Sequence[str], order: str, race: Sequence[str]) -> DataFrame:
    columns = [*race, "vehicle_number", "lap", order, "latitude", "longitude"]
    return telemetry.dropna(subset=["latitude", "longitude"]).select(*columns, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(signals)])


def _shape(rows: DataFrame, columns: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def corner_candidates(telemetry: DataFrame, rule: CornerRule = SPEED_CORNERS, order: str = "ts_us", race: Sequence[str] = RACE) -> DataFrame:
    """Candidate places of every lap: race columns, vehicle_number, lap, latitude, longitude, level.

    The kernel takes all laps of a vehicle in a race at once."""
    keys = [*race, "vehicle_number", "lap"]
    rows = _placed(telemetry, [rule.signal], order, race)
    shape = _shape(rows, [*keys, "latitude", "longitude"]) + ", level double"
    return rows.groupBy(*race, "vehicle_number").applyInPandas(lambda part: _candidates(part, rule, order, keys), shape)


def _clusters(part: pd.DataFrame, rule: CornerRule) -> np.ndarray:
    """Cluster of each of a race's candidates, sorted by vehicle, lap and place; -1 for none."""
    least = rule.least_samples or max(2, len(part[["vehicle_number", "lap"]].drop_duplicates()) // 3)
    xy = part[["latitude", "longitude"]].to_numpy(float)
    label = density_labels(xy, rule.eps, least)
    if rule.retry and not (label >= 0).any():
        label = density_labels(xy, rule.wider * rule.eps, rule.retry_least or least)
    return label


_SORTED = ["vehicle_number", "lap", "latitude", "longitude"]


def corners(telemetry: DataFrame, rule: CornerRule = SPEED_CORNERS, order: str = "ts_us", race: Sequence[str] = RACE) -> DataFrame:
    """One row per corner of a race: corner_id, latitude, longitude, level (median), level_std, n_observations,
    corner_type. Speed corners are numbered by position, brake corners as their clusters were found.

    One kernel a race looks for candidates and clusters them: the few candidates are not shuffled again, which
    adaptive execution would do into as few tasks as their bytes ask for."""
    keys = [*race, "vehicle_number", "lap"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = _candidates(part, rule, order, keys).sort_values(_SORTED)
        label = _clusters(part, rule)
        kept = part.assign(cluster=label)[label >= 0]
        grouped = kept.groupby("cluster")
        out = grouped[["latitude", "longitude", "level"]].median()
        if rule.by_peak:
            out["level"] = grouped["level"].max()
        out["level_std"] = grouped["level"].std()
        out["n_observations"] = grouped.size()
        if rule.number_by == "angle":
            out = out.iloc[np.argsort(np.arctan2(out["latitude"] - out["latitude"].mean(), out["longitude"] - out["longitude"].mean()).to_numpy(), kind="stable")]
        elif rule.number_by == "longitude":
            out = out.sort_values(["longitude", "latitude"])
        elif rule.minima:
            out = out.sort_values(["latitude", "longitude"])
        out["corner_id"] = np.arange(1, len(out) + 1)
        for c in race:
            out[c] = part[c].iloc[0] if len(part) else None
        return out[[*race, "corner_id", "latitude", "longitude", "level", "level_std", "n_observations"]]

    rows = _placed(telemetry, [rule.signal], order, race)
    shape = _shape(rows, race) + ", corner_id bigint, latitude double, longitude double, level double, level_std double, n_observations bigint"
    return rows.groupBy(*race).applyInPandas(run, shape).withColumn("corner_type", bands(F.col("level"), list(rule.kinds), rule.otherwise))


def check_corners(found: DataFrame, least: int = 3, most: int = 20, race: Sequence[str] = RACE) -> DataFrame:
    """Per race: n_corners, too_few, too_many, too_slow (over half of the corners below 30)."""
    n = F.count(F.lit(1))
    return found.groupBy(*race).agg(
        n.alias("n_corners"), (n < least).alias("too_few"), (n > most).alias("too_many"), (F.count_if(F.col("level") < 30) > 0.5 * n).alias("too_slow")
    )


def best_rule(telemetry: DataFrame, rules: Sequence[CornerRule], target: int = 12, within: tuple[int, int] = (11, 14), order: str = "ts_us", race: Sequence[str] = RACE) -> DataFrame:
    """Per race the rule (its place in rules) whose number of corners is nearest the target and within bounds.

    One kernel a race tries all rules; those that look for the same candidates share one search for them."""
    keys = [*race, "vehicle_number", "lap"]
    searches = [replace(rule, eps=0.0, least_samples=None, retry=False, kinds=(), otherwise="", by_peak=False, wider=0.0, retry_least=None, number_by=None) for rule in rules]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = {search: _candidates(part, search, order, keys).sort_values(_SORTED) for search in dict.fromkeys(searches)}
        counts = [int(_clusters(found[search], rule).max(initial=-1)) + 1 for search, rule in zip(searches, rules, strict=True)]
        fit = [(abs(n - target), i, n) for i, n in enumerate(counts) if n and within[0] <= n <= within[1]]
        return part[list(race)].iloc[: len(fit[:1])].assign(rule=[i for _, i, _ in sorted(fit)[:1]], n_corners=[n for _, _, n in sorted(fit)[:1]])

    rows = _placed(telemetry, [rule.signal for rule in rules], order, race)
    return rows.groupBy(*race).applyInPandas(run, _shape(rows, race) + ", rule int, n_corners bigint")


def _cells(df: DataFrame, x: str, y: str, side: float, around: bool) -> DataFrame:
    """df with its grid cell (cx, cy); with around, once for each of the nine cells about it."""
    cx, cy = (F.floor(F.col(c) / side).cast("bigint") for c in (x, y))
    if not around:
        return df.withColumns({"cx": cx, "cy": cy})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("__d", F.explode(steps)).withColumns({"cx": cx + F.col("__d.i"), "cy": cy + F.col("__d.j")}).drop("__d")


def nearest_corner(points: DataFrame, found: DataFrame, radius_m: float, race: Sequence[str] = RACE) -> DataFrame:
    """points with corner_id, the nearest corner of their race strictly within the radius (planar degrees);
    equal distances go to the smaller id, none to NULL. points need point_id."""
    radius = radius_m / METRES_PER_DEGREE
    p = _cells(points, "latitude", "longitude", radius, False)
    c = _cells(found.select(*race, "corner_id", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon")), "c_lat", "c_lon", radius, True)
    distance = planar_degrees(F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon"))
    met = p.join(c, [*race, "cx", "cy"]).withColumn("d", distance).filter(F.col("d") < radius)
    best = met.groupBy("point_id").agg(F.min_by("corner_id", F.struct("d", "corner_id")).alias("corner_id"))
    return points.join(best, "point_id", "left")


def near_corner(telemetry: DataFrame, found: DataFrame, window_m: float, race: Sequence[str] = RACE) -> DataFrame:
    """Rows of telemetry inside the open box of half width window_m around a corner, with its corner_id."""
    half = window_m / METRES_PER_DEGREE
    t = _cells(telemetry, "latitude", "longitude", half, False)
    c = _cells(found.select(*race, "corner_id", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon")), "c_lat", "c_lon", half, True)
    inside = (F.abs(F.col("latitude") - F.col("c_lat")) < half) & (F.abs(F.col("longitude") - F.col("c_lon")) < half)
    return t.join(c, [*race, "cx", "cy"]).filter(inside).drop("cx", "cy", "c_lat", "c_lon")


def close_pairs(points: DataFrame, within_m: float, race: Sequence[str] = RACE) -> DataFrame:
    """(race columns, a, b, metres) of points a < b of a race closer than within_m on the sphere.

    Cells are cubes in space with that side: a chord is shorter than its arc, so neighbours are in touching
    cubes at any latitude.
    """
    lat, lon = F.radians("latitude"), F.radians("longitude")
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    cell = {f"c{k}": F.floor(v * (EARTH_RADIUS_M / within_m)).cast("bigint") for k, v in axes.items()}
    own = points.select(*race, F.col("point_id").alias("a"), F.col("latitude").alias("lat_a"), F.col("longitude").alias("lon_a"), *(v.alias(k) for k, v in cell.items()))
    steps = F.array(*[F.struct(*(F.lit(v).alias(k) for k, v in zip("xyz", d, strict=True))) for d in np.ndindex(3, 3, 3)])
    other = points.select(*race, F.col("point_id").alias("b"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b"), *(v.alias(k) for k, v in cell.items()), F.explode(steps).alias("d"))
    other = other.select(*race, "b", "lat_b", "lon_b", *((F.col(f"c{k}") + F.col(f"d.{k}") - 1).alias(f"c{k}") for k in "xyz"))
    metres = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return own.join(other, [*race, "cx", "cy", "cz"]).filter("a < b").withColumn("metres", metres).filter(F.col("metres") < within_m).select(*race, "a", "b", "metres")


def corner_gaps(found: DataFrame, over_m: float = 200.0, race: Sequence[str] = RACE) -> DataFrame:
    """Consecutive corners further apart than over_m: (race columns, corner_id, metres)."""
    w = Window.partitionBy(*race).orderBy("corner_id")
    before = haversine_m(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return found.withColumn("metres", before).filter(F.col("metres") > over_m).select(*race, "corner_id", "metres")


def angular_order(found: DataFrame, race: Sequence[str] = RACE) -> DataFrame:
    """found with angle around the race's centroid and place in that order."""
    all_of = Window.partitionBy(*race)
    angle = F.atan2(F.col("latitude") - F.avg("latitude").over(all_of), F.col("longitude") - F.avg("longitude").over(all_of))
    return found.withColumn("angle", angle).withColumn("place", F.row_number().over(all_of.orderBy("angle", "point_id")).cast("bigint"))


def path_length(track: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, metres): planar steps between consecutive positions, summed."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = planar_degrees(F.col("latitude"), F.col("longitude"), F.lag("latitude").over(w), F.lag("longitude").over(w))
    return track.withColumn("__s", step * METRES_PER_DEGREE).groupBy(*keys).agg(F.coalesce(F.sum("__s"), F.lit(0.0)).alias("metres"))
