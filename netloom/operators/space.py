"""Geometry in tables: polygons as segments, inside tests, crossings, nearest points, hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalar
from netloom.plans import lineage


def polygon_segments(polygon: DataFrame) -> DataFrame:
    """x1, y1, x2, y2 of each side of a polygon given as one row with an array ``points`` of (x, y); closed if it is not."""
    ring = polygon.select(F.when(F.element_at("points", 1) == F.element_at("points", -1), F.col("points")).otherwise(F.concat("points", F.array(F.element_at("points", 1)))).alias("p"))
    side = F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b"))))
    return ring.select(side.alias("s")).select(F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def inside(points: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``inside``: whether each point (x, y) is in the polygon, by the parity of sides that a ray crosses.

    Sides are one polygon's, so each point meets a fixed number of rows.
    """
    met = points.crossJoin(F.broadcast(segments))
    crosses = scalar.edge_crosses_ray(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    return met.groupBy(*keys).agg((F.sum(crosses.cast("int")) % 2 == 1).alias("inside"))


def crossing(pairs: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``crosses``: whether the line from (ox, oy) to (dx, dy) meets a side of the polygon."""
    met = pairs.crossJoin(F.broadcast(segments))
    cross = scalar.segments_cross(*(F.col(c) for c in ("ox", "oy", "dx", "dy", "x1", "y1", "x2", "y2")))
    return met.groupBy(*keys).agg(F.max(cross).alias("crosses"))


def reach_m(y: Column, res: Column) -> Column:
    """Metres that no point outside the three by three cells of ``res`` degrees around a point's own can be nearer than."""
    low = F.cos(F.radians(y)) * F.cos(F.radians(F.least(F.lit(90.0), F.abs(y) + res)))
    across = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), low)) * F.sin(F.radians(F.least(res, F.lit(180.0))) / 2)))
    return scalar.EARTH_RADIUS_M * F.least(F.radians(res), across)


def around(points: DataFrame, seeds: DataFrame, res: float, names: list[str]) -> DataFrame:
    """``points`` (x, y, ...) with each seed (``names``, sx, sy) in their cell of ``res`` degrees or a neighbouring one, and ``metres`` to it.

    A join on cells: seeds are copied to nine of them, points are not.
    """
    cell = lambda x, y: [F.floor(F.col(x) / res).alias("_ix"), F.floor(F.col(y) / res).alias("_iy")]
    step = F.sequence(F.lit(-1), F.lit(1))
    dealt = seeds.select(*names, "sx", "sy", *cell("sx", "sy")).withColumn("_ix", F.explode(F.transform(step, lambda d: F.col("_ix") + d))).withColumn("_iy", F.explode(F.transform(step, lambda d: F.col("_iy") + d)))
    met = points.select("*", *cell("x", "y")).join(dealt, ["_ix", "_iy"]).drop("_ix", "_iy")
    return met.withColumn("metres", F.round(scalar.haversine_m(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")), 3))


def nearest(points: DataFrame, seeds: DataFrame, key: str, seed: str, other: bool = False) -> DataFrame:
    """key, seed, metres: the nearest seed (seed, sx, sy) of each point (x, y), the least of equals; with ``other``, not one of its own name.

    Points look in the cells around them, of a size at which a cell has a seed or two; those that find none surely nearest there look
    again in cells four times as large, until the cells around a point are the whole box. A few rounds, each over fewer points.
    """
    box = seeds.agg(F.count("*").alias("n"), (F.max("sx") - F.min("sx")).alias("w"), (F.max("sy") - F.min("sy")).alias("h")).first()
    if not box["n"]:
        return points.select(key, F.lit(None).cast(seeds.schema[seed].dataType).alias(seed), F.lit(None).cast("double").alias("metres")).limit(0)
    span = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    ends = seeds.agg(F.min("sx"), F.max("sx"), F.min("sy"), F.max("sy")).first()
    extent = max([1e-6, *(max(p, q) - min(r, t) for p, q, r, t in ((span[1], ends[1], span[0], ends[0]), (span[3], ends[3], span[2], ends[2])) if p is not None)])
    res = max(1e-6, ((box["w"] or 1e-6) * (box["h"] or 1e-6) / box["n"]) ** 0.5)
    left = points.where("x IS NOT NULL AND y IS NOT NULL").select(key, "x", "y")
    found = []
    while True:
        last = res > extent
        met = around(left, seeds, 4 * res if last else res, [seed])
        best = (met.where(F.col(key) != F.col(seed)) if other else met).groupBy(key, "y").agg(F.min(F.struct("metres", seed)).alias("m"))
        best = best.select(key, f"m.{seed}", "m.metres", (F.lit(last) | (F.col("m.metres") + 0.002 < reach_m(F.col("y"), F.lit(res)))).alias("_sure"))
        best = lineage.cut(best)
        found.append(best.where("_sure").drop("_sure"))
        if last:
            return reduce(DataFrame.unionByName, found)
        left = lineage.cut(left.join(best.where("_sure").select(key), key, "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
        res *= 4


def access(zones: DataFrame, nodes: DataFrame, k: int, least_m: float, most_m: float) -> DataFrame:
    """zone_id, node_id, metres, rank: up to k nearest nodes of each zone within a band of distances, else the one nearest.

    Zones meet the nodes in the cells around them, of a size that reaches the band's end; those that have none look for the nearest.
    """
    steep = zones.agg(F.max(F.abs("y"))).first()[0]
    if steep is None:
        return zones.select("zone_id", F.lit(0).cast("long").alias("node_id"), F.lit(0.0).alias("metres"), F.lit(1).alias("rank")).limit(0)
    res = most_m / scalar.EARTH_RADIUS_M * 180 / math.pi
    while res < 360 and _reach(steep, res) <= most_m:
        res *= 1.2
    at = nodes.select("node_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    met = around(zones.select("zone_id", "x", "y"), at, res, ["node_id"]).where((F.col("metres") >= least_m) & (F.col("metres") <= most_m))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("zone_id").orderBy("metres", "node_id"))).where(F.col("rank") <= k)
    ranked = lineage.cut(ranked.select("zone_id", "node_id", "metres", "rank"))
    far = lineage.cut(zones.select("zone_id", "x", "y").join(ranked.select("zone_id"), "zone_id", "left_anti"))
    if far.isEmpty():
        return ranked
    return ranked.union(nearest(far, at, "zone_id", "node_id").select("zone_id", "node_id", "metres", F.lit(1)))


def _reach(y: float, res: float) -> float:
    low = math.cos(math.radians(y)) * math.cos(math.radians(min(90.0, abs(y) + res)))
    return scalar.EARTH_RADIUS_M * min(math.radians(res), 2 * math.asin(min(1.0, math.sqrt(max(0.0, low)) * math.sin(math.radians(min(res, 180.0)) / 2))))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull, counter-clockwise from the least point; collinear points are left out."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def chain(some: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(ordered) + chain(ordered[::-1])


def hulls(points: DataFrame, key: str) -> DataFrame:
    """key and ``wkt``, the POLYGON of the hull of its points (x, y).

    Each task first reduces its own points to hulls, whose points alone are shuffled, so a key may have any number of rows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[tuple[float, float]]] = {}
        for batch in batches:
            for k, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                mine = held.setdefault(k, [])
                mine.append((x, y))
                if len(mine) > 4096:
                    held[k] = hull(mine)
        rows = [(k, x, y) for k, mine in held.items() for x, y in hull(mine)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))], names=[key, "x", "y"])

    def whole(table: pa.Table) -> pa.Table:
        ring = hull(list(zip(table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True)))
        ring += ring[:1]
        return pa.table({key: table.column(key)[:1], "wkt": ["POLYGON((" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in ring) + "))"]})

    return points.select(F.col(key).cast("long").alias(key), "x", "y").mapInArrow(partial, f"{key} long, x double, y double").groupBy(key).applyInArrow(whole, f"{key} long, wkt string")
