"""Zones and demand made up where files give none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalar
from netloom.operators import space

METRES_A_MINUTE = 30 * 1609 / 60
#: Zones between all of which distances are taken at most.
MOST_ZONES = 50_000


def accessibility(zones: DataFrame) -> DataFrame:
    """o, d, metres, minutes at 30 miles an hour between all zones: a matrix, for at most MOST_ZONES zones.

    The other side of the product is broadcast, after its size is checked.
    """
    if (n := zones.count()) > MOST_ZONES:
        raise ValueError(f"{n} zones; a matrix of at most {MOST_ZONES} is made")
    a = zones.select(F.col("zone_id").alias("o"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = zones.select(F.col("zone_id").alias("d"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    metres = scalar.haversine_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return a.crossJoin(F.broadcast(b)).where("o <> d").select("o", "d", F.round(metres, 3).alias("metres"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]).withColumn("minutes", F.col("metres") / METRES_A_MINUTE)


def gravity(reach: DataFrame, zones: DataFrame, cutoff_min: float = 40.0) -> DataFrame:
    """o, d, volume: production times the share of attraction; only zones within the cutoff count in the denominator."""
    a = zones.select(F.col("zone_id").alias("o"), "production")
    b = zones.select(F.col("zone_id").alias("d"), "attraction")
    met = reach.join(F.broadcast(a), "o").join(F.broadcast(b), "d")
    near = F.sum(F.when(F.col("minutes") < cutoff_min, F.col("attraction")).otherwise(0.0)).over(Window.partitionBy("o"))
    return met.withColumn("near", near).where("near > 0").select("o", "d", (F.col("production") * F.col("attraction") / F.col("near")).alias("volume"))


def desire_lines(reach: DataFrame) -> DataFrame:
    """o, d and a LINESTRING between the two zones."""
    return reach.select("o", "d", F.format_string("LINESTRING (%.6f %.6f, %.6f %.6f)", "x1", "y1", "x2", "y2").alias("geometry"))


def grid_zones(nodes: DataFrame, cells: int = 8) -> DataFrame:
    """Zones from a grid over the nodes: cell_id, zone_id, nodes, x, y, production and attraction.

    The resolution is the mean side of the box over ``cells``, rounded up on a ladder.
    """
    box = nodes.agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("bottom"), F.max("y").alias("top"))
    raw = (F.col("right") - F.col("left") + F.col("top") - F.col("bottom")) / 2 / cells
    # The sides of cells that may be chosen, in degrees.
    ladder = [0.00005, 0.0001, 0.0002, 0.00025, 0.0005, 0.001, 0.002, 0.0025, 0.005, 0.01, 0.02, 0.025, 0.05, 0.1, 0.2, 0.25, 0.5, 1.0, 2.0]
    step = F.lit(ladder[-1])
    for value in reversed(ladder):
        step = F.when(raw <= value, F.lit(value)).otherwise(step)
    sized = nodes.crossJoin(F.broadcast(box.select(step.alias("res"))))
    celled = sized.withColumn("ix", F.floor(F.col("x") / F.col("res"))).withColumn("iy", F.floor(F.col("y") / F.col("res")))
    out = celled.groupBy("ix", "iy").agg(F.count("*").alias("nodes"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return out.withColumn("zone_id", F.row_number().over(Window.orderBy("ix", "iy"))).withColumn("production", F.col("nodes") * 10.0).withColumn("attraction", F.col("nodes") * 10.0)


def activity_nodes(nodes: DataFrame, every: int = 10) -> DataFrame:
    """Every so manieth node by number, as places of activity."""
    return nodes.withColumn("_k", F.row_number().over(Window.orderBy("node_id"))).where(F.col("_k") % every == 0).drop("_k")


def mean_nearest(nodes: DataFrame) -> DataFrame:
    """One row, ``metres``: the mean distance of places (node_id, x, y) to the nearest other."""
    other = nodes.select(F.col("node_id").alias("b"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    return space.nearest(nodes, other, "node_id", "b", other=True).agg(F.avg("metres").alias("metres"))
