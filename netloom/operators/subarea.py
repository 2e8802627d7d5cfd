"""Subarea focusing: which zones matter to a polygon, and how demand flows across its border."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flags(zones: DataFrame, od: DataFrame, crossed: DataFrame, large: float, least: float, cutoff: float) -> DataFrame:
    """zone_id, inside, volume, flag.

    Inside zones count all they send and get 3 at ``large`` or more, else 4. Outside zones count what they send across the
    polygon: 0 below ``least``, 1 below ``cutoff``, else 2. Zones with 0 or 1 are not significant.
    """
    volume = od.groupBy("o", "d").agg(F.sum("volume").alias("v"))
    sent = volume.join(crossed, ["o", "d"], "left")
    met = zones.join(sent.withColumnRenamed("o", "zone_id"), "zone_id", "left")
    out = met.groupBy("zone_id", "inside").agg(F.coalesce(F.sum(F.when(F.col("inside") | F.col("crosses"), F.col("v"))), F.lit(0.0)).alias("volume"))
    v = F.col("volume")
    return out.withColumn("flag", F.when(F.col("inside") & (v >= large), 3).when(F.col("inside"), 4).when(v < least, 0).when(v < cutoff, 1).otherwise(2))


def significant(flagged: DataFrame) -> DataFrame:
    """Significant zones with ``sindex``, 0, 1, ... by zone number."""
    return flagged.where("flag >= 2").withColumn("sindex", F.row_number().over(Window.orderBy("zone_id")) - 1)


def within(od: DataFrame, kept: DataFrame, passing: DataFrame) -> DataFrame:
    """Demand between significant zones, or whose pair (o, d) passes through the polygon."""
    both = od.join(kept.select(F.col("zone_id").alias("o"), F.lit(True).alias("a")), "o", "left").join(kept.select(F.col("zone_id").alias("d"), F.lit(True).alias("b")), "d", "left").join(passing.select("o", "d", F.lit(True).alias("p")), ["o", "d"], "left")
    return both.where("(a AND b) OR p").select(od.columns)


def flow_matrix(zones: DataFrame, od: DataFrame) -> DataFrame:
    """origin, destination (inside or outside), volume."""
    name = lambda x: F.when(F.col(x), "inside").otherwise("outside")
    a = zones.select(F.col("zone_id").alias("o"), name("inside").alias("origin"))
    b = zones.select(F.col("zone_id").alias("d"), name("inside").alias("destination"))
    return od.join(F.broadcast(a), "o").join(F.broadcast(b), "d").groupBy("origin", "destination").agg(F.sum("volume").alias("volume"))


def seeds(zones: DataFrame, wanted: int) -> DataFrame:
    """A deterministic sample of about ``wanted`` zones, by a hash of the zone number; at least one."""
    order = Window.orderBy(F.xxhash64("zone_id"), "zone_id")
    return zones.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= wanted).drop("_k")


def super_zones(zones: DataFrame, most: int, nearest) -> DataFrame:
    """zone_id, seed: each zone's super-zone, the nearest of ``most`` seeds; each its own where there are no more zones."""
    if zones.limit(most + 1).count() <= most:
        return zones.select("zone_id", F.col("zone_id").alias("seed"))
    picked = seeds(zones, most).select(F.col("zone_id").alias("seed"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    return nearest(zones, picked, "zone_id", "seed").select("zone_id", "seed")
