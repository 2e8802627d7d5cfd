"""Demand: filters, sums, profiles and departure times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT_MIN = 5


def between_zones(od: DataFrame, zones: DataFrame) -> DataFrame:
    """Demand rows between two different known zones. Semi-joins keep zones from multiplying rows."""
    known = zones.select("zone_id").where("zone_id IS NOT NULL").distinct()
    rows = od.where("o <> d AND volume IS NOT NULL")
    return rows.join(known.withColumnRenamed("zone_id", "o"), "o", "left_semi").join(known.withColumnRenamed("zone_id", "d"), "d", "left_semi").select(od.columns)


def missing_zones(od: DataFrame, zones: DataFrame) -> DataFrame:
    """zone, side, rows, volume of demand that names an unknown zone."""
    ends = od.select(F.col("o").alias("zone"), F.lit("origin").alias("side"), "volume").union(od.select(F.col("d").alias("zone"), F.lit("destination").alias("side"), "volume"))
    return ends.join(zones.select(F.col("zone_id").alias("zone")), "zone", "left_anti").groupBy("zone", "side").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"))


def scaled(od: DataFrame, file_factor: float, origin: DataFrame, destination: DataFrame, both: DataFrame) -> DataFrame:
    """Volumes times the file's factor and the district factors: of the pair, else the destination's, else the origin's, else 1."""
    out = od.join(F.broadcast(origin), "o_district", "left").join(F.broadcast(destination), "d_district", "left").join(F.broadcast(both), ["o_district", "d_district"], "left")
    return out.withColumn("volume", F.col("volume") * file_factor * F.coalesce("od_factor", "d_factor", "o_factor", F.lit(1.0)))


def totals(od: DataFrame) -> DataFrame:
    """Volumes by cell of origin, mode and period and by all coarser ones, in one pass."""
    sets = od.groupingSets([["mode", "period"], ["o"], []], "o", "mode", "period").agg(F.sum("volume").alias("volume"))
    return sets


def top_cells(od: DataFrame, n: int = 100) -> DataFrame:
    """The n largest cells of demand; equal volumes by zone numbers."""
    return od.groupBy("o", "d").agg(F.round(F.sum("volume"), 6).alias("volume")).orderBy(F.desc("volume"), "o", "d").limit(n)


def profile(slots: DataFrame) -> DataFrame:
    """slot, ratio, cum_ratio from slot and weight: shares of all slots, and their running sum. At most 288 rows are windowed."""
    whole = Window.partitionBy()
    return slots.select("slot", (F.col("weight") / F.sum("weight").over(whole)).alias("ratio")).withColumn("cum_ratio", F.sum("ratio").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))


def departures(cells: DataFrame, profile_: DataFrame) -> DataFrame:
    """One row per agent of each cell (keys and n) with its departure minute, by the inverse of the running profile.

    Agent v of n is at r = v / n: in the first slot whose running sum exceeds r, and as far into it as r is in its share.
    """
    steps = profile_.select("slot", "ratio", F.col("cum_ratio").alias("upper"), F.lag("cum_ratio", 1, 0.0).over(Window.orderBy("slot")).alias("lower"))
    agents = cells.where("n > 0").withColumn("v", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).withColumn("r", F.col("v") / F.col("n"))
    met = agents.join(F.broadcast(steps), (F.col("r") >= F.col("lower")) & (F.col("r") < F.col("upper")))  # a day's slots
    return met.withColumn("departure_min", (F.col("slot") + (F.col("r") - F.col("lower")) / F.col("ratio")) * SLOT_MIN).drop("upper", "lower", "ratio", "slot", "r")


def volume_cutoff(od: DataFrame, most: int) -> DataFrame:
    """One row, ``cutoff``: the volume of the origin that is ``most``-th from the top, the least of all if there are fewer."""
    sent = od.groupBy("o").agg(F.sum("volume").alias("volume"))
    return sent.orderBy(F.desc("volume"), "o").limit(most).agg(F.min("volume").alias("cutoff"))


def alternatives(choices: DataFrame) -> DataFrame:
    """choice, alternative, volume, trips and share of each alternative in its choice set (choice, alternative, zone_chain, volume)."""
    legs = F.size(F.split("zone_chain", ";")) - 1
    out = choices.groupBy("choice", "alternative").agg(F.sum("volume").alias("volume"), F.sum(F.col("volume") * legs).alias("trips"))
    return out.withColumn("share", F.col("volume") / F.sum("volume").over(Window.partitionBy("choice")))
