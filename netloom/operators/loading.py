"""Loading demand on links, successive averages, and link performance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from netloom.functions import scalar, vdf
from netloom.operators import routing

c = F.col
#: A period has this share of a link's capacity.
PERIOD_SHARE = 1 / 3


@dataclass(frozen=True)
class Rules:
    """What a run takes into account beside times: by default the car's toll alone.

    ``queue``: the queue-based function gives times, not the polynomial. ``restricted``: links close to modes that their allowed_uses
    leave out. ``tolls`` and ``penalties``: the column of a mode's toll, and of its penalty in minutes.
    """

    queue: bool = False
    restricted: bool = False
    tolls: dict[str, str] = field(default_factory=lambda: {"auto": "toll_auto"})
    penalties: dict[str, str] = field(default_factory=dict)


def of_period(df: DataFrame, name: str) -> Column:
    """A link's value in the row's period: a map column has one for each."""
    return F.element_at(name, c("period")) if isinstance(df.schema[name].dataType, MapType) else c(name)


def tally(paths: DataFrame, modes: DataFrame) -> DataFrame:
    """link_id, period, mode, vehicles, persons from paths (link_seq, volume); partial sums are made before the shuffle."""
    steps = paths.where(F.size("link_seq") > 0).select(F.explode("link_seq").alias("link_id"), "period", "mode", "volume")
    summed = steps.groupBy("link_id", "period", "mode").agg(F.sum("volume").alias("vehicles"))
    return summed.join(F.broadcast(modes.select("mode", "occupancy", "pce")), "mode").select("link_id", "period", "mode", "vehicles", (c("vehicles") * c("occupancy")).alias("persons"), (c("vehicles") * c("pce")).alias("units"))


def volumes(tallied: DataFrame) -> DataFrame:
    """link_id, period, volume: all vehicles of all modes."""
    return tallied.groupBy("link_id", "period").agg(F.sum("vehicles").alias("volume"))


def connector(links: DataFrame) -> Column:
    """Whether a link is a connector; networks without link types have none."""
    return c("link_type") < 0 if "link_type" in links.columns else F.lit(False)


def performance(links: DataFrame, periods: DataFrame, volume: DataFrame | None, share: float = PERIOD_SHARE, rules: Rules = Rules()) -> DataFrame:
    """Links by period with volume, doc, minutes and speed by the volume-delay function; without volumes, of the empty network.

    Capacity is the link's, for one lane; lanes count for storage and reports alone. Parameters may be maps by period. Connectors
    (link_type below 0) take no time.
    """
    out = links.crossJoin(F.broadcast(periods))  # a few rows
    out = out.join(volume, ["link_id", "period"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0))) if volume is not None else out.withColumn("volume", F.lit(0.0))
    for name, value in vdf.DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(of_period(out, name), F.lit(value)) if name in out.columns else F.lit(value))
    shared = out.withColumnRenamed("lanes", "_lanes").withColumn("lanes", F.lit(1.0)).withColumn("_capacity", c("capacity")).withColumn("capacity", c("capacity") * share)
    done = vdf.qvdf(shared).withColumn("minutes", c("q_min")) if rules.queue else vdf.bpr(shared).withColumn("minutes", c("bpr_min"))
    done = done.withColumn("lanes", c("_lanes")).withColumn("capacity", c("_capacity")).drop("_lanes", "_capacity", "bpr_wait", "bpr_min")
    return done.withColumn("minutes", F.when(connector(done), 0.0).otherwise(c("minutes")))


def by_mode(columns: dict[str, str]) -> Column:
    """The row's mode's value, 0 for a mode without a column."""
    out = F.lit(0.0)
    for mode, name in columns.items():
        out = F.when(c("mode") == mode, F.coalesce(name, F.lit(0.0))).otherwise(out)
    return out


def costs(perf: DataFrame, modes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Generalised cost of each link, mode and period in millionths of a minute; below 0 on links that are closed to the mode."""
    met = perf.crossJoin(F.broadcast(modes.select("mode", "vot")))  # a few rows
    cost = F.round(vdf.gradient_cost(c("minutes"), by_mode(rules.penalties), by_mode(rules.tolls), c("vot")) * routing.MICRO).cast("long")
    if rules.restricted:
        cost = F.when(scalar.allow_mode(of_period(met, "allowed_uses"), c("mode")) | connector(met), cost).otherwise(-1)
    return met.select("link_id", "from_node_id", "to_node_id", "mode", "period", cost.alias("cost"))


def all_or_nothing(od: DataFrame, net: routing.Network) -> DataFrame:
    """o, d, mode, period, volume, cost, link_seq: all demand of each cell on its least-cost route; cells without one are left out.

    Ways are traced to the destinations that have demand alone; an origin has as many of these as there are zones at most.
    """
    routes = routing.trees(od.groupBy("o", "mode", "period").agg(F.collect_set("d").alias("dests")), net)
    return od.join(routes, ["o", "d", "mode", "period"]).select("o", "d", "mode", "period", "volume", "cost", "link_seq")


def average(old: DataFrame | None, new: DataFrame, k: int) -> DataFrame:
    """Volumes (link_id, period, volume) after round k = 0, 1, ... of successive averages: old * k / (k + 1) + new / (k + 1)."""
    part = new.select("link_id", "period", (c("volume") / (k + 1)).alias("volume"))
    if old is not None:
        part = part.unionByName(old.select("link_id", "period", (c("volume") * k / (k + 1)).alias("volume")))
    return part.groupBy("link_id", "period").agg(F.sum("volume").alias("volume"))


def system(perf: DataFrame) -> DataFrame:
    """One row: vehicle minutes and vehicle kilometres."""
    return perf.agg(F.sum(c("volume") * c("minutes")).alias("vehicle_min"), F.sum(c("volume") * c("distance_km")).alias("vehicle_km"))
