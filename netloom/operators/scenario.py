"""Traffic management: closures, lane changes, tolls, message signs, and what they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
#: Weight of a minute in the choice between a route and its diversion.
SENSITIVITY = -0.1
#: Travellers without information divert if it saves this many minutes and this share.
LEAST_MINUTES, LEAST_SHARE = 3.0, 0.15


def managed(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Links with the rules (from_node_id, to_node_id, dtm_type, final_lanes, toll) applied: lanes, toll_auto, closed, sign.

    ``dynamic_lane_use`` and ``lane_closure`` set lanes; a link of no lanes is closed. ``dynamic_toll`` sets the toll, ``dms`` marks a
    message sign. Links without a rule stay as they are.
    """
    rule = rules.groupBy("from_node_id", "to_node_id").agg(
        F.min(F.when(c("dtm_type").isin("dynamic_lane_use", "lane_closure"), c("final_lanes"))).alias("_lanes"), F.max(F.when(c("dtm_type") == "dynamic_toll", c("toll"))).alias("_toll"), F.max(c("dtm_type") == "dms").alias("_sign"),
    )
    out = links.join(F.broadcast(rule), ["from_node_id", "to_node_id"], "left")  # rules of the settings
    out = out.withColumns({"lanes": F.coalesce("_lanes", "lanes"), "toll_auto": F.coalesce("_toll", "toll_auto"), "closed": F.coalesce(c("_lanes") <= 0, F.lit(False)), "sign": F.coalesce("_sign", F.lit(False))})
    return out.drop("_lanes", "_toll", "_sign")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """link_id, period, before, after, change of volumes of all links in either."""
    a = before.select("link_id", "period", c("volume").alias("before"))
    b = after.select("link_id", "period", c("volume").alias("after"))
    out = a.join(b, ["link_id", "period"], "full")
    out = out.select("link_id", "period", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return out.withColumn("change", c("after") - c("before"))


def logit_share(base: F.Column, other: F.Column, weight: float = SENSITIVITY) -> F.Column:
    """The share that takes the other route, by minutes."""
    return 1 / (1 + F.exp(weight * (base - other)))


def diverted(paths: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Impacted paths with the volume that diverts to each cell's alternative by logit, and that which would without information.

    ``paths``: cell, path, volume, minutes; ``alternatives``: cell, alt_minutes.
    """
    met = paths.join(alternatives, ["o", "d", "mode", "period"])
    saving = c("minutes") - c("alt_minutes")
    bounded = (saving > LEAST_MINUTES) & (saving > LEAST_SHARE * c("minutes"))
    return met.withColumn("diverted", c("volume") * logit_share(c("minutes"), c("alt_minutes"))).withColumn("uninformed", F.when(bounded, c("volume")).otherwise(0.0)).withColumn("staying", c("volume") - c("diverted"))


def chained(paths: DataFrame) -> DataFrame:
    """chain, link_seq: the paths of an activity chain (chain, leg, link_seq) one after another."""
    legs = F.sort_array(F.collect_list(F.struct("leg", "link_seq")))
    return paths.groupBy("chain").agg(F.flatten(F.transform(legs, lambda x: x["link_seq"])).alias("link_seq"))
