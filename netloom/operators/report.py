"""Reports: measures of links, routes, origin-destination cells, districts and the whole system."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import vdf

c = F.col
MPH = 1.609


def link_measures(perf: DataFrame, tallied: DataFrame) -> DataFrame:
    """Links by period: volumes, speed, and vehicle and person distances, hours and delays."""
    persons = tallied.groupBy("link_id", "period").agg(F.sum("persons").alias("persons"))
    out = perf.join(persons, ["link_id", "period"], "left").withColumn("persons", F.coalesce("persons", F.lit(0.0)))
    speed = F.when(c("minutes") > 0.001, c("distance_km") / F.greatest(F.lit(0.1), c("minutes")) * 60).otherwise(c("vf"))
    out = out.withColumn("speed", speed).withColumn("speed_ratio", c("speed") / F.greatest(F.lit(0.001), c("vf"))).withColumn("_miles", c("length_m") / 1609)
    out = out.withColumns({"vmt": c("volume") * c("_miles"), "pmt": c("persons") * c("_miles"), "vht": c("volume") * c("minutes") / 60, "pht": c("persons") * c("minutes") / 60, "pdt_vf": c("persons") * (c("minutes") - c("fftt")) / 60})
    out = out.withColumn("pdt_vc", F.greatest(F.lit(0.0), c("persons") * (c("minutes") - c("fftt") * c("vf") / F.greatest(F.lit(0.001), c("vc"))) / 60))
    return out.withColumn("vkmt", c("vmt") * MPH).withColumn("ref_diff", F.when(c("ref_volume") > 1, c("volume") - c("ref_volume"))).drop("_miles")


def network_speed(measures: DataFrame) -> DataFrame:
    """One row: network totals, their speed, and the mean absolute percentage difference to counts."""
    share = F.abs(c("ref_diff")) / c("ref_volume") * 100
    return measures.agg(F.sum("vmt").alias("vmt"), F.sum("vht").alias("vht"), (F.sum("vmt") / F.sum("vht")).alias("speed_mph"), F.avg(share).alias("ref_mape"))


def emissions(perf: DataFrame, rates: DataFrame) -> DataFrame:
    """link_id, period, mode and kilograms that a vehicle emits on a link, a column ``<kind>_kg`` for each kind of ``rates``.

    ``rates``: link_type, mode, kind, rate (four coefficients): a few rows.
    """
    met = perf.select("link_id", "period", "link_type", "minutes", "fftt", "vf").join(F.broadcast(rates), "link_type")
    kinds = sorted(r["kind"] for r in rates.select("kind").distinct().collect())  # co2, nox
    each = met.withColumn("kg", vdf.emission_kg(c("minutes"), c("fftt"), c("vf"), c("rate")))
    return each.groupBy("link_id", "period", "mode").agg(*(F.coalesce(F.sum(F.when(c("kind") == k, c("kg"))), F.lit(0.0)).alias(f"{k}_kg") for k in kinds))


def emitted(paths: DataFrame, emissions_: DataFrame, keys: list[str]) -> DataFrame:
    """keys and kilograms of all vehicles of paths (mode, period, link_seq, volume): of links, routes, cells or the whole system."""
    kinds = [x for x in emissions_.columns if x.endswith("_kg")]
    steps = paths.select(*{*keys, "mode", "period", "volume"} - {"link_id"}, F.explode("link_seq").alias("link_id"))
    met = steps.join(emissions_, ["link_id", "period", "mode"])
    return met.groupBy(*keys).agg(*(F.sum(c(k) * c("volume")).alias(k) for k in kinds))


def mode_volumes(tallied: DataFrame, modes: list[str]) -> DataFrame:
    """One row a link and period with the vehicles and persons of each mode in columns."""
    wide = tallied.groupBy("link_id", "period").pivot("mode", modes).agg(F.sum("vehicles").alias("vehicles"), F.sum("persons").alias("persons"))
    return wide.na.fill(0.0)


def route_measures(pool: DataFrame, perf: DataFrame) -> DataFrame:
    """Paths with minutes, free-flow minutes, delay, kilometres, toll and the sequence of nodes."""
    keys = ["o", "d", "mode", "period", "path"]
    steps = pool.select(*keys, "volume", F.posexplode("link_seq").alias("k", "link_id"))
    seen = perf.select("link_id", "period", "from_node_id", "to_node_id", "minutes", "fftt", "distance_km", "toll_auto")
    met = steps.join(seen, ["link_id", "period"])
    out = met.groupBy(*keys).agg(
        F.first("volume").alias("volume"), F.sum("minutes").alias("minutes"), F.sum("fftt").alias("fftt"), F.sum(F.greatest(F.lit(0.0), c("minutes") - c("fftt"))).alias("delay"), F.sum("distance_km").alias("km"),
        F.sum(F.when(c("mode") == "auto", c("toll_auto")).otherwise(0.0)).alias("toll"), F.sort_array(F.collect_list(F.struct("k", "from_node_id", "to_node_id"))).alias("_n"),
    )
    names = F.transform("_n", lambda n: n["to_node_id"].cast("string"))
    return out.withColumn("node_sequence", F.concat_ws(";", F.element_at("_n", 1)["from_node_id"].cast("string"), F.array_join(names, ";"))).drop("_n")


def od_measures(routes: DataFrame) -> DataFrame:
    """Cells with volume, paths, volume-weighted means and the least minutes."""
    mean = lambda x: (F.sum(c(x) * c("volume")) / F.sum("volume")).alias(f"mean_{x}")
    return routes.groupBy("o", "d", "mode", "period").agg(F.sum("volume").alias("volume"), F.count("*").alias("paths"), mean("minutes"), mean("km"), mean("delay"), F.min("minutes").alias("least_minutes"))


def summed(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Volume, and total and mean kilometres, minutes and delay by the keys."""
    total = {x: F.sum(c(x) * c("volume")) for x in ("km", "minutes", "delay")}
    out = routes.groupBy(*keys).agg(F.count("*").alias("routes"), F.sum("volume").alias("volume"), *(e.alias(f"total_{x}") for x, e in total.items()))
    below = F.greatest(F.lit(0.001), c("volume"))
    out = out.withColumns({f"mean_{x}": c(f"total_{x}") / below for x in total})
    return out.withColumn("speed_kmph", c("mean_km") / F.greatest(F.lit(1e-4), c("mean_minutes") / 60))


def wide_links(perf: DataFrame, periods: list[str]) -> DataFrame:
    """One row a link with volume, doc and minutes of each period in columns."""
    return perf.groupBy("link_id").pivot("period", periods).agg(F.first("volume").alias("volume"), F.first("doc").alias("doc"), F.first("minutes").alias("minutes"))


def two_way(perf: DataFrame) -> DataFrame:
    """One row a road and period with the measures of both directions; the lesser end comes first."""
    a = perf.where("from_node_id < to_node_id").select(c("from_node_id").alias("a"), c("to_node_id").alias("b"), "period", c("volume").alias("ab_volume"), c("minutes").alias("ab_minutes"))
    b = perf.where("from_node_id > to_node_id").select(c("to_node_id").alias("a"), c("from_node_id").alias("b"), "period", c("volume").alias("ba_volume"), c("minutes").alias("ba_minutes"))
    return a.join(b, ["a", "b", "period"], "full")


def turns(pool: DataFrame, mode: str = "auto") -> DataFrame:
    """link_id, next_link_id, period, volume of turns from link to link by one mode."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("link_seq") - 1), lambda i: F.struct(F.element_at("link_seq", i).alias("link_id"), F.element_at("link_seq", i + 1).alias("next_link_id"))))
    return pool.where(c("mode") == mode).where(F.size("link_seq") > 1).select(pair.alias("t"), "period", "volume").groupBy("t.link_id", "t.next_link_id", "period").agg(F.sum("volume").alias("volume"))


def turn_text(turn_volumes: DataFrame) -> DataFrame:
    """link_id, period and its turns as ``next:volume;`` in one field."""
    one = F.format_string("%d:%.3f", c("next_link_id"), c("volume"))
    return turn_volumes.groupBy("link_id", "period").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("next_link_id", one.alias("text")))), lambda x: x["text"]), ";").alias("turns"))


def background(pool: DataFrame, threshold: float) -> DataFrame:
    """period, mode, and the number and volume of major paths (above the threshold) and of all others."""
    major = c("volume") > threshold
    return pool.groupBy("period", "mode").agg(F.count_if(major).alias("major_paths"), F.coalesce(F.sum(F.when(major, c("volume"))), F.lit(0.0)).alias("major_volume"), F.count_if(~major).alias("minor_paths"), F.coalesce(F.sum(F.when(~major, c("volume"))), F.lit(0.0)).alias("minor_volume"))


def internal_zones(nodes: DataFrame) -> DataFrame:
    """zone_index, zone_id, district_id, x, y: zones as an engine numbers them."""
    return nodes.where("zone_id IS NOT NULL").withColumn("zone_index", F.row_number().over(Window.orderBy("zone_id")) - 1).select("zone_index", "zone_id", "district_id", "x", "y")


def wide_by_mode(tallied: DataFrame, perf: DataFrame, periods: list[str], modes: list[str]) -> DataFrame:
    """One row a link with vehicles and passenger-car units of each period and mode in columns, and minutes, doc and lanes of each period."""
    volume = tallied.withColumn("_k", F.concat_ws("_", "period", "mode")).groupBy("link_id").pivot("_k", [f"{p}_{m}" for p in periods for m in modes]).agg(F.sum("vehicles").alias("vol"), F.sum("units").alias("pce"))
    state = perf.groupBy("link_id").pivot("period", periods).agg(F.first("minutes").alias("tt"), F.first("doc").alias("doc"), F.first("lanes").alias("lanes"), F.first("capacity").alias("cap"))
    return state.join(volume, "link_id", "left").na.fill(0.0)


def district_zones(zones: DataFrame) -> DataFrame:
    """district_id, zones (``;``-separated, ascending) and their number."""
    listed = F.sort_array(F.collect_set("zone_id"))
    return zones.where("zone_id IS NOT NULL").groupBy("district_id").agg(listed.alias("z")).select("district_id", F.array_join(F.transform("z", lambda x: x.cast("string")), ";").alias("zones"), F.size("z").cast("long").alias("n_zones"))


def access_links(links: DataFrame) -> DataFrame:
    """zone_id, node_id and direction (out of the zone, or into it) of all connectors."""
    out = c("from_node_id") < 0
    return links.where("link_type < 0").select(F.abs(F.when(out, c("from_node_id")).otherwise(c("to_node_id"))).alias("zone_id"), F.when(out, c("to_node_id")).otherwise(c("from_node_id")).alias("node_id"), F.when(out, "out").otherwise("in").alias("direction"))


def speed_columns(speeds: DataFrame, first: int, last: int, every: int = 15) -> DataFrame:
    """One row a link and period with the speed of each quarter of an hour (link_id, period, quarter, speed) in a column ``speed_HHMM``."""
    marks = list(range(first, last, every))
    wide = speeds.groupBy("link_id", "period").pivot("quarter", marks).agg(F.first("speed"))
    return wide.withColumnsRenamed({str(m): f"speed_{m // 60:02d}{m % 60:02d}" for m in marks})
