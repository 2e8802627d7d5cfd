"""A whole run from a folder of files: read, assign, estimate, report."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import scalar
from netloom.operators import columns, demand, estimation, generate, loading, report, scenario, simulate, space, subarea
from netloom.plans import assignment, lineage
from netloom.sources import readers, settings, sinks

c = F.col


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def text_of(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_od(spark: SparkSession, folder: str, cfg: settings.Settings) -> DataFrame | None:
    """o, d, mode, period, volume of all demand files together.

    ``demand.bin`` comes before the column file of the same name; its records carry mode and period as numbers. An unknown mode
    is the first one. None where no file is there; files of routes are read apart (``read_fixed``).
    """
    modes = [m.mode_type for m in cfg.mode_types]
    parts = []
    for file in cfg.demand_files:
        if file.format_type in ("route", "path"):
            continue
        binary = f"{folder}/{file.file_name.rsplit('.', 1)[0]}.bin"
        if exists(spark, binary):
            coded = readers.read_demand_binary(spark, binary)
            names = spark.createDataFrame(list(enumerate(modes)), "mode_no int, mode string")
            spans = spark.createDataFrame([(k, p.period) for k, p in enumerate(cfg.periods)], "period_no int, period string")
            parts.append(coded.join(F.broadcast(names), "mode_no").join(F.broadcast(spans), "period_no").select("o", "d", "mode", "period", (c("volume") * file.scale_factor).alias("volume")))
        elif exists(spark, f"{folder}/{file.file_name}"):
            mode = file.mode_type if file.mode_type in modes else modes[0]
            parts.append(readers.read_demand(spark, f"{folder}/{file.file_name}", mode, file.demand_period, file.scale_factor))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).groupBy("o", "d", "mode", "period").agg(F.sum("volume").alias("volume"))


#: Added to twice a node's number: the number of its connector, below those of all links.
CONNECTOR = -(1 << 40)


def numbered(links: DataFrame) -> DataFrame:
    """Links with ``link_name`` as in the file and a number: the name where all are different whole numbers, else the rank by ends and name."""
    named = links.withColumn("link_name", c("link_id")).withColumn("link_id", c("link_id").try_cast("long"))
    told = named.agg(F.count("*").alias("n"), F.count_distinct("link_id").alias("k"), F.min("link_id").alias("low"), F.max("link_id").alias("high")).first()
    if told["n"] == 0 or (told["n"] == told["k"] and told["low"] >= 0 and told["high"] < 10**10):
        return named
    return named.withColumn("link_id", F.row_number().over(Window.orderBy("from_node_id", "to_node_id", "link_name")).cast("long"))  # one network's links


def connected(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links and, both ways, a connector between each zone's centroid (number below 0) and each of its nodes."""
    ends = nodes.where("zone_id IS NOT NULL").select((-c("zone_id")).alias("z"), "node_id")
    number = F.lit(CONNECTOR) + c("node_id") * 2
    out = ends.select(number.alias("link_id"), c("z").alias("from_node_id"), c("node_id").alias("to_node_id")).union(ends.select(number + 1, "node_id", "z"))
    return links.unionByName(out.select("*", F.lit(-1).alias("link_type"), F.lit(0.0).alias("fftt"), F.lit(0.0).alias("distance_km"), F.lit(0.0).alias("length_m"), F.lit(1.0).alias("lanes"), F.lit(1e6).alias("capacity"), F.lit(100.0).alias("vf"), F.lit(85.0).alias("vc")), allowMissingColumns=True)


def banned_turns(links: DataFrame) -> DataFrame:
    """link_id, next_link_id: after a link, not to the nodes in its restricted_turn_nodes."""
    told = links.where("restricted_turn_nodes IS NOT NULL").select("link_id", c("to_node_id").alias("at"), F.explode(scalar.split_numbers(c("restricted_turn_nodes"), "long")).alias("to"))
    return told.join(links.select(c("from_node_id").alias("at"), c("to_node_id").alias("to"), c("link_id").alias("next_link_id")), ["at", "to"]).select("link_id", "next_link_id").distinct()


def read_fixed(spark: SparkSession, folder: str, cfg: settings.Settings, links: DataFrame) -> DataFrame | None:
    """o, d, mode, period, path, link_seq, volume of route.csv and of demand files of routes; None where there are none.

    Zones are centroids. route.csv is the first mode's in the first period.
    """
    files = [(f.file_name, f.mode_type, f.demand_period, f.scale_factor) for f in cfg.demand_files if f.format_type in ("route", "path")]
    files.append(("route.csv", cfg.mode_types[0].mode_type, cfg.periods[0].period, 1.0))
    parts = []
    for name, mode, period, scale in files:
        if exists(spark, f"{folder}/{name}"):
            kinds = {"o_zone_id": ("long", None), "d_zone_id": ("long", None), "volume": ("double", 0.0), "node_sequence": ("string", None)}
            raw = readers.read_csv(spark, f"{folder}/{name}", kinds, tuple(kinds)).toDF("o", "d", "volume", "node_sequence")
            summed = raw.groupBy("o", "d", "node_sequence").agg(F.sum("volume").alias("volume")).withColumn("path_id", F.xxhash64("o", "d", "node_sequence"))
            found = readers.routes(summed, links, scale)
            parts.append(found.select((-c("o")).alias("o"), (-c("d")).alias("d"), F.lit(mode).alias("mode"), F.lit(period).alias("period"), columns.path_key("link_seq").alias("path"), "link_seq", "volume"))
    return lineage.cut(reduce(DataFrame.unionByName, parts)) if parts else None


def synthesised(spark: SparkSession, nodes: DataFrame, cfg: settings.Settings) -> DataFrame:
    """Demand of the first mode and period by gravity between zones, where a folder has none: ten trips a zone node each way."""
    zones = nodes.where("zone_id IS NOT NULL").groupBy("zone_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), (F.count("*") * 10.0).alias("production")).withColumn("attraction", c("production"))
    made = generate.gravity(generate.accessibility(zones), zones)
    return made.select("o", "d", F.lit(cfg.mode_types[0].mode_type).alias("mode"), F.lit(cfg.periods[0].period).alias("period"), "volume")


def load(spark: SparkSession, folder: str) -> tuple[assignment.Inputs, DataFrame, settings.Settings]:
    """(inputs of an assignment, nodes, settings) of a folder with settings.yml, node.csv, link.csv and demand files.

    Trips go from zone to zone over the connectors of all nodes of a zone; o and d are centroids, zone numbers below 0. With a
    subarea, only demand that touches it or passes it counts. Links are closed to modes by the allowed_uses of their type, cost
    each mode its own toll_<mode> and penalty_<mode>, and ban the first mode's turns to restricted_turn_nodes. link_qvdf.csv, if it is there,
    makes the queue-based function give times, with parameters by period. route.csv takes the place of demand files; where
    there is neither, demand is made up.
    """
    cfg = settings.parse(text_of(spark, f"{folder}/settings.yml")) if exists(spark, f"{folder}/settings.yml") else settings.Settings()
    nodes = readers.read_nodes(spark, f"{folder}/node.csv")
    links = numbered(readers.read_links(spark, f"{folder}/link.csv", nodes, cfg))
    names = [m.mode_type for m in cfg.mode_types]
    if "toll_auto" not in links.columns:
        links = links.withColumn("toll_auto", F.lit(0.0))
    queue = exists(spark, f"{folder}/link_qvdf.csv")
    if queue:
        kinds = {"data_type": ("string", None), "vdf_code": ("string", None), "from_node_id": ("long", None), "to_node_id": ("long", None)}
        kept = links.columns
        maps: dict[str, list] = {}
        for p in cfg.periods:
            values = {f"QVDF_{x}{p.demand_period_id}": f"q_{x}" for x in ("alpha", "beta", "cd", "cp", "n", "s")}
            table = readers.read_csv(spark, f"{folder}/link_qvdf.csv", kinds | {k: ("double", None) for k in values}, ("data_type",)).withColumnsRenamed(values)
            links = readers.apply_qvdf(links, table, list(values.values()))
            links = links.withColumnsRenamed({q: f"{q}_{p.demand_period_id}" for q in values.values()})
            for q in values.values():
                maps.setdefault(q, []).extend((F.lit(p.period), c(f"{q}_{p.demand_period_id}")))
        links = links.select(*kept, *(F.create_map(*x).alias(q) for q, x in maps.items()))
    links = lineage.cut(links)
    modes = spark.createDataFrame([(m.mode_type, k, m.vot, m.person_occupancy, m.pce) for k, m in enumerate(cfg.mode_types)], "mode string, mode_no int, vot double, occupancy double, pce double")
    periods = spark.createDataFrame([(p.period, k, p.start_hour, p.end_hour, p.end_hour - p.start_hour) for k, p in enumerate(cfg.periods)], "period string, period_no int, start_hour double, end_hour double, hours double")
    fixed = read_fixed(spark, folder, cfg, links)
    od = read_od(spark, folder, cfg) if not exists(spark, f"{folder}/route.csv") else None
    if od is None:
        od = spark.createDataFrame([], "o long, d long, mode string, period string, volume double") if fixed is not None else synthesised(spark, nodes, cfg)
    od = demand.between_zones(od, nodes)
    if cfg.subarea:
        od = _focused(spark, nodes, od, cfg)
    od = od.select((-c("o")).alias("o"), (-c("d")).alias("d"), "mode", "period", "volume").where("volume > 1e-6")
    rules = loading.Rules(queue, True, {m: f"toll_{m}" for m in names}, {m: f"penalty_{m}" for m in names})
    turns = banned_turns(links)
    banned = None if turns.isEmpty() else lineage.cut(turns)
    return assignment.Inputs(lineage.cut(connected(links, nodes)), modes, periods, lineage.cut(od), 1.0, rules, banned, (names[0],), fixed), nodes, cfg


def _focused(spark: SparkSession, nodes: DataFrame, od: DataFrame, cfg: settings.Settings) -> DataFrame:
    sides = space.polygon_segments(spark.createDataFrame([(cfg.subarea,)], "wkt string").select(scalar.wkt_points(c("wkt")).alias("points")))
    zones = nodes.where("zone_id IS NOT NULL").groupBy("zone_id").agg(F.min(F.struct("node_id", "x", "y")).alias("p")).select("zone_id", "p.x", "p.y")
    ends = od.select("o", "d").distinct()
    ends = ends.join(zones.select(c("zone_id").alias("o"), c("x").alias("ox"), c("y").alias("oy")), "o").join(zones.select(c("zone_id").alias("d"), c("x").alias("dx"), c("y").alias("dy")), "d")
    crossed = space.crossing(ends, sides, ["o", "d"])
    passing = od.join(crossed.where("crosses").select("o", "d"), ["o", "d"], "left_semi")
    cut = demand.volume_cutoff(passing, 1000).first()["cutoff"] or 0.0  # zones beyond the thousandth do not count
    flagged = subarea.flags(space.inside(zones, sides, ["zone_id"]), od, crossed, 1000.0, 5.0, max(5.0, cut))
    return subarea.within(od, subarea.significant(flagged), crossed.where("crosses").select("o", "d"))


def _by_zone(paths: DataFrame) -> DataFrame:
    """Paths with zone numbers, without their connectors."""
    real = F.filter("link_seq", lambda x: x >= 0)
    return paths.withColumns({"o": F.abs("o"), "d": F.abs("d"), "link_seq": real, "path": columns.path_key(real)})


def _closures(spark: SparkSession, inputs: assignment.Inputs, cfg: settings.Settings) -> tuple[assignment.Inputs, DataFrame]:
    """(inputs with the tolls, lanes and signs of traffic management, the links that it closes)."""
    rules = spark.createDataFrame([(m.from_node_id, m.to_node_id, m.dtm_type, m.final_lanes, m.toll) for m in cfg.management], "from_node_id long, to_node_id long, dtm_type string, final_lanes double, toll double")
    links = lineage.cut(scenario.managed(inputs.links, rules))
    return replace(inputs, links=links.drop("closed", "sign")), links.where("closed").select("link_id")


#: Seconds of a step of the simulation of a folder.
STEP_S = 0.25


def simulated(spark: SparkSession, inputs: assignment.Inputs, pool: DataFrame, cfg: settings.Settings) -> DataFrame:
    """Link events (period, agent_id, k, link_id, arrival_s, departure_s) of the pool's vehicles in queues.

    Vehicles leave by the departure profile of their demand file, evenly where it has none. Signals are those of the link file's
    cycle_length, start_green_time and end_green_time.
    """
    known = {(f.mode_type, f.demand_period): cfg.profiles[f.departure_time_profile_no] for f in cfg.demand_files if f.departure_time_profile_no in cfg.profiles}
    parts = []
    for p in cfg.periods:
        mine = pool.where(c("period") == p.period)
        for mode in (m.mode_type for m in cfg.mode_types):
            some = mine.where(c("mode") == mode)
            slots = {k: w for k, w in known.get((mode, p.period), {}).items() if p.start_hour * 12 <= k < p.end_hour * 12}
            if slots and sum(slots.values()) > 0:
                parts.append(simulate.profiled(some, spark.createDataFrame(sorted(slots.items()), "slot int, weight double")))
            else:
                parts.append(simulate.vehicles(some, {p.period: p.start_hour * 60}, (p.end_hour - p.start_hour) * 60))
    links = inputs.links.where("link_type >= 0").withColumns({"cycle_s": c("cycle_length").cast("double"), "green_s": c("start_green_time").cast("double"), "green_len_s": F.greatest(F.lit(0.0), c("end_green_time") - c("start_green_time"))})
    links = links.withColumn("cycle_s", F.when((c("cycle_s") > 0) & (c("green_len_s") > 0), c("cycle_s")).otherwise(0.0))
    return lineage.cut(simulate.simulate(reduce(DataFrame.unionByName, parts), links, step_s=STEP_S))


def emission_rates(spark: SparkSession, cfg: settings.Settings) -> DataFrame:
    """link_type, mode, kind, rate of the settings' emissions_<mode>_<kind>."""
    rows = [(t.link_type, *k.removeprefix("emissions_").rsplit("_", 1), v) for t in cfg.link_types for k, v in t.emissions.items() if len(v) == 4 and k.count("_") >= 2]
    return spark.createDataFrame(rows, "link_type int, mode string, kind string, rate array<double>")


def run(spark: SparkSession, folder: str, out: str | None = None) -> assignment.Result:
    """The analysis that a folder's settings ask for; reports are written under ``out``, one folder each.

    With estimation, five updates come before it, and it takes the counts in the link file's ref_volume. With traffic management, the
    equilibrium before it is the base: informed modes then shift off closed links, and volumes before and after are reported. With
    simulation, the vehicles of the last pool go through queues. o and d in results are zones.
    """
    inputs, _, cfg = load(spark, folder)
    result = assignment.run(inputs, cfg.iterations, 5 if cfg.odme else cfg.updates, cfg.gap_percent)
    if cfg.odme:
        pool, _ = assignment.estimate(inputs, result.pool, estimation.sensors(inputs.links), cfg.odme_iterations)
        result = assignment.Result(pool, assignment.performance(inputs, pool), result.gap_percent)
    reports: dict[str, DataFrame] = {}
    if cfg.management:
        after, closed = _closures(spark, inputs, cfg)
        informed = [m.mode_type for m in cfg.mode_types if m.real_time_info_type > 0]
        base = result
        if not closed.isEmpty():
            reports["impacted_routes"] = columns.impacted(_by_zone(base.pool), closed)
            result = assignment.sensitivity(after, base.pool, closed, informed, cfg.scenario_iterations)
        else:
            result = assignment.update(after, base.pool, cfg.updates, cfg.gap_percent)
        volume = [x.performance.where("link_type >= 0").select("link_id", "period", "volume") for x in (base, result)]
        reports["link_before_after"] = scenario.before_after(*volume)
    pool = _by_zone(result.pool if inputs.fixed is None else result.pool.select(inputs.fixed.columns).unionByName(inputs.fixed))
    result = assignment.Result(lineage.cut(pool), result.performance.where("link_type >= 0"), result.gap_percent)
    if cfg.simulation:
        events = simulated(spark, inputs, result.pool, cfg)
        reports |= {"trips": simulate.trips(events, inputs.links), "trajectories": simulate.trajectories(events), "link_minutes": simulate.minute_counts(events), "link_waits": simulate.minute_waits(events, inputs.links)}
    if out:
        routes = report.route_measures(result.pool, result.performance)
        rates = emission_rates(spark, cfg)
        if not rates.isEmpty():
            each = report.emissions(result.performance, rates)
            reports |= {f"{name}_emissions": report.emitted(result.pool, each, keys) for name, keys in (("link", ["link_id", "period"]), ("route", ["o", "d", "mode", "period", "path"]), ("od", ["o", "d", "mode", "period"]), ("system", ["mode", "period"]))}
        reports |= {
            "link_modes": report.mode_volumes(loading.tally(result.pool, inputs.modes), [m.mode_type for m in cfg.mode_types]),
            "link_performance": report.link_measures(result.performance, loading.tally(result.pool, inputs.modes)),
            "route_assignment": routes,
            "od_performance": report.od_measures(routes),
            "system_performance": report.summed(routes, ["mode", "period"]),
            "link_summary": report.wide_by_mode(loading.tally(result.pool, inputs.modes), result.performance, [p.period for p in cfg.periods], [m.mode_type for m in cfg.mode_types]),
            "access_link": report.access_links(inputs.links),
            "link_two_way": report.two_way(result.performance),
            "turns": report.turns(result.pool),
            "background": report.background(result.pool, 5.0),
        }
        for name, table in reports.items():
            sinks.write(table, f"{out}/{name}")
    return result
