"""Queries on routes, loading, equilibrium, estimation, scenarios and reports, each with SQL that unrolls the rounds."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import columns, estimation, loading, report, routing, scenario
from netloom.plans import assignment, lineage, load
from netloom.plans.catalog import BASE, DEMAND, near, query
from netloom.sources import derive

c = F.col
ROUNDS = 3
SWEEPS = 14
#: Links closed in the scenario.
CLOSED = "link_id % 13 = 0"

_kept: dict[tuple, object] = {}
#: What is kept at most; the oldest goes first.
MOST_KEPT = 24


def _stamp(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """When the tables that demand is made of last changed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [path(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders", "customer", "supplier", "nation")]
    return tuple(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() for p in found)


def _once(name: str, make, spark: SparkSession, sf_dir: str):
    """What several queries start from, made once a session for the tables as they are: a written table, or the inputs."""
    key = (spark.sparkContext.applicationId, name, sf_dir, _stamp(spark, sf_dir))
    if key not in _kept:
        _kept[key] = make()
        while len(_kept) > MOST_KEPT:
            del _kept[next(iter(_kept))]
    return _kept[key]


def _inputs(spark: SparkSession, sf_dir: str) -> assignment.Inputs:
    def make() -> assignment.Inputs:
        i = assignment.sample_inputs(spark, sf_dir)
        return assignment.Inputs(i.links, i.modes, i.periods, lineage.cut(i.demand), i.share)

    return _once("inputs", make, spark, sf_dir)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("pool", lambda: assignment.generate(_inputs(spark, sf_dir), ROUNDS), spark, sf_dir)


def _performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs(spark, sf_dir)
    return _once("perf", lambda: lineage.cut(loading.performance(i.links, i.periods, loading.volumes(loading.tally(_pool(spark, sf_dir), i.modes)))), spark, sf_dir)


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("routes", lambda: lineage.cut(report.route_measures(_pool(spark, sf_dir), _performance(spark, sf_dir))), spark, sf_dir)


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: near(n, digits) for n in names})


_QUEUE = """least(fftt * vf / greatest(0.1::DOUBLE, CASE WHEN doc < 1 THEN vf / (1 + (1.15::DOUBLE * vf / greatest(0.0001::DOUBLE, vc) - 1) * pow(doc, 4)) ELSE vc / (1 + 0.15::DOUBLE * pow(doc, 4)) END), greatest(15::DOUBLE, hours * 90))"""


def _perf_sql(k: str, volume: str | None, queue: bool = False) -> str:
    vol = f"coalesce(v.volume, 0) AS volume FROM link CROSS JOIN period_dim LEFT JOIN {volume} v USING (link_id, period)" if volume else "CAST(0 AS DOUBLE) AS volume FROM link CROSS JOIN period_dim"
    return f""", perf{k} AS MATERIALIZED (SELECT *, {_QUEUE if queue else "fftt * (1 + CAST(0.15 AS DOUBLE) * pow(doc, 4))"} AS minutes FROM (SELECT *, volume / (capacity * CAST({loading.PERIOD_SHARE!r} AS DOUBLE)) AS doc FROM (SELECT link.*, period_dim.*, {vol})))
, cost{k} AS MATERIALIZED (SELECT link_id, from_node_id, to_node_id, mode, period, CAST(round((minutes + CASE WHEN mode = 'auto' THEN toll_auto ELSE 0 END / vot * 60) * 1000000) AS BIGINT) AS cost FROM perf{k} CROSS JOIN mode_type)"""


def _tree_sql(k: str, where: str = "TRUE") -> str:
    """Sweeps over all links; of equal costs the least path text is kept."""
    out = f", t{k}_0 AS MATERIALIZED (SELECT DISTINCT o, o AS node, mode, period, CAST(0 AS BIGINT) AS cost, '' AS path FROM od)"
    for r in range(1, SWEEPS + 1):
        out += f""", t{k}_{r} AS MATERIALIZED (SELECT * FROM (SELECT * FROM t{k}_{r - 1} UNION ALL SELECT o, to_node_id, mode, period, t.cost + l.cost, CASE WHEN path = '' THEN '' ELSE path || ';' END || lpad(CAST(link_id AS VARCHAR), 10, '0')
 FROM t{k}_{r - 1} t JOIN cost{k} l USING (mode, period) WHERE l.from_node_id = node AND ({where})) QUALIFY row_number() OVER (PARTITION BY o, node, mode, period ORDER BY cost, path) = 1)"""
    return out + f", tree{k} AS MATERIALIZED (SELECT o, node AS d, mode, period, cost, path FROM t{k}_{SWEEPS} WHERE o <> node)"


def _volume_sql(name: str, pool: str) -> str:
    return f", step{name} AS MATERIALIZED (SELECT o, d, mode, period, path, volume, CAST(unnest(string_split(path, ';')) AS BIGINT) AS link_id, unnest(range(len(string_split(path, ';')))) AS k FROM {pool}), vol{name} AS MATERIALIZED (SELECT link_id, period, sum(volume) AS volume FROM step{name} GROUP BY link_id, period)"


@lru_cache(maxsize=8)
def _pool_sql(rounds: int, queue: bool = False) -> str:
    """Everything up to the pool after so many rounds: cell demand od, trees, pool{k}, vol{k}."""
    out = f"WITH {BASE} {DEMAND.replace('AS volume FROM cell)', 'AS volume FROM cell WHERE o <> d)')}"
    for k in range(rounds):
        out += _perf_sql(str(k), f"vol{k}" if k else None, queue) + _tree_sql(str(k))
        new = f"SELECT o, d, mode, period, path, volume / {k + 1} AS volume FROM od JOIN tree{k} USING (o, d, mode, period)"
        old = f"SELECT o, d, mode, period, path, volume * {k} / {k + 1} AS volume FROM pool{k} UNION ALL " if k else ""
        out += f", pool{k + 1} AS MATERIALIZED (SELECT o, d, mode, period, path, sum(volume) AS volume FROM ({old}{new}) GROUP BY ALL)" + _volume_sql(str(k + 1), f"pool{k + 1}")
    return out


def _after(sql: str) -> str:
    """SQL after the pool of all rounds, its volumes, and performance and costs with them (perfE, costE)."""
    return _pool_sql(ROUNDS) + _perf_sql("E", f"vol{ROUNDS}") + sql


_P, _V, _S = f"pool{ROUNDS}", f"vol{ROUNDS}", f"step{ROUNDS}"


@query(_pool_sql(1) + " SELECT o, d, mode, period, cost FROM tree0")
def sp_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least free-flow cost between all zones for each mode and period, in millionths of a minute."""
    i = _inputs(spark, sf_dir)
    net = routing.network(assignment.link_costs(i, None))
    return routing.trees(i.demand.select("o", "mode", "period").distinct(), net).select("o", "d", "mode", "period", "cost")


@query(_pool_sql(1) + " SELECT o, d, mode, period, cost FROM tree0")
def sp_labels_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by sweeps of joins."""
    i = _inputs(spark, sf_dir)
    origins = i.demand.select("o", "mode", "period").distinct()
    half = lineage.cut(routing.labels_by_rounds(origins, assignment.link_costs(i, None), 5))
    costs = lineage.cut(assignment.link_costs(i, None))
    links = F.broadcast(costs.select(c("from_node_id").alias("node"), "to_node_id", "mode", "period", c("cost").alias("step")))
    for _ in range(2):
        for _ in range(5):
            moved = half.join(links, ["node", "mode", "period"]).select("o", c("to_node_id").alias("node"), "mode", "period", (c("cost") + c("step")).alias("cost"))
            half = half.unionByName(moved).groupBy("o", "node", "mode", "period").agg(F.min("cost").alias("cost"))
        half = lineage.cut(half)
    return half.where("o <> node").select("o", c("node").alias("d"), "mode", "period", "cost")


@query(_pool_sql(1).split(", t0_0 AS")[0] + _tree_sql("0", "NOT (l.from_node_id % 3 = 0 AND mode = 'truck')") + " SELECT o, d, mode, period, cost, path FROM tree0 JOIN od USING (o, d, mode, period)")
def mode_restricted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of all demand where links are closed to modes that their allowed_uses leave out; cells without a route are left out."""
    i = _inputs(spark, sf_dir)
    net = routing.network(loading.costs(assignment.performance(i, None), i.modes, loading.Rules(restricted=True)))
    return loading.all_or_nothing(i.demand, net).select("o", "d", "mode", "period", "cost", columns.path_key("link_seq").alias("path"))


_ALL_NODES = _pool_sql(1).split(", cell AS")[0] + ", od AS (SELECT node_id AS o, 'auto' AS mode, 'am' AS period FROM node)" + _perf_sql("0", None)


@query(_ALL_NODES + _tree_sql("0") + """ SELECT o, d, cost, path FROM (SELECT a.district_id + 1 AS o, b.district_id + 1 AS d, cost, path, t.o AS x, t.d AS y FROM tree0 t JOIN node a ON a.node_id = t.o JOIN node b ON b.node_id = t.d WHERE a.district_id <> b.district_id)
QUALIFY row_number() OVER (PARTITION BY o, d ORDER BY cost, x, path, y) = 1""")
def connector_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes between districts, each a zone whose connectors lead to all its nodes, by car in the morning."""
    i = _inputs(spark, sf_dir)
    zones = derive.nodes(spark, sf_dir).select("node_id", (c("district_id") + 1).alias("zone_id"))
    perf = loading.performance(load.connected(i.links, zones), i.periods.where("period = 'am'"), None, i.share)
    net = routing.network(loading.costs(perf, i.modes.where("mode = 'auto'")))
    found = routing.trees(zones.select((-c("zone_id")).alias("o"), F.lit("auto").alias("mode"), F.lit("am").alias("period")).distinct(), net)
    return found.where("d < 0").select(F.abs("o").alias("o"), F.abs("d").alias("d"), "cost", columns.path_key(F.filter("link_seq", lambda x: x >= 0)).alias("path"))


def _banned_sql() -> str:
    """Sweeps over links: the least way to each link, none after a link that it may not follow."""
    step = "lpad(CAST(l.link_id AS VARCHAR), 10, '0')"
    out = f", b0 AS MATERIALIZED (SELECT o, l.link_id, to_node_id AS node, cost, {step} AS path FROM od JOIN cost0 l ON l.from_node_id = o AND l.mode = 'auto' AND l.period = 'am')"
    for r in range(1, SWEEPS + 7):
        out += f""", b{r} AS MATERIALIZED (SELECT * FROM (SELECT * FROM b{r - 1} UNION ALL SELECT o, l.link_id, to_node_id, t.cost + l.cost, path || ';' || {step} FROM b{r - 1} t JOIN cost0 l ON l.from_node_id = node AND l.mode = 'auto' AND l.period = 'am'
 WHERE (3 * t.link_id + l.link_id) % 7 <> 0) QUALIFY row_number() OVER (PARTITION BY o, link_id ORDER BY cost, path) = 1)"""
    return out + f" SELECT o, node AS d, cost, path FROM b{SWEEPS + 6} WHERE o <> node QUALIFY row_number() OVER (PARTITION BY o, node ORDER BY cost, path) = 1"


@query(_ALL_NODES + _banned_sql())
def turn_ban_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes from all nodes where a seventh of all turns is banned, by car in the morning."""
    i = _inputs(spark, sf_dir)
    costs = assignment.link_costs(i, None).where("mode = 'auto' AND period = 'am'")
    after = i.links.select(c("from_node_id").alias("to_node_id"), c("link_id").alias("next_link_id"))
    banned = i.links.select("link_id", "to_node_id").join(after, "to_node_id").where("(3 * link_id + next_link_id) % 7 = 0")
    origins = derive.nodes(spark, sf_dir).select(c("node_id").alias("o"), F.lit("auto").alias("mode"), F.lit("am").alias("period"))
    return routing.trees(origins, routing.network(costs, banned=banned)).select("o", "d", "cost", columns.path_key("link_seq").alias("path"))


@query(_pool_sql(2, True) + _perf_sql("E", "vol2", True) + " SELECT link_id, period, round(volume, 4) AS volume, round(minutes, 4) AS minutes, round(doc, 6) AS doc FROM perfE")
def qvdf_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after two rounds of column generation with the queue-based function."""
    i = replace(_inputs(spark, sf_dir), rules=loading.Rules(queue=True))
    perf = assignment.performance(i, assignment.generate(i, 2))
    return _round(_round(perf, 4, "volume", "minutes"), 6, "doc").select("link_id", "period", "volume", "minutes", "doc")


@query(_pool_sql(1) + " SELECT o, d, mode, period, path FROM tree0")
def sp_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs(spark, sf_dir)
    net = routing.network(assignment.link_costs(i, None))
    found = routing.trees(i.demand.select("o", "mode", "period").distinct(), net)
    return found.select("o", "d", "mode", "period", columns.path_key("link_seq").alias("path"))


@query(_pool_sql(1) + " SELECT d AS destination, o AS node, cost FROM tree0 WHERE mode = 'auto' AND period = 'am'")
def reverse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cost from every zone to each destination, by trees of the reversed network."""
    i = _inputs(spark, sf_dir)
    net = routing.network(assignment.link_costs(i, None).where("mode = 'auto' AND period = 'am'"), reverse=True)
    senders = i.demand.where("mode = 'auto' AND period = 'am'").select(c("o").alias("node")).distinct()
    roots = i.links.select(c("to_node_id").alias("o"), F.lit("auto").alias("mode"), F.lit("am").alias("period")).distinct()
    found = routing.trees(roots, net).select(c("o").alias("destination"), c("d").alias("node"), "cost")
    return found.join(F.broadcast(senders), "node", "left_semi")


@query(_pool_sql(1) + " SELECT link_id, period, round(volume, 4) AS volume FROM vol1")
def aon_link_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs(spark, sf_dir)
    net = routing.network(assignment.link_costs(i, None))
    return _round(loading.volumes(loading.tally(loading.all_or_nothing(i.demand, net), i.modes)), 4, "volume")


@query(_pool_sql(1) + ", s AS (SELECT link_id, period, mode, sum(volume) AS v FROM step1 GROUP BY ALL) SELECT link_id, period, mode, round(v, 4) AS vehicles, round(v * occupancy, 4) AS persons, round(v * pce, 4) AS units FROM s JOIN mode_type USING (mode)")
def link_mode_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs(spark, sf_dir)
    net = routing.network(assignment.link_costs(i, None))
    return _round(loading.tally(loading.all_or_nothing(i.demand, net), i.modes), 4, "vehicles", "persons", "units")


@query(_pool_sql(ROUNDS) + f" SELECT link_id, period, round(volume, 4) AS volume FROM {_V} WHERE round(volume, 4) > 0")
def msa_link_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive averages over links alone, three rounds."""
    return _round(assignment.link_based(_inputs(spark, sf_dir), ROUNDS), 4, "volume").where("volume > 0")


@query(_pool_sql(ROUNDS) + f" SELECT o, d, mode, period, path, round(volume, 5) AS volume FROM {_P}")
def path_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_pool(spark, sf_dir), 5, "volume").drop("link_seq", "found")


@query(_pool_sql(ROUNDS) + " SELECT o, d, mode, period, path, row_number() OVER (PARTITION BY o, d, mode, period ORDER BY min(k), path) - 1 AS path_seq_no FROM (" + " UNION ALL ".join(f"SELECT o, d, mode, period, path, {k} AS k FROM tree{k} JOIN od USING (o, d, mode, period)" for k in range(ROUNDS)) + ") GROUP BY o, d, mode, period, path")
def path_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each path in its cell, in the order in which paths were found."""
    return columns.numbered(_pool(spark, sf_dir)).select("o", "d", "mode", "period", "path", "path_seq_no")


@query("WITH " + BASE + " SELECT district_id, string_agg(CAST(zone_id AS VARCHAR), ';' ORDER BY zone_id) AS zones, count(*) AS n_zones FROM node GROUP BY district_id")
def district_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.district_zones(derive.nodes(spark, sf_dir))


_BY_MODE = ", ".join(f"round(coalesce(sum(CASE WHEN s.period = '{p}' AND mode = '{m}' THEN s.volume{f} END), 0), 4) AS {p}_{m}_{n}" for p in ("am", "md", "pm") for m in ("auto", "hov", "truck") for n, f in (("vol", ""), ("pce", " * pce")))
_BY_PERIOD = ", ".join(f"round(max(CASE WHEN period = '{p}' THEN {x} END), {k}) AS {p}_{n}" for p in ("am", "md", "pm") for n, x, k in (("tt", "minutes", 4), ("doc", "doc", 6), ("lanes", "lanes", 1), ("cap", "capacity", 1)))


@query(_after(f", bm AS (SELECT link_id, {_BY_MODE} FROM {_S} s JOIN mode_type USING (mode) GROUP BY link_id), bp AS (SELECT link_id, {_BY_PERIOD} FROM perfE GROUP BY link_id) SELECT bp.*, {', '.join(f'coalesce(bm.{p}_{m}_{n}, 0) AS {p}_{m}_{n}' for p in ('am', 'md', 'pm') for m in ('auto', 'hov', 'truck') for n in ('vol', 'pce'))} FROM bp LEFT JOIN bm USING (link_id)"))
def link_summary_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a link: volumes by period and mode, times, ratios, lanes and capacity by period."""
    tallied = loading.tally(_pool(spark, sf_dir), _inputs(spark, sf_dir).modes)
    out = report.wide_by_mode(tallied, _performance(spark, sf_dir), ["am", "md", "pm"], ["auto", "hov", "truck"])
    by = lambda *ends: [x for x in out.columns if x.endswith(ends)]
    return _round(_round(_round(out, 4, *by("_vol", "_pce", "_tt")), 6, *by("_doc")), 1, *by("_lanes", "_cap"))


@query("WITH " + BASE + " SELECT district_id + 1 AS zone_id, node_id, unnest(['in', 'out']) AS direction FROM node")
def access_link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connectors of districts, each a zone of several nodes."""
    zones = derive.nodes(spark, sf_dir).select("node_id", (c("district_id") + 1).alias("zone_id"))
    return report.access_links(load.connected(_inputs(spark, sf_dir).links, zones))


_COSTED = f", costed AS MATERIALIZED (SELECT p.*, c.cost FROM {_P} p JOIN (SELECT o, d, mode, period, path, sum(cost) AS cost FROM {_S} JOIN costE USING (link_id, mode, period) GROUP BY ALL) c USING (o, d, mode, period, path))"


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs(spark, sf_dir)
    return columns.with_costs(_pool(spark, sf_dir), loading.costs(_performance(spark, sf_dir), i.modes))


@query(_after(_COSTED + """, g AS (SELECT sum(volume) AS v, sum(volume * cost) AS t, min(cost) AS least FROM costed GROUP BY o, d, mode, period)
SELECT round(sum(v), 3) AS demand, round(sum(t) / 1e6, 2) AS total_min, round(sum(v * least) / 1e6, 2) AS least_min, round(greatest(0, (sum(t) - sum(v * least)) / sum(v * least)) * 100, 6) AS gap_percent, round(sum(t) / 1e6 / sum(v), 6) AS mean_min FROM g"""))
def ue_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = columns.gap(_costed(spark, sf_dir))
    return _round(_round(_round(out, 3, "demand"), 2, "total_min", "least_min"), 6, "gap_percent", "mean_min")


@query(_after(_COSTED + """, w AS (SELECT *, sum(volume) OVER cell AS v, min(cost) OVER cell AS least, greatest(1000000, max(cost) OVER cell) AS most, count(*) OVER cell AS n, first_value(path) OVER (PARTITION BY o, d, mode, period ORDER BY cost, path) AS best FROM costed WINDOW cell AS (PARTITION BY o, d, mode, period)),
x AS (SELECT *, CASE WHEN n > 1 THEN least(volume, 0.5::DOUBLE * (cost - least) / most * v) ELSE 0 END AS given FROM w)
SELECT o, d, mode, period, path, round(CASE WHEN path = best THEN volume + sum(given) OVER (PARTITION BY o, d, mode, period) ELSE volume - given END, 5) AS volume FROM x"""))
def column_update_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(columns.shift(_costed(spark, sf_dir), 0), 5, "volume").select("o", "d", "mode", "period", "path", "volume")


_MEASURED = f""", pers AS (SELECT link_id, period, sum(volume * occupancy) AS persons FROM {_S} JOIN mode_type USING (mode) GROUP BY ALL),
meas AS MATERIALIZED (SELECT *, volume * miles AS vmt, persons * miles AS pmt, volume * minutes / 60 AS vht, persons * minutes / 60 AS pht, persons * (minutes - fftt) / 60 AS pdt_vf, greatest(0, persons * (minutes - fftt * vf / greatest(0.001::DOUBLE, vc)) / 60) AS pdt_vc,
 CASE WHEN minutes > 0.001 THEN distance_km / greatest(0.1::DOUBLE, minutes) * 60 ELSE vf END AS speed, CASE WHEN ref_volume > 1 THEN volume - ref_volume END AS ref_diff
 FROM (SELECT perfE.*, coalesce(persons, 0) AS persons, length_m / 1609 AS miles FROM perfE LEFT JOIN pers USING (link_id, period)))"""
_LINK = ["volume", "persons", "doc", "minutes", "speed", "speed_ratio", "vmt", "vkmt", "pmt", "vht", "pht", "pdt_vf", "pdt_vc", "ref_diff"]
_LINK_SQL = ", ".join(f"round({ {'speed_ratio': 'speed / greatest(0.001::DOUBLE, vf)', 'vkmt': 'vmt * 1.609::DOUBLE'}.get(x, x)}, 4) AS {x}" for x in _LINK).replace("round(doc, 4)", "round(doc, 6)")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs(spark, sf_dir)
    return report.link_measures(_performance(spark, sf_dir), loading.tally(_pool(spark, sf_dir), i.modes))


@query(_after(_MEASURED + f" SELECT link_id, period, {_LINK_SQL} FROM meas"))
def link_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: network, routes, loading and volume-delay function, reported by link and period."""
    return _round(_round(_measured(spark, sf_dir), 4, *(x for x in _LINK if x != "doc")), 6, "doc").select("link_id", "period", *_LINK)


@query(_after(_MEASURED + " SELECT round(sum(vmt), 2) AS vmt, round(sum(vht), 3) AS vht, round(sum(vmt) / sum(vht), 4) AS speed_mph, round(avg(abs(ref_diff) / ref_volume * 100), 4) AS ref_mape FROM meas"))
def network_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.network_speed(_measured(spark, sf_dir))
    return _round(_round(_round(out, 2, "vmt"), 3, "vht"), 4, "speed_mph", "ref_mape")


_ROUTES = f""", route AS MATERIALIZED (SELECT o, d, mode, period, path, any_value(s.volume) AS volume, sum(minutes) AS minutes, sum(fftt) AS fftt, sum(greatest(0, minutes - fftt)) AS delay, sum(distance_km) AS km, sum(CASE WHEN mode = 'auto' THEN toll_auto ELSE 0 END) AS toll,
 CAST(o AS VARCHAR) || ';' || string_agg(CAST(to_node_id AS VARCHAR), ';' ORDER BY k) AS node_sequence FROM {_S} s JOIN perfE USING (link_id, period) GROUP BY o, d, mode, period, path)"""


@query(_after(_ROUTES + " SELECT o, d, mode, period, path, node_sequence, round(volume, 4) AS volume, round(minutes, 4) AS minutes, round(fftt, 4) AS fftt, round(delay, 4) AS delay, round(km, 4) AS km, toll FROM route"))
def route_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_routes(spark, sf_dir), 4, "volume", "minutes", "fftt", "delay", "km")


#: Coefficients of emissions by kind, for each link type and mode.
RATES = {"co2": (20785.99999, 0.0002, -0.0042, 0.3412), "nox": (5.53516, 0.00002, -0.0005, 0.03)}
_KG = {k: f"{r[0]!r}::DOUBLE * (fftt / 60 + (minutes - fftt) / 60 * CASE WHEN abs(m - u) > 1 THEN ((u * u * {r[1]!r}::DOUBLE + u * ({r[2]!r}::DOUBLE) + {r[3]!r}::DOUBLE) * m - u) / (m - u) ELSE 0 END) / 1000" for k, r in RATES.items()}
_EMITTED = f", kg AS MATERIALIZED (SELECT link_id, period, {', '.join(f'{x} AS {k}_kg' for k, x in _KG.items())} FROM (SELECT *, vf / 1.609::DOUBLE AS m, vf / 1.609::DOUBLE / greatest(0.00001::DOUBLE, minutes / fftt) / 1.609::DOUBLE AS u FROM perfE))"


def _emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs(spark, sf_dir)
    rates = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in RATES.items()], "kind string, rate array<double>")
    return report.emissions(_performance(spark, sf_dir), i.links.select("link_type").distinct().crossJoin(F.broadcast(i.modes.select("mode"))).crossJoin(F.broadcast(rates)))


@query(_after(_EMITTED + f" SELECT o, d, mode, period, path, round(sum(co2_kg * volume), 4) AS co2_kg, round(sum(nox_kg * volume), 6) AS nox_kg FROM {_S} JOIN kg USING (link_id, period) GROUP BY o, d, mode, period, path"))
def route_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilograms that the vehicles of each path emit."""
    out = report.emitted(_pool(spark, sf_dir), _emissions(spark, sf_dir), ["o", "d", "mode", "period", "path"])
    return _round(_round(out, 4, "co2_kg"), 6, "nox_kg")


@query(_after(_EMITTED + f" SELECT mode, period, round(sum(co2_kg * volume), 2) AS co2_kg, round(sum(nox_kg * volume), 4) AS nox_kg FROM {_S} JOIN kg USING (link_id, period) GROUP BY mode, period"))
def system_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.emitted(_pool(spark, sf_dir), _emissions(spark, sf_dir), ["mode", "period"])
    return _round(_round(out, 2, "co2_kg"), 4, "nox_kg")


@query(_pool_sql(ROUNDS) + f" SELECT link_id, period, {', '.join(f"round(coalesce(sum(CASE WHEN mode = '{m}' THEN volume{f} END), 0), 4) AS {m}_{n}" for m in ('auto', 'hov', 'truck') for n, f in (('vehicles', ''), ('persons', ' * occupancy')))} FROM {_S} JOIN mode_type USING (mode) GROUP BY link_id, period")
def link_modes_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles and persons of each mode on each link, in columns."""
    out = report.mode_volumes(loading.tally(_pool(spark, sf_dir), _inputs(spark, sf_dir).modes), ["auto", "hov", "truck"])
    return _round(out, 4, *(x for x in out.columns if x.endswith(("vehicles", "persons"))))


_MEANS = ", ".join(f"round(sum({x} * volume) / sum(volume), 4) AS mean_{x}" for x in ("minutes", "km", "delay"))


@query(_after(_ROUTES + f" SELECT o, d, mode, period, round(sum(volume), 4) AS volume, count(*) AS paths, {_MEANS}, round(min(minutes), 4) AS least_minutes FROM route GROUP BY o, d, mode, period"))
def od_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(report.od_measures(_routes(spark, sf_dir)), 4, "volume", "mean_minutes", "mean_km", "mean_delay", "least_minutes")


_SUMS = "count(*) AS routes, round(sum(volume), 3) AS volume, " + ", ".join(f"round(sum({x} * volume), 1) AS total_{x}, round(sum({x} * volume) / greatest(0.001::DOUBLE, sum(volume)), 4) AS mean_{x}" for x in ("km", "minutes", "delay")) + ", round((sum(km * volume) / sum(volume)) / (sum(minutes * volume) / sum(volume) / 60), 4) AS speed_kmph"


def _sums(df: DataFrame) -> DataFrame:
    return _round(_round(_round(df, 3, "volume"), 1, "total_km", "total_minutes", "total_delay"), 4, "mean_km", "mean_minutes", "mean_delay", "speed_kmph")


@query(_after(_ROUTES + f" SELECT district_id, mode, period, {_SUMS} FROM route JOIN node ON o = zone_id GROUP BY district_id, mode, period"))
def district_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = derive.nodes(spark, sf_dir).select(c("zone_id").alias("o"), "district_id")
    return _sums(report.summed(_routes(spark, sf_dir).join(F.broadcast(zones), "o"), ["district_id", "mode", "period"]))


@query(_after(_ROUTES + f" SELECT mode, period, {_SUMS} FROM route GROUP BY mode, period"))
def system_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(report.summed(_routes(spark, sf_dir), ["mode", "period"]))


_WIDE = ", ".join(f"round(max(CASE WHEN period = '{p}' THEN {x} END), {6 if x == "doc" else 4}) AS {p}_{x}" for p in ("am", "md", "pm") for x in ("volume", "doc", "minutes"))


@query(_after(f" SELECT link_id, {_WIDE} FROM perfE GROUP BY link_id"))
def link_summary_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.wide_links(_performance(spark, sf_dir), ["am", "md", "pm"])
    return _round(_round(out, 4, *(x for x in out.columns if x.endswith(("volume", "minutes")))), 6, *(x for x in out.columns if x.endswith("doc")))


@query(_after(" SELECT p.from_node_id AS a, p.to_node_id AS b, period, round(p.volume, 4) AS ab_volume, round(p.minutes, 4) AS ab_minutes, round(q.volume, 4) AS ba_volume, round(q.minutes, 4) AS ba_minutes FROM perfE p JOIN perfE q USING (period) WHERE p.from_node_id < p.to_node_id AND q.from_node_id = p.to_node_id AND q.to_node_id = p.from_node_id"))
def link_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(report.two_way(_performance(spark, sf_dir)), 4, "ab_volume", "ab_minutes", "ba_volume", "ba_minutes")


@query(_pool_sql(ROUNDS) + f" SELECT a.link_id, b.link_id AS next_link_id, a.period, round(sum(a.volume), 4) AS volume FROM {_S} a JOIN {_S} b USING (o, d, mode, period, path) WHERE a.mode = 'auto' AND b.k = a.k + 1 GROUP BY ALL")
def turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(report.turns(_pool(spark, sf_dir)), 4, "volume")


@query(_pool_sql(ROUNDS) + f" SELECT period, mode, count(*) FILTER (volume > 5) AS major_paths, round(coalesce(sum(volume) FILTER (volume > 5), 0), 3) AS major_volume, count(*) FILTER (volume <= 5) AS minor_paths, round(coalesce(sum(volume) FILTER (volume <= 5), 0), 3) AS minor_volume FROM {_P} GROUP BY period, mode")
def background_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(report.background(_pool(spark, sf_dir), 5.0), 3, "major_volume", "minor_volume")


@query(_pool_sql(1) + " SELECT (SELECT count(*) FROM od) AS cells, (SELECT count(*) FROM od JOIN tree0 USING (o, d, mode, period)) AS connected")
def od_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with demand, and those that have a route."""
    i = _inputs(spark, sf_dir)
    net = routing.network(assignment.link_costs(i, None))
    routed = routing.trees(i.demand.select("o", "mode", "period").distinct(), net).select("o", "d", "mode", "period", F.lit(1).alias("r"))
    return i.demand.join(routed, ["o", "d", "mode", "period"], "left").agg(F.count("*").alias("cells"), F.count("r").alias("connected"))


_DEV = f", dev AS MATERIALIZED (SELECT link_id, p.period, observed, coalesce(v.volume, 0) AS estimated, coalesce(v.volume, 0) - observed AS deviation FROM (SELECT link_id, ref_volume AS observed FROM link WHERE ref_volume >= 1) CROSS JOIN (SELECT DISTINCT period FROM {_P}) p LEFT JOIN {_V} v USING (link_id, period))"
_STEP = f""", felt AS (SELECT o, d, mode, period, path, sum(deviation) AS g FROM {_S} JOIN dev USING (link_id, period) GROUP BY ALL),
fitted AS MATERIALIZED (SELECT o, d, mode, period, path, CASE WHEN g IS NULL THEN volume ELSE greatest(0, volume - greatest(-0.1::DOUBLE * volume, least(0.1::DOUBLE * volume, g / 2))) END AS volume FROM {_P} LEFT JOIN felt USING (o, d, mode, period, path))"""


def _deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimation.deviations(_pool(spark, sf_dir), estimation.sensors(_inputs(spark, sf_dir).links))


@query(_pool_sql(ROUNDS) + _DEV + " SELECT link_id, period, observed, round(estimated, 4) AS estimated, round(deviation, 4) AS deviation FROM dev")
def odme_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_deviations(spark, sf_dir), 4, "estimated", "deviation")


@query(_pool_sql(ROUNDS) + _DEV + _STEP + " SELECT o, d, mode, period, path, round(volume, 5) AS volume FROM fitted")
def odme_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(estimation.step(_pool(spark, sf_dir), _deviations(spark, sf_dir), 0), 5, "volume").select("o", "d", "mode", "period", "path", "volume")


@query(_pool_sql(ROUNDS) + _DEV + _STEP + f"""{_volume_sql("F", "fitted")}, dev2 AS (SELECT d.link_id, d.period, observed, coalesce(v.volume, 0) - observed AS deviation FROM dev d LEFT JOIN volF v USING (link_id, period))
SELECT n AS round, count(*) AS sensors, round(avg(abs(deviation)), 4) AS mae, round(avg(abs(deviation) / greatest(1, observed) * 100), 4) AS mape, round(avg(deviation / greatest(1, observed) * 100), 4) AS mpe FROM (SELECT 0 AS n, observed, deviation FROM dev UNION ALL SELECT 1, observed, deviation FROM dev2) GROUP BY n""")
def odme_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors against counts before and after one step."""
    sensors = estimation.sensors(_inputs(spark, sf_dir).links)
    before = lineage.cut(_deviations(spark, sf_dir))
    after = estimation.deviations(estimation.step(_pool(spark, sf_dir), before, 0), sensors)
    out = estimation.metrics(before).withColumn("round", F.lit(0)).unionByName(estimation.metrics(after).withColumn("round", F.lit(1)))
    return _round(out, 4, "mae", "mape", "mpe")


_HIT = f", hit AS MATERIALIZED (SELECT o, d, mode, period, path, volume, len(list_filter(string_split(path, ';'), lambda x: CAST(x AS BIGINT) % 13 = 0)) AS closed_links FROM {_P}), imp AS (SELECT *, closed_links > 0 AS path_impacted, max(closed_links) OVER (PARTITION BY o, d, mode, period) > 0 AS od_impacted FROM hit)"


def _impacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.impacted(_pool(spark, sf_dir), _inputs(spark, sf_dir).links.where(CLOSED).select("link_id"))


@query(_pool_sql(ROUNDS) + _HIT + " SELECT mode, period, od_impacted, path_impacted, count(*) AS paths, round(sum(volume), 3) AS volume, CAST(sum(closed_links) AS BIGINT) AS closed_links FROM imp GROUP BY ALL")
def impacted_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by whether they, or others of their cell, use a closed link."""
    out = _impacted(spark, sf_dir).groupBy("mode", "period", "od_impacted", "path_impacted").agg(F.count("*").alias("paths"), F.sum("volume").alias("volume"), F.sum("closed_links").cast("long").alias("closed_links"))
    return _round(out, 3, "volume")


_REROUTE = ", costC AS MATERIALIZED (SELECT * FROM costE)" + _tree_sql("C", "link_id % 13 <> 0") + _HIT


def _rerouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs(spark, sf_dir)
    costs = loading.costs(_performance(spark, sf_dir), i.modes).withColumn("cost", F.when(F.expr(CLOSED), -1).otherwise(c("cost")))
    return _once("closed-trees", lambda: lineage.cut(routing.trees(i.demand.select("o", "mode", "period").distinct(), routing.network(costs))), spark, sf_dir)


@query(_after(_REROUTE + f""", kept AS MATERIALIZED (SELECT o, d, mode, period, path, volume FROM imp WHERE NOT path_impacted UNION ALL SELECT i.o, i.d, i.mode, i.period, t.path, i.volume FROM imp i JOIN treeC t USING (o, d, mode, period) WHERE path_impacted)
{_volume_sql("K", "kept")} SELECT link_id, period, round(coalesce(a.volume, 0), 4) AS before, round(coalesce(b.volume, 0), 4) AS after, round(coalesce(b.volume, 0) - coalesce(a.volume, 0), 4) AS change FROM {_V} a FULL JOIN volK b USING (link_id, period)"""))
def closure_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link volumes before and after closures, when all that used a closed link takes the best open route."""
    i = _inputs(spark, sf_dir)
    paths = _impacted(spark, sf_dir).select("o", "d", "mode", "period", "volume", "link_seq", "path_impacted")
    moved = paths.where("path_impacted").drop("link_seq").join(_rerouted(spark, sf_dir), ["o", "d", "mode", "period"]).select("o", "d", "mode", "period", "volume", "link_seq")
    after = paths.where("NOT path_impacted").drop("path_impacted").unionByName(moved)
    out = scenario.before_after(loading.volumes(loading.tally(_pool(spark, sf_dir), i.modes)), loading.volumes(loading.tally(after, i.modes)))
    return _round(out, 4, "before", "after", "change")


@query(_after(_REROUTE + _ROUTES + """, dm AS (SELECT i.o, i.d, i.mode, i.period, i.path, i.volume, r.minutes, t.cost / 1e6 AS alt FROM imp i JOIN route r USING (o, d, mode, period, path) JOIN treeC t USING (o, d, mode, period) WHERE path_impacted)
SELECT o, d, mode, period, path, round(volume / (1 + exp(-0.1::DOUBLE * (minutes - alt))), 4) AS diverted, CASE WHEN minutes - alt > 3 AND minutes - alt > 0.15::DOUBLE * minutes THEN round(volume, 4) ELSE 0 END AS uninformed, round(volume - volume / (1 + exp(-0.1::DOUBLE * (minutes - alt))), 4) AS staying FROM dm"""))
def dms_diversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume of impacted paths that a message sign diverts to the best open route, by logit."""
    hit = _impacted(spark, sf_dir).where("path_impacted").select("o", "d", "mode", "period", "path")
    paths = _routes(spark, sf_dir).join(hit, ["o", "d", "mode", "period", "path"])
    out = scenario.diverted(paths, _rerouted(spark, sf_dir).select("o", "d", "mode", "period", (c("cost") / routing.MICRO).alias("alt_minutes")))
    return _round(out, 4, "diverted", "uninformed", "staying").select("o", "d", "mode", "period", "path", "diverted", "uninformed", "staying")


@query(_after(", chain AS (SELECT a.o AS home, a.path || ';' || b.path AS path FROM tree0 a JOIN tree0 b ON a.d = b.o AND b.d = a.o AND a.mode = b.mode AND a.period = b.period WHERE a.mode = 'auto' AND a.period = 'am' AND a.d = 13 AND a.o <> 13) SELECT home, path FROM chain"))
def chained_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of there-and-back chains to the middle of the network, one after the other."""
    i = _inputs(spark, sf_dir)
    net = routing.network(assignment.link_costs(i, None))
    found = routing.trees(i.demand.select("o", "mode", "period").where("mode = 'auto' AND period = 'am'").distinct(), net)
    there = found.where("d = 13").select(c("o").alias("chain"), F.lit(0).alias("leg"), "link_seq")
    back = found.where("o = 13").select(c("d").alias("chain"), F.lit(1).alias("leg"), "link_seq")
    both = there.unionByName(back.join(there.select("chain"), "chain", "left_semi")).join(back.select("chain"), "chain", "left_semi")
    return scenario.chained(both).select(c("chain").alias("home"), columns.path_key("link_seq").alias("path"))


@query(_pool_sql(ROUNDS) + f" SELECT link_id, period, string_agg(next || ':' || printf('%.3f', v), ';' ORDER BY next) AS turns FROM (SELECT a.link_id, b.link_id AS next, a.period, sum(a.volume) AS v FROM {_S} a JOIN {_S} b USING (o, d, mode, period, path) WHERE a.mode = 'auto' AND b.k = a.k + 1 GROUP BY ALL) GROUP BY link_id, period")
def turn_volumes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each link in one field."""
    return report.turn_text(report.turns(_pool(spark, sf_dir)))


@query(_after(f", costS AS MATERIALIZED (SELECT * FROM costE){_COSTED} SELECT mode, period, round(sum(volume * cost) / 1e6, 3) AS minutes, count(*) AS paths FROM costed GROUP BY mode, period"))
def pool_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle minutes at generalised cost by mode and period."""
    out = _costed(spark, sf_dir).groupBy("mode", "period").agg((F.sum(c("volume") * c("cost")) / routing.MICRO).alias("minutes"), F.count("*").alias("paths"))
    return _round(out, 3, "minutes")
