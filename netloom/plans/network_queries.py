"""Queries on networks, demand, geometry and formulas, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import scalar, vdf
from netloom.operators import demand as dm
from netloom.operators import generate, space
from netloom.plans import lineage
from netloom.plans.catalog import near, net, net_od, net_probe, query
from netloom.sources import derive, readers, settings

c = F.col


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: near(n, digits) for n in names})


def _demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.between_zones(derive.demand(spark, sf_dir), derive.nodes(spark, sf_dir))


@query(net("SELECT node_id, zone_id, district_id, round(x, 6) AS x, round(y, 6) AS y FROM node"))
def net_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(derive.nodes(spark, sf_dir), "x", "y")


@query(net("SELECT link_id, from_node_id, to_node_id, link_type, lanes, capacity, round(length_m, 6) AS length_m, round(vf, 6) AS vf, round(vc, 6) AS vc, round(fftt, 6) AS fftt, round(spatial_capacity, 6) AS spatial_capacity, toll_auto, ref_volume, allowed_uses FROM link"))
def net_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(derive.links(spark, sf_dir), "length_m", "vf", "vc", "fftt", "spatial_capacity")
    return out.select("link_id", "from_node_id", "to_node_id", "link_type", "lanes", "capacity", "length_m", "vf", "vc", "fftt", "spatial_capacity", "toll_auto", "ref_volume", "allowed_uses")


@query(net("""SELECT from_node_id, to_node_id, kind FROM (SELECT from_node_id, to_node_id, 'road' AS kind FROM link UNION ALL SELECT -zone_id, node_id, 'connector' FROM node UNION ALL SELECT node_id, -zone_id, 'connector' FROM node)"""))
def zone_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads and the two-way connectors of each zone's centroid, whose node number is the zone's, negated."""
    nodes = derive.nodes(spark, sf_dir)
    to_road = nodes.select((-c("zone_id")).alias("from_node_id"), c("node_id").alias("to_node_id"), F.lit("connector").alias("kind"))
    back = nodes.select(c("node_id").alias("from_node_id"), (-c("zone_id")).alias("to_node_id"), F.lit("connector").alias("kind"))
    return derive.links(spark, sf_dir).select("from_node_id", "to_node_id", F.lit("road").alias("kind")).unionByName(to_road).unionByName(back)


@query(net("SELECT link_type, count(*) AS links, round(avg(vf), 6) AS mean_speed, round(sum(distance_km * lanes), 6) AS lane_km, round(sum(capacity), 6) AS capacity FROM link GROUP BY link_type"))
def link_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive.links(spark, sf_dir).groupBy("link_type").agg(F.count("*").alias("links"), F.avg("vf").alias("mean_speed"), F.sum(c("distance_km") * c("lanes")).alias("lane_km"), F.sum("capacity").alias("capacity"))
    return rounded(out, "mean_speed", "lane_km", "capacity")


@query(net("""SELECT mode, period, count(*) AS links, round(sum(distance_km), 6) AS km FROM link, mode_type, period_dim
WHERE allowed_uses IN ('', 'null', 'all') OR contains(allowed_uses, mode) GROUP BY mode, period"""))
def mode_period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that each mode may use in each period."""
    met = derive.links(spark, sf_dir).crossJoin(F.broadcast(derive.modes(spark))).crossJoin(F.broadcast(derive.periods(spark)))
    out = met.where(scalar.allow_mode(c("allowed_uses"), c("mode"))).groupBy("mode", "period").agg(F.count("*").alias("links"), F.sum("distance_km").alias("km"))
    return rounded(out, "km")


@query(net_od("SELECT o, d, round(sum(volume), 6) AS volume FROM od WHERE o <> d GROUP BY o, d"))
def od_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_demand(spark, sf_dir).groupBy("o", "d").agg(F.sum("volume").alias("volume")), "volume")


@query(net_od("SELECT o, d, mode, period, round(volume, 6) AS volume FROM od WHERE o <> d"))
def od_demand_mode_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_demand(spark, sf_dir), "volume")


@query(net_od("SELECT o, mode, period, round(sum(volume), 4) AS volume FROM od WHERE o <> d GROUP BY GROUPING SETS ((mode, period), (o), ())"))
def od_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dm.totals(_demand(spark, sf_dir)), "volume", digits=4)


@query(net_od("SELECT o, d, round(sum(volume), 6) AS volume FROM od WHERE o <> d GROUP BY o, d ORDER BY 3 DESC, o, d LIMIT 100"))
def od_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.top_cells(_demand(spark, sf_dir))


@query(net_od("""SELECT zone, side, count(*) AS rows, round(sum(volume), 6) AS volume
FROM (SELECT o AS zone, 'origin' AS side, volume FROM od UNION ALL SELECT d, 'destination', volume FROM od) WHERE zone > 20 GROUP BY zone, side"""))
def demand_missing_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand that names a zone above 20 when only zones up to 20 are known."""
    return rounded(dm.missing_zones(derive.demand(spark, sf_dir), derive.nodes(spark, sf_dir).where("zone_id <= 20")), "volume")


@query(net_od("""SELECT o, d, round(sum(volume * 0.5 * coalesce(CASE WHEN a.district_id = 0 AND b.district_id = 1 THEN 3.0 END, CASE WHEN b.district_id = 2 THEN 2.0 END, CASE WHEN a.district_id = 3 THEN 1.5 END, 1.0)), 6) AS volume
FROM od JOIN node a ON o = a.zone_id JOIN node b ON d = b.zone_id WHERE o <> d GROUP BY o, d"""))
def demand_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand times a file factor of 0.5 and district factors: of the pair, else the destination, else the origin."""
    zones = derive.nodes(spark, sf_dir)
    od = _demand(spark, sf_dir).join(F.broadcast(zones.select(c("zone_id").alias("o"), c("district_id").alias("o_district"))), "o").join(F.broadcast(zones.select(c("zone_id").alias("d"), c("district_id").alias("d_district"))), "d")
    origin = spark.createDataFrame([(3, 1.5)], "o_district long, o_factor double")
    destination = spark.createDataFrame([(2, 2.0)], "d_district long, d_factor double")
    both = spark.createDataFrame([(0, 1, 3.0)], "o_district long, d_district long, od_factor double")
    out = dm.scaled(od, 0.5, origin, destination, both).groupBy("o", "d").agg(F.sum("volume").alias("volume"))
    return rounded(out, "volume")


_PROFILE = "slots AS (SELECT CAST(s AS INTEGER) AS slot, coalesce(n, 0) AS n FROM range(0, 288) r(s) LEFT JOIN (SELECT (hour(ts) * 60 + minute(ts)) // 5 AS k, count(*) AS n FROM events GROUP BY 1) ON s = k), prof AS (SELECT slot, n / sum(n) OVER () AS ratio, sum(n) OVER (ORDER BY slot) / sum(n) OVER () AS cum_ratio FROM slots)"


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.floor((F.hour("ts") * 60 + F.minute("ts")) / dm.SLOT_MIN).cast("int")
    counted = derive.table(spark, sf_dir, "events").groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    every = spark.range(288).select(c("id").cast("int").alias("slot"))
    return dm.profile(every.join(counted, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("weight")))


@query(f"WITH {_PROFILE} SELECT slot, round(ratio, 6) AS ratio, round(cum_ratio, 6) AS cum_ratio FROM prof")
def departure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of 5-minute slots of the day, and their running sum."""
    return rounded(_profile(spark, sf_dir), "ratio", "cum_ratio")


@query(f"""WITH {_PROFILE}, u AS (SELECT slot, ratio, sum(ratio) OVER (ORDER BY slot) AS upper, sum(ratio) OVER (ORDER BY slot) - ratio AS lower FROM prof),
agent AS (SELECT zone, v, CAST(v AS DOUBLE) / n AS r FROM (SELECT n_nationkey + 1 AS zone, 10 + n_nationkey AS n, unnest(range(0, 10 + n_nationkey)) AS v FROM nation))
SELECT CAST(zone AS BIGINT) AS zone, CAST(v AS INTEGER) AS v, round((slot + (r - lower) / ratio) * 5 + 1e-7, 4) AS departure_min FROM agent JOIN u ON r >= lower AND r < upper WHERE v > 0""")
def departure_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departure minutes of 10 to 34 agents of each zone but its first, which leaves with the first slot that has a share."""
    cells = derive.nodes(spark, sf_dir).select(c("zone_id").alias("zone"), (c("zone_id") + 9).alias("n"))
    return dm.departures(cells, _profile(spark, sf_dir)).where("v > 0").select("zone", "v", near(c("departure_min") + 1e-7, 4).alias("departure_min"))


_TIMES = ["0700", "0800", "0730:30", "010615", "2359:59", "0000", "0915:15:500"]


@query("""SELECT t AS code, round(CASE WHEN len(h) = 6 THEN CAST(h[1:2] AS INTEGER) * 1440 ELSE 0 END + CAST(k[1:2] AS INTEGER) * 60 + CAST(k[3:4] AS INTEGER)
 + coalesce(CAST(p[2] AS INTEGER), 0) / CAST(60 AS DOUBLE) + coalesce(CAST(p[3] AS INTEGER), 0) / CAST(1000 AS DOUBLE), 6) AS minutes
FROM (SELECT t, string_split(t, ':') AS p, string_split(t, ':')[1] AS h, right(string_split(t, ':')[1], 4) AS k FROM (VALUES ('0700'), ('0800'), ('0730:30'), ('010615'), ('2359:59'), ('0000'), ('0915:15:500')) v(t))""")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([(t,) for t in _TIMES], "code string")
    return codes.select("code", near(scalar.time_to_min(c("code")), 6).alias("minutes"))


@query("""SELECT event_id, printf('%02d%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock
FROM (SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 AS ms FROM events)""")
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 60.0
    return derive.table(spark, sf_dir, "events").select("event_id", scalar.min_to_time(minutes).alias("clock"))


@query(net("""SELECT node_id, CAST(abs(floor(x / 0.1::DOUBLE)) * 0.1::DOUBLE * 1e12 AS BIGINT) + CAST(trunc(abs(floor(y / 0.1::DOUBLE)) * 0.1::DOUBLE * 1e5) AS BIGINT) AS cell_id,
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((floor(x / 0.1::DOUBLE) - floor(-90.0::DOUBLE / 0.1::DOUBLE)) % 26 + 1 AS INTEGER), 1) || CAST(CAST(ceil(40.2::DOUBLE / 0.1::DOUBLE) - floor(y / 0.1::DOUBLE) AS BIGINT) AS VARCHAR) AS cell_code FROM node"""))
def cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derive.nodes(spark, sf_dir)
    return nodes.select("node_id", scalar.cell_id(c("x"), c("y"), 0.1).alias("cell_id"), scalar.cell_code(c("x"), c("y"), 0.1, F.lit(-90.0), F.lit(40.2)).alias("cell_code"))


_METRES = "2 * asin(sqrt(least(1, pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2)))) * CAST(6372797.56 AS DOUBLE)"
_AB = _METRES.format(x1="a.x", y1="a.y", x2="b.x", y2="b.y")


@query(net(f"SELECT a.zone_id AS o, b.zone_id AS d, round({_AB}, 3) AS metres, round({_AB} / (30 * 1609 / CAST(60 AS DOUBLE)), 4) AS minutes FROM node a JOIN node b ON a.zone_id <> b.zone_id"))
def haversine_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.accessibility(derive.nodes(spark, sf_dir)).select("o", "d", "metres", near("minutes", 4).alias("minutes"))


@query(net(f"SELECT zone_id, seed, metres FROM (SELECT a.zone_id, b.zone_id AS seed, round({_AB}, 3) AS metres, row_number() OVER (PARTITION BY a.zone_id ORDER BY round({_AB}, 3), b.zone_id) AS k FROM node a, node b WHERE b.zone_id % 6 = 1) WHERE k = 1"))
def nearest_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest district seed of each zone."""
    zones = derive.nodes(spark, sf_dir)
    seeds = zones.where("zone_id % 6 = 1").select(c("zone_id").alias("seed"), c("x").alias("sx"), c("y").alias("sy"))
    return space.nearest(zones, seeds, "zone_id", "seed")


@query(net(f"""SELECT zone_id, node_id, metres, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY banded DESC, metres, node_id) AS rank, bool_or(banded) OVER (PARTITION BY zone_id) AS near_any
 FROM (SELECT *, metres >= 1000 AND metres <= 6000 AS banded FROM (SELECT a.zone_id, b.node_id, round({_AB}, 3) AS metres FROM node a, node b)))
WHERE (banded AND rank <= 4) OR (NOT near_any AND rank = 1)"""))
def access_links_k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four nodes between 1 and 6 km of each zone, else the nearest."""
    zones = derive.nodes(spark, sf_dir)
    return space.access(zones, zones, 4, 1000.0, 6000.0)


@query(net(f"""SELECT o, d, round(p * q / near, 4) AS volume FROM (
 SELECT o, d, p, q, sum(CASE WHEN minutes < 40 THEN q ELSE 0 END) OVER (PARTITION BY o) AS near
 FROM (SELECT a.zone_id AS o, b.zone_id AS d, 100.0::DOUBLE * a.zone_id AS p, 50.0::DOUBLE * b.zone_id AS q, round({_AB}, 3) / (30 * 1609 / CAST(60 AS DOUBLE)) AS minutes FROM node a JOIN node b ON a.zone_id <> b.zone_id)) WHERE near > 0"""))
def gravity_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = derive.nodes(spark, sf_dir).withColumn("production", 100.0 * c("zone_id")).withColumn("attraction", 50.0 * c("zone_id"))
    return rounded(generate.gravity(generate.accessibility(zones), zones), "volume", digits=4)


@query(net("SELECT a.zone_id AS o, b.zone_id AS d, printf('LINESTRING (%.6f %.6f, %.6f %.6f)', a.x, a.y, b.x, b.y) AS geometry FROM node a JOIN node b ON a.zone_id <> b.zone_id"))
def desire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.desire_lines(generate.accessibility(derive.nodes(spark, sf_dir)))


@query(net("""SELECT ix, iy, count(*) AS nodes, round(avg(x), 6) AS x, round(avg(y), 6) AS y, CAST(row_number() OVER (ORDER BY ix, iy) AS INTEGER) AS zone_id
FROM (SELECT CAST(floor(x / CAST(0.05 AS DOUBLE)) AS BIGINT) AS ix, CAST(floor(y / CAST(0.05 AS DOUBLE)) AS BIGINT) AS iy, x, y FROM node) GROUP BY ix, iy"""))
def grid_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones made from a grid over the nodes; a box of 0.2 degrees over 8 cells gives the next resolution above 0.025."""
    return rounded(generate.grid_zones(derive.nodes(spark, sf_dir)), "x", "y").select("ix", "iy", "nodes", "x", "y", "zone_id")


POLYGON = "POLYGON((-89.96 40.04, -89.84 40.04, -89.84 40.16, -89.96 40.16, -89.96 40.04))"
_IN = "(n.x > -89.96 AND n.x < -89.84 AND n.y > 40.04 AND n.y < 40.16)"


def _segments(spark: SparkSession) -> DataFrame:
    return space.polygon_segments(spark.createDataFrame([(POLYGON,)], "wkt string").select(scalar.wkt_points(c("wkt")).alias("points")))


@query(f"SELECT 'POLYGON' AS kind, CAST(unnest([1,2,3,4]) AS INTEGER) AS side, unnest([-89.96::DOUBLE, -89.84, -89.84, -89.96]) AS x1, unnest([40.04::DOUBLE, 40.04, 40.16, 40.16]) AS y1")
def wkt_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of a polygon in well-known text."""
    kind = spark.createDataFrame([(POLYGON,)], "wkt string").select(scalar.wkt_kind(c("wkt")).alias("kind"))
    return kind.crossJoin(_segments(spark).withColumn("side", F.row_number().over(Window.orderBy(F.when(c("y1") < 40.1, c("x1")).otherwise(-c("x1")+1000))))).select("kind", "side", "x1", "y1")


@query(net(f"SELECT node_id, {_IN} AS inside FROM node n"))
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.inside(derive.nodes(spark, sf_dir), _segments(spark), ["node_id"])


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = derive.nodes(spark, sf_dir)
    a = zones.select(c("zone_id").alias("o"), c("x").alias("ox"), c("y").alias("oy"))
    b = zones.select(c("zone_id").alias("d"), c("x").alias("dx"), c("y").alias("dy"))
    return space.crossing(a.crossJoin(F.broadcast(b)).where("o <> d"), _segments(spark), ["o", "d"])


_SIDES = "side(x1, y1, x2, y2) AS (VALUES (-89.96::DOUBLE, 40.04::DOUBLE, -89.84::DOUBLE, 40.04::DOUBLE), (-89.84, 40.04, -89.84, 40.16), (-89.84, 40.16, -89.96, 40.16), (-89.96, 40.16, -89.96, 40.04))"
_CROSSED = f""", {_SIDES}, crossed AS (SELECT o, d, bool_or(((bx-ax)*(y1-ay)-(b_y-ay)*(x1-ax)) * ((bx-ax)*(y2-ay)-(b_y-ay)*(x2-ax)) <= 0
 AND ((x2-x1)*(ay-y1)-(y2-y1)*(ax-x1)) * ((x2-x1)*(b_y-y1)-(y2-y1)*(bx-x1)) <= 0) AS crosses
 FROM (SELECT a.zone_id AS o, b.zone_id AS d, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM node a JOIN node b ON a.zone_id <> b.zone_id), side GROUP BY o, d)"""


@query(net(f"{_CROSSED} SELECT o, d, crosses FROM crossed"))
def od_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the straight line of an OD pair crosses the subarea's border."""
    return _crossed(spark, sf_dir)


@query(net_od(f"""{_CROSSED}, flag AS (SELECT zone_id, {_IN} AS inside FROM node n),
vol AS (SELECT o, d, sum(volume) AS v FROM od WHERE o <> d GROUP BY o, d),
per AS (SELECT f.zone_id, f.inside, coalesce(sum(CASE WHEN f.inside THEN v WHEN crosses THEN v END), 0) AS volume FROM flag f LEFT JOIN vol ON vol.o = f.zone_id LEFT JOIN crossed USING (o, d) GROUP BY f.zone_id, f.inside)
SELECT zone_id, inside, round(volume, 4) AS volume, CASE WHEN inside AND volume >= 1000 THEN 3 WHEN inside THEN 4 WHEN volume < 5 THEN 0 WHEN volume < 200 THEN 1 ELSE 2 END AS flag FROM per"""))
def subarea_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones inside the subarea (3 with much demand, 4 with less) and outside (2 related, 1 barely, 0 not)."""
    from netloom.operators import subarea

    zones = space.inside(derive.nodes(spark, sf_dir), _segments(spark), ["zone_id"])
    out = subarea.flags(zones, _demand(spark, sf_dir), _crossed(spark, sf_dir), 1000.0, 5.0, 200.0)
    return rounded(out, "volume", digits=4)


@query(net_od(f"""SELECT CASE WHEN a THEN 'inside' ELSE 'outside' END AS origin, CASE WHEN b THEN 'inside' ELSE 'outside' END AS destination, round(sum(volume), 4) AS volume
FROM (SELECT volume, p.inside AS a, q.inside AS b FROM od JOIN (SELECT zone_id, {_IN} AS inside FROM node n) p ON o = p.zone_id JOIN (SELECT zone_id, {_IN} AS inside FROM node n) q ON d = q.zone_id WHERE o <> d) GROUP BY a, b"""))
def subarea_flow_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.operators import subarea

    zones = space.inside(derive.nodes(spark, sf_dir), _segments(spark), ["zone_id"])
    return rounded(subarea.flow_matrix(zones, _demand(spark, sf_dir)), "volume", digits=4)


@query(net(f"SELECT link_id, a.inside AND b.inside AS inside FROM link JOIN (SELECT node_id, {_IN} AS inside FROM node n) a ON from_node_id = a.node_id JOIN (SELECT node_id, {_IN} AS inside FROM node n) b ON to_node_id = b.node_id"))
def subarea_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = space.inside(derive.nodes(spark, sf_dir), _segments(spark), ["node_id"])
    a, b = inside.select(c("node_id").alias("from_node_id"), c("inside").alias("a")), inside.select(c("node_id").alias("to_node_id"), c("inside").alias("b"))
    return derive.links(spark, sf_dir).join(F.broadcast(a), "from_node_id").join(F.broadcast(b), "to_node_id").select("link_id", (c("a") & c("b")).alias("inside"))


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.probe_volumes(derive.links(spark, sf_dir), derive.periods(spark))


@query(net_probe("""SELECT link_id, period, round(doc, 6) AS doc, round(fftt * (1 + 0.15::DOUBLE * pow(doc, 4)), 6) AS bpr_min, round(vf / (1 + 0.15::DOUBLE * pow(doc, 4)), 6) AS bpr_speed, round(fftt * (1 + 0.15::DOUBLE * pow(doc, 4)) - fftt, 6) AS bpr_wait FROM probe"""))
def bpr_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vdf.bpr(_probe(spark, sf_dir).withColumn("lanes", F.lit(1.0))), "doc", "bpr_min", "bpr_speed", "bpr_wait").select("link_id", "period", "doc", "bpr_min", "bpr_speed", "bpr_wait")


_Q = """, s1 AS (SELECT *, volume AS lane_demand, CASE WHEN doc < 1 THEN vf / (1 + (1.15::DOUBLE * vf / vc - 1) * pow(doc, 4)) ELSE vc / (1 + 0.15::DOUBLE * pow(doc, 4)) END AS q_speed,
 CASE WHEN doc < 1 THEN pow(doc, 4) ELSE pow(doc, 1) END AS p, CASE WHEN doc < 1 THEN 1 / vf ELSE 1 / vc END AS rtt, (start_hour + end_hour) / 2 AS t2 FROM probe),
s2 AS (SELECT *, fftt * vf / greatest(0.1, q_speed) AS raw_min, vc / (0.28125::DOUBLE * pow(p, 4) + 1) AS vt2, t2 - p / 2 AS t0, t2 + p / 2 AS t3, least(capacity, lane_demand / greatest(0.01::DOUBLE, p)) AS mu FROM s1),
s3 AS (SELECT *, least(raw_min, greatest(15, hours * 90)) AS q_min, raw_min - fftt AS q_wait, (1 / vt2 - rtt) * 64 * mu / pow(p, 4) AS gamma FROM s2)"""


def _qvdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vdf.qvdf(_probe(spark, sf_dir).withColumn("lanes", F.lit(1.0)))


@query(net_probe(f"{_Q} SELECT link_id, period, round(q_speed, 5) AS q_speed, round(q_min, 5) AS q_min, round(q_wait, 5) AS q_wait, round(p, 5) AS p, round(vt2, 5) AS vt2, round(t0, 4) AS t0, round(t3, 4) AS t3, round(mu, 4) AS mu FROM s3"))
def qvdf_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(_qvdf(spark, sf_dir), "q_speed", "q_min", "q_wait", "p", "vt2", digits=5)
    return rounded(out, "t0", "t3", "mu", digits=4).select("link_id", "period", "q_speed", "q_min", "q_wait", "p", "vt2", "t0", "t3", "mu")


_5MIN = f"""{_Q}, m AS (SELECT *, CAST(unnest(range(CAST(start_hour * 60 AS BIGINT), CAST(end_hour * 60 AS BIGINT) + 1, 5)) AS INTEGER) AS minute FROM s3),
v AS (SELECT link_id, period, minute, vf, minute / CAST(60 AS DOUBLE) AS t, CASE WHEN t0 <= t AND t <= t3 THEN 1 / (0.25::DOUBLE * gamma * pow(t - t0, 2) * pow(t - t3, 2) / greatest(0.001::DOUBLE, mu) + rtt)
 WHEN t < t0 THEN (1 - (t - start_hour) / greatest(0.001::DOUBLE, t0 - start_hour)) * vf + (t - start_hour) / greatest(0.001::DOUBLE, t0 - start_hour) * greatest(vc, q_speed)
 ELSE (1 - (t - t3) / greatest(0.001::DOUBLE, end_hour - t3)) * greatest(vc, q_speed) + (t - t3) / greatest(0.001::DOUBLE, end_hour - t3) * vf END AS speed FROM m)"""


@query(net_probe(f"{_5MIN} SELECT link_id, period, minute, round(speed, 4) AS speed FROM v"))
def qvdf_speed_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vdf.qvdf_profile(_qvdf(spark, sf_dir), ["link_id", "period"]), "speed", digits=4).drop("vf")


@query(net_probe(f"{_5MIN} SELECT link_id, period, minute // 15 * 15 AS quarter, round(avg(CASE WHEN speed >= 1 THEN speed END), 4) AS speed FROM v GROUP BY ALL"))
def speed_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a quarter of an hour, speeds below 1 left out."""
    long = vdf.qvdf_profile(_qvdf(spark, sf_dir), ["link_id", "period"])
    out = long.groupBy("link_id", "period", (F.floor(c("minute") / 15) * 15).cast("int").alias("quarter")).agg(F.avg(F.when(c("speed") >= 1, c("speed"))).alias("speed"))
    return rounded(out, "speed", digits=4)


_MARKS = ", ".join(f"round(avg(CASE WHEN minute // 15 * 15 = {m} AND speed >= 1 THEN speed END), 4) AS speed_{m // 60:02d}{m % 60:02d}" for m in range(420, 1080, 15))


@query(net_probe(f"{_5MIN} SELECT link_id, period, {_MARKS} FROM v GROUP BY link_id, period"))
def link_speed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds of each quarter of an hour from seven to eighteen, in columns."""
    from netloom.operators import report

    return report.speed_columns(speed_15min(spark, sf_dir), 420, 1080)


@query(net_probe(f"{_5MIN} SELECT link_id, period, round(count(*) FILTER (speed < vf * 0.5) * 5 / CAST(60 AS DOUBLE), 6) AS severe_hours FROM v GROUP BY link_id, period"))
def severe_congestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours at less than half the free speed."""
    long = vdf.qvdf_profile(_qvdf(spark, sf_dir), ["link_id", "period"])
    return long.groupBy("link_id", "period").agg(near(F.sum(F.when(c("speed") < c("vf") * 0.5, 1).otherwise(0)) * 5 / 60.0, 6).alias("severe_hours"))


#: Emission coefficients of the sample settings, for CO2 and NOX.
CO2 = [20785.99541, 0.0002, 0.0042, 0.3412]
NOX = [5.53516, 0.00003, 0.0003, 0.0043]


def _kg(rate: list[float]) -> str:
    quadratic = f"({rate[1]}::DOUBLE * u * u + u * {rate[2]}::DOUBLE + {rate[3]}::DOUBLE)"
    return f"{rate[0]}::DOUBLE * (fftt / 60 + (q_min - fftt) / 60 * CASE WHEN abs(m - u) > 1 THEN ({quadratic} * m - u) / (m - u) ELSE 0 END) / 1000"


@query(net_probe(f"{_Q}, e AS (SELECT *, vf / 1.609::DOUBLE AS m, vf / 1.609::DOUBLE / greatest(0.00001::DOUBLE, q_min / fftt) / 1.609::DOUBLE AS u FROM s3) SELECT link_id, period, round({_kg(CO2)}, 5) AS co2_kg, round({_kg(NOX)}, 5) AS nox_kg FROM e"))
def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _qvdf(spark, sf_dir)
    kg = lambda rate: near(vdf.emission_kg(c("q_min"), c("fftt"), c("vf"), F.array(*map(F.lit, rate))), 5)
    return q.select("link_id", "period", kg(CO2).alias("co2_kg"), kg(NOX).alias("nox_kg"))


@query(net("SELECT link_id, mode, round(fftt + toll / vot * 60, 6) AS cost FROM (SELECT link_id, mode, fftt, vot, CASE WHEN mode = 'auto' THEN toll_auto ELSE 0 END AS toll FROM link, mode_type)"))
def link_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised free-flow cost of each link for each mode; the toll is the car's."""
    met = derive.links(spark, sf_dir).crossJoin(F.broadcast(derive.modes(spark)))
    toll = F.when(c("mode") == "auto", c("toll_auto")).otherwise(0.0)
    return met.select("link_id", "mode", near(vdf.gradient_cost(c("fftt"), F.lit(0.0), toll, c("vot")), 6).alias("cost"))


@query(net("""SELECT link_id, q_alpha, q_beta, q_n FROM (SELECT link_id, coalesce(CASE WHEN link_id % 10 = 1 THEN 0.3 END, CASE link_type WHEN 1 THEN 0.2 WHEN 2 THEN 0.25 END, 0.1)::DOUBLE AS q_alpha,
 coalesce(CASE link_type WHEN 1 THEN 5 END, 3)::DOUBLE AS q_beta, 1.0::DOUBLE AS q_n FROM link)"""))
def qvdf_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the queue-based function: of the link, else its code, else the code ``all``, else the default."""

    links = derive.links(spark, sf_dir).withColumn("vdf_code", c("link_type").cast("string"))
    own = derive.links(spark, sf_dir).where("link_id % 10 = 1").select(F.lit("link").alias("data_type"), F.lit(None).cast("string").alias("vdf_code"), "from_node_id", "to_node_id", F.lit(0.3).alias("q_alpha"), F.lit(None).cast("double").alias("q_beta"))
    codes = spark.createDataFrame([("vdf_code", "1", None, None, 0.2, 5.0), ("vdf_code", "2", None, None, 0.25, None), ("vdf_code", "all", None, None, 0.1, 3.0)], "data_type string, vdf_code string, from_node_id long, to_node_id long, q_alpha double, q_beta double")
    return readers.apply_qvdf(links, codes.unionByName(own), ["q_alpha", "q_beta", "q_n"]).select("link_id", "q_alpha", "q_beta", "q_n")


@query(net("SELECT link_id, period, round(30 * 30 / (2 * 60.0) / 60 / greatest(0.1::DOUBLE, 1 - volume / 1800), 6) AS delay_min, round(vf / pow(1 + pow(volume / vf / 45, m), 2 / m), 6) AS s3_speed, round(vc * 45 * pow(pow(vf / vc, m / 2) - 1, 1 / m), 4) AS s3_volume FROM (SELECT *, 2 * ln(2) / ln(vf / (capacity / 45)) AS m FROM link, period_dim, (SELECT link_id AS k, CAST(200 + link_id * 37 % 1000 AS DOUBLE) AS volume FROM link) WHERE k = link_id) WHERE m > 0"))
def signal_and_s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform signal delay, and speed and flow by the S-shaped three-parameter model."""
    met = derive.links(spark, sf_dir).crossJoin(F.broadcast(derive.periods(spark))).withColumn("volume", (200 + c("link_id") * 37 % 1000).cast("double")).withColumn("m", 2 * F.log(F.lit(2.0)) / F.log(c("vf") / (c("capacity") / 45))).where("m > 0")
    k = F.lit(45.0)
    return met.select("link_id", "period", near(vdf.signal_delay(F.lit(30.0), F.lit(60.0), c("volume")), 6).alias("delay_min"), near(vdf.s3_speed(c("volume"), c("vf"), k, c("m"), c("vf")), 6).alias("s3_speed"), near(vdf.s3_volume(c("vc"), c("vf"), k, c("m")), 4).alias("s3_volume"))


@query(net("SELECT link_id, round(b, 4) AS bearing FROM (SELECT link_id, (degrees(atan2(q.y - p.y, q.x - p.x)) + 360) % 360 AS b FROM link JOIN node p ON from_node_id = p.node_id JOIN node q ON to_node_id = q.node_id)"))
def link_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derive.nodes(spark, sf_dir)
    p = nodes.select(c("node_id").alias("from_node_id"), c("x").alias("x1"), c("y").alias("y1"))
    q = nodes.select(c("node_id").alias("to_node_id"), c("x").alias("x2"), c("y").alias("y2"))
    return derive.links(spark, sf_dir).join(F.broadcast(p), "from_node_id").join(F.broadcast(q), "to_node_id").select("link_id", near(scalar.bearing_deg(c("x1"), c("y1"), c("x2"), c("y2")), 4).alias("bearing"))


@query(net_od("SELECT round(min(volume), 4) AS cutoff FROM (SELECT o, sum(volume) AS volume FROM od WHERE o <> d GROUP BY o ORDER BY 2 DESC, o LIMIT 10)"))
def origin_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume that the tenth largest origin sends."""
    return rounded(dm.volume_cutoff(_demand(spark, sf_dir), 10), "cutoff", digits=4)


@query("""SELECT c_mktsegment AS choice, CAST(c_nationkey % 3 AS BIGINT) AS alternative, round(sum(v), 4) AS volume, round(sum(v * (1 + c_nationkey % 3)), 4) AS trips, round(sum(v) / sum(sum(v)) OVER (PARTITION BY c_mktsegment), 6) AS share
FROM (SELECT *, CAST(1 + c_custkey % 4 AS DOUBLE) AS v FROM customer) GROUP BY c_mktsegment, c_nationkey % 3""")
def choice_set_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes, trips and shares of the alternatives in each choice set; chains have one to three trips."""
    legs = (c("c_nationkey") % 3).cast("long")
    chain = F.when(legs == 0, "1;2").when(legs == 1, "1;2;1").otherwise("1;2;3;1")
    choices = derive.table(spark, sf_dir, "customer").select(c("c_mktsegment").alias("choice"), legs.alias("alternative"), chain.alias("zone_chain"), (1 + c("c_custkey") % 4).cast("double").alias("volume"))
    return rounded(rounded(dm.alternatives(choices), "volume", "trips", digits=4), "share")


def _as_csv(df: DataFrame, name: str) -> str:
    path = lineage.folder(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


@query(net("SELECT node_id, round(x, 9) AS x, round(y, 9) AS y, zone_id, district_id FROM node"))
def node_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes written as a node file and read from it; a repeated row counts once, zone 0 is none."""
    n = derive.nodes(spark, sf_dir).select("node_id", c("x").alias("x_coord"), c("y").alias("y_coord"), "zone_id", "district_id", F.lit("extra").alias("name"))
    out = readers.read_nodes(spark, _as_csv(n.union(n.where("node_id < 3")), "node"))
    return rounded(out.select("node_id", "x", "y", "zone_id", "district_id"), "x", "y", digits=9)


@query(net("SELECT CAST(link_id AS VARCHAR) AS link_id, from_node_id, to_node_id, link_type, round(length_m, 6) AS length_m, round(vf, 6) AS vf, round(vc, 6) AS vc, round(fftt, 6) AS fftt, round(spatial_capacity, 6) AS spatial_capacity, lanes, capacity, toll_auto, ref_volume FROM link WHERE link_type < 3"))
def link_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links written as a link file in miles and read from it; types that are not declared and unknown nodes are left out."""
    rows = derive.links(spark, sf_dir).select("link_id", "from_node_id", "to_node_id", "link_type", (c("length_m") / 1609).alias("length"), "lanes", (c("vf") / vdf.MPH).alias("free_speed"), "capacity", "toll_auto", "ref_volume")
    rows = rows.union(rows.where("link_id = 102").withColumn("to_node_id", F.lit(999).cast("long")).select(rows.columns))
    cfg = settings.parse("unit: {length_unit: mile, speed_unit: mph}\nmode_types: [{mode_type: auto}]\nlink_types: [{link_type: 1, k_jam_km: 200}, {link_type: 2, k_jam_km: 200}]")
    nodes = derive.nodes(spark, sf_dir).select("node_id", "x", "y")
    out = readers.read_links(spark, _as_csv(rows, "link"), nodes, cfg)
    out = out.withColumn("link_type", c("link_type").cast("long")).select("link_id", "from_node_id", "to_node_id", "link_type", "length_m", "vf", "vc", "fftt", "spatial_capacity", "lanes", "capacity", "toll_auto", "ref_volume")
    return rounded(out, "length_m", "vf", "vc", "fftt", "spatial_capacity")


@query(net_od("SELECT o, d, mode, period, round(volume * 2, 6) AS volume FROM od WHERE mode = 'auto' AND period = 'am'"))
def demand_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand of one mode and period written as a column file and read from it with a scale of two; rows below -99 are left out."""
    od = derive.demand(spark, sf_dir).where("mode = 'auto' AND period = 'am'").select(c("o").alias("o_zone_id"), c("d").alias("d_zone_id"), "volume")
    rows = od.union(od.limit(1).withColumn("volume", F.lit(-100.0)))
    return rounded(readers.read_demand(spark, _as_csv(rows, "demand"), "auto", "am", 2.0), "volume")


@query(net("SELECT zone_id, 5 AS n_points, round(x, 6) AS x, round(y, 6) AS y FROM node"))
def taz_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares around zones written as a file of polygons and read from it."""
    corner = F.format_string("POLYGON((%f %f, %f %f, %f %f, %f %f, %f %f))", *(c(k) + d for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)) for k, d in (("x", a * 0.01), ("y", b * 0.01))))
    out = readers.read_taz(spark, _as_csv(derive.nodes(spark, sf_dir).select("zone_id", corner.alias("geometry")), "taz"))
    return rounded(out.select("zone_id", F.size("points").alias("n_points"), "x", "y"), "x", "y")


_SETTINGS = """
assignment: {number_of_iterations: 7, odme_activate: 1, UE_convergence_percentage: 0.5}
mode_types: [{mode_type: auto, vot: 12, pce: 1}, {mode_type: truck, vot: 30, pce: 2, person_occupancy: 1.5}]
demand_periods: [{period: AM, demand_period_id: 1, time_period: '0630_0900'}]
link_types: [{link_type: 1, link_type_name: road, allowed_uses_p1: auto}, {link_type: 1, link_type_name: twice}, {link_type: 2}]
demand_files: [{file_sequence_no: 2, file_name: b.csv, demand_period: am, mode_type: truck, scale_factor: 0.5}, {file_sequence_no: 1, file_name: a.csv, demand_period: am, mode_type: auto}, {file_sequence_no: 3, file_name: c.csv, demand_period: pm, mode_type: auto}]
departure_time_profile: [{departure_time_profile_no: 1, time_period: '0630_0700', T0635: 3}]
"""


@query("""SELECT * FROM (VALUES ('iterations', '7', 0::DOUBLE), ('gap', '', 0.5), ('mode', 'auto', 12), ('mode', 'truck', 30), ('occupancy', 'truck', 1.5), ('period', 'am', 6.5), ('hours', 'am', 2.5), ('type', 'road', 1), ('type', '', 2), ('uses', 'auto', 1),
 ('file', 'a.csv', 1), ('file', 'b.csv', 0.5), ('slot', '78', 1), ('slot', '79', 3), ('slot', '80', 1), ('slot', '81', 1), ('slot', '82', 1), ('slot', '83', 1), ('slot', '84', 1)) AS t(kind, name, value)""")
def settings_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from a settings file: defaults, order of files, unknown periods and repeated types left out, slots without a ratio at 1."""
    s = settings.parse(_SETTINGS)
    rows = [("iterations", str(s.iterations), 0.0), ("gap", "", s.gap_percent), *(("mode", m.mode_type, m.vot) for m in s.mode_types), ("occupancy", "truck", s.mode_types[1].person_occupancy)]
    rows += [x for p in s.periods for x in (("period", p.period, p.start_hour), ("hours", p.period, p.end_hour - p.start_hour))]
    rows += [("type", t.link_type_name, float(t.link_type)) for t in s.link_types] + [("uses", u, float(k)) for t in s.link_types for k, u in t.allowed_uses.items()]
    rows += [("file", f.file_name, f.scale_factor) for f in s.demand_files] + [("slot", str(k), v) for k, v in s.profiles[1].items()]
    return spark.createDataFrame(rows, "kind string, name string, value double")


_SQL_IN = "POLYGON((-89.96 40.04, -89.84 40.04, -89.84 40.16, -89.96 40.16, -89.96 40.04))"


@query(net_probe(f"""SELECT link_id, period, round(fftt * (1 + 0.15::DOUBLE * pow(doc, 4)), 6) AS bpr, round(least(fftt * vf / greatest(0.1::DOUBLE, CASE WHEN doc < 1 THEN vf / (1 + (1.15::DOUBLE * vf / greatest(0.0001::DOUBLE, vc) - 1) * pow(doc, 4)) ELSE vc / (1 + 0.15::DOUBLE * pow(doc, 4)) END), greatest(15::DOUBLE, hours * 90)), 6) AS queue,
 round(fftt + toll_auto / 10 * 60, 6) AS cost, CAST(lpad(CAST(start_hour AS INT)::VARCHAR, 2, '0') || '00' AS VARCHAR) AS clock, start_hour * 60 AS minute, round({_AB}, 3) AS metres, a.x > -89.96 AND a.x < -89.84 AND a.y > 40.04 AND a.y < 40.16 AS inside
FROM probe JOIN node a ON from_node_id = a.node_id JOIN node b ON to_node_id = b.node_id"""))
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's SQL functions on links with made-up volumes."""
    from netloom.functions import sql

    sql.register(spark)
    node = derive.nodes(spark, sf_dir)
    met = _probe(spark, sf_dir).withColumn("doc", c("volume") / c("capacity")).join(node.select(c("node_id").alias("from_node_id"), c("x").alias("x1"), c("y").alias("y1")), "from_node_id").join(node.select(c("node_id").alias("to_node_id"), c("x").alias("x2"), c("y").alias("y2")), "to_node_id")
    out = met.selectExpr("link_id", "period", "bpr_time(fftt, doc, 0.15, 4) AS bpr", "qvdf_time(fftt, hours, doc, vf, vc, 0.15, 4) AS queue", "generalized_cost(fftt, 0, toll_auto, 10) AS cost", "min_to_hhmm(start_hour * 60) AS clock", "hhmm_to_min(min_to_hhmm(start_hour * 60)) AS minute", "haversine_m(x1, y1, x2, y2) AS metres", f"pt_in_poly(x1, y1, '{_SQL_IN}') AS inside")
    return rounded(rounded(out, "bpr", "queue", "cost"), "metres", digits=3)


@query(net(f"SELECT round(avg(m), 3) AS metres FROM (SELECT a.node_id, min({_AB}) AS m FROM node a JOIN node b ON a.node_id <> b.node_id WHERE a.node_id % 4 = 0 AND b.node_id % 4 = 0 GROUP BY a.node_id)"))
def activity_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean distance to the nearest other among every fourth node."""
    return rounded(generate.mean_nearest(generate.activity_nodes(derive.nodes(spark, sf_dir), 4)), "metres", digits=3)


@query(net_probe(f"{_5MIN} SELECT link_id, period, minute // 60 AS hour, round(avg(CASE WHEN speed >= 1 THEN speed END), 4) AS speed FROM v GROUP BY ALL"))
def speed_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = vdf.qvdf_profile(_qvdf(spark, sf_dir), ["link_id", "period"])
    out = long.groupBy("link_id", "period", F.floor(c("minute") / 60).cast("int").alias("hour")).agg(F.avg(F.when(c("speed") >= 1, c("speed"))).alias("speed"))
    return rounded(out, "speed", digits=4)


@query(net(f"SELECT a.link_id, b.link_id AS next_link_id, round(((degrees(atan2(r.y - q.y, r.x - q.x)) - degrees(atan2(q.y - p.y, q.x - p.x)) + 900) % 360) - 180, 4) AS turn FROM link a JOIN link b ON a.to_node_id = b.from_node_id AND a.from_node_id <> b.to_node_id JOIN node p ON a.from_node_id = p.node_id JOIN node q ON a.to_node_id = q.node_id JOIN node r ON b.to_node_id = r.node_id"))
def turn_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements from link to link, turning back left out, and by how much they turn."""
    nodes = derive.nodes(spark, sf_dir)
    p = nodes.select(c("node_id").alias("from_node_id"), c("x").alias("x1"), c("y").alias("y1"))
    q = nodes.select(c("node_id").alias("to_node_id"), c("x").alias("x2"), c("y").alias("y2"))
    aimed = derive.links(spark, sf_dir).join(F.broadcast(p), "from_node_id").join(F.broadcast(q), "to_node_id").select("link_id", "from_node_id", "to_node_id", scalar.bearing_deg(c("x1"), c("y1"), c("x2"), c("y2")).alias("b"))
    nxt = aimed.select(c("link_id").alias("next_link_id"), c("from_node_id").alias("to_node_id"), c("to_node_id").alias("end"), c("b").alias("b2"))
    met = aimed.join(nxt, "to_node_id").where("from_node_id <> end")
    return met.select("link_id", "next_link_id", near(scalar.turn_deg(c("b"), c("b2")), 4).alias("turn"))
