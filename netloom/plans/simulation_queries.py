"""Queries on signals, time-dependent counts, simulation, streams and binary records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.operators import demand as dm
from netloom.operators import report, simulate, space
from netloom.plans import assignment_queries as aq
from netloom.plans import lineage
from netloom.plans.catalog import near, net, net_od, query
from netloom.sources import derive, readers
from netloom.streaming import counts

c = F.col


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.links(spark, sf_dir).select("link_id", "lanes", F.lit(60).alias("cycle_s"), (10 * (c("link_id") % 3)).cast("int").alias("green_s"), F.lit(30).alias("green_len_s"))


_STATE = "st AS (SELECT link_id, lanes, CAST(s AS INTEGER) AS second, CASE WHEN (s - 10 * (link_id % 3) + 60) % 60 < 30 THEN 1 ELSE 0 END AS state FROM link, range(0, 600) r(s))"


@query(net(f", {_STATE}, m AS (SELECT *, coalesce(CAST(state <> lag(state) OVER (PARTITION BY link_id ORDER BY second) AS INTEGER), 0) AS ch FROM st), g AS (SELECT *, sum(ch) OVER (PARTITION BY link_id ORDER BY second) AS run FROM m) SELECT link_id, state, min(second) AS first, max(second) AS last FROM g GROUP BY link_id, run, state"))
def signal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of green and red at each link over ten minutes."""
    return simulate.state_runs(simulate.signal_seconds(_signals(spark, sf_dir), 600))


@query(net(f", {_STATE} SELECT link_id, round(sum(CASE WHEN state = 1 AND second % 2 = 0 THEN lanes ELSE 0 END), 3) AS vehicles FROM st GROUP BY link_id"))
def signal_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.signal_seconds(_signals(spark, sf_dir), 600).groupBy("link_id").agg(near(F.sum("capacity"), 3).alias("vehicles"))


@query(net("SELECT link_id, s // 60 AS minute, CAST(sum(floor(rate * (s + 1)) - floor(rate * s)) AS BIGINT) AS vehicles FROM (SELECT link_id, capacity * lanes / 3600 AS rate FROM link), range(0, 600) r(s) GROUP BY ALL"))
def outflow_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole vehicles that may leave each link, by minute."""
    out = simulate.capacity_seconds(derive.links(spark, sf_dir), 600)
    return out.groupBy("link_id", F.floor(c("second") / 60).alias("minute")).agg(F.sum("capacity").alias("vehicles"))


_EVENT = "ev AS (SELECT 1 + user_id % 25 AS zone, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE 0 END AS a, CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS d FROM events)"
_CUM = f"""{_EVENT}, mn AS (SELECT zone, minute, sum(a) AS a, sum(d) AS d FROM ev GROUP BY ALL), grid AS (SELECT zone, CAST(m AS INTEGER) AS minute FROM (SELECT DISTINCT zone FROM ev), range(0, 1440) r(m)),
cum AS MATERIALIZED (SELECT zone, minute, CAST(sum(coalesce(a, 0)) OVER w AS BIGINT) AS ca, CAST(sum(coalesce(d, 0)) OVER w AS BIGINT) AS cd FROM grid LEFT JOIN mn USING (zone, minute) WINDOW w AS (PARTITION BY zone ORDER BY minute))"""


def _kinds(events: DataFrame) -> DataFrame:
    kind = F.when(c("event_type").isin("view", "click", "signup"), "arrival").when(c("event_type").isin("purchase", "error"), "departure")
    return events.select((1 + c("user_id") % 25).alias("zone"), c("ts").cast("timestamp").alias("ts"), kind.alias("kind"))


def _cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("int")
    seen = _kinds(derive.table(spark, sf_dir, "events")).groupBy("zone", minute.alias("minute")).agg(F.count_if(c("kind") == "arrival").alias("arrivals"), F.count_if(c("kind") == "departure").alias("departures"))
    return simulate.cumulative(seen, ["zone"], 0, 1439)


@query(f"WITH {_CUM} SELECT * FROM cum")
def td_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running arrivals and departures by minute of the day; users stand for links."""
    return _cumulative(spark, sf_dir)


@query(f"""WITH {_CUM}, x AS (SELECT *, ca - coalesce(lag(ca, 15) OVER w, 0) AS inflow, cd - coalesce(lag(cd, 15) OVER w, 0) AS outflow, ca - cd AS queue, sum(ca - cd) OVER (PARTITION BY zone ORDER BY minute ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS held FROM cum WINDOW w AS (PARTITION BY zone ORDER BY minute))
SELECT zone, minute, inflow, outflow, queue, round(queue / (2.5::DOUBLE * 2), 6) AS density, round(least(1, queue / (2.5::DOUBLE * 2) / 200), 6) AS queue_ratio, round(3 + CASE WHEN inflow > 0 THEN held / inflow ELSE 0 END, 4) AS travel_min FROM x WHERE minute % 15 = 14""")
def td_link_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cum = _cumulative(spark, sf_dir).withColumns({"distance_km": F.lit(2.5), "lanes": F.lit(2.0), "fftt": F.lit(3.0), "k_jam": F.lit(200.0)})
    out = simulate.td_performance(cum, ["zone"])
    return out.withColumns({"density": near("density", 6), "queue_ratio": near("queue_ratio", 6), "travel_min": near("travel_min", 4)})


@query(aq._pool_sql(aq.ROUNDS) + f" SELECT mode, period, count(*) AS paths, CAST(sum(n) AS BIGINT) AS vehicles FROM (SELECT mode, period, CAST(floor(volume + 0.5) AS BIGINT) AS n FROM {aq._P}) WHERE n > 0 GROUP BY mode, period")
def sim_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that send vehicles, and the vehicles."""
    return simulate.agents(aq._pool(spark, sf_dir)).groupBy("mode", "period").agg(F.count("*").alias("paths"), F.sum("n").alias("vehicles"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vehicles of the pool, simulated on links with a period's share of the capacity."""

    def make() -> DataFrame:
        cars = simulate.vehicles(aq._pool(spark, sf_dir), {"am": 420.0, "md": 720.0, "pm": 1020.0})
        scaled = derive.links(spark, sf_dir).withColumn("capacity", c("capacity") / 3)
        return lineage.cut(simulate.simulate(cars, scaled))

    return aq._once("events", make, spark, sf_dir)


_STAYS = "SELECT 1 + user_id % 25 AS zone, CAST(event_id AS BIGINT) AS agent_id, hour(ts) * 3600 + minute(ts) * 60 AS a FROM events"


@query(f"SELECT zone, agent_id, row_number() OVER (PARTITION BY zone ORDER BY a, agent_id) AS position FROM ({_STAYS}) WHERE a <= 43200 AND a + 1200 > 43200")
def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in line at noon, if each event stays for twenty minutes; users stand for links."""
    at = (F.hour(c("ts").cast("timestamp")) * 3600 + F.minute(c("ts").cast("timestamp")) * 60).cast("double")
    stays = derive.table(spark, sf_dir, "events").select((1 + c("user_id") % 25).alias("zone"), c("event_id").cast("long").alias("agent_id"), at.alias("arrival_s")).withColumn("departure_s", c("arrival_s") + 1200)
    return simulate.queue_positions(stays, 43200.0, ["zone"])


@query()
def sim_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of all simulated vehicles: travel time, distance, speed, and the link of the longest wait."""
    return simulate.trips(_events(spark, sf_dir), derive.links(spark, sf_dir))


@query()
def sim_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.trajectories(_events(spark, sf_dir))


@query()
def sim_link_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.minute_counts(_events(spark, sf_dir))


_HULL = """, p AS (SELECT district_id AS k, CAST((node_id - 1) % 5 AS DOUBLE) AS x, CAST((node_id - 1) // 5 AS DOUBLE) AS y FROM node),
side AS (SELECT p.k, p.x, p.y, q.x AS u, q.y AS v FROM p JOIN p q ON p.k = q.k AND (p.x <> q.x OR p.y <> q.y)
 WHERE NOT EXISTS (SELECT 1 FROM p r WHERE r.k = p.k AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0 OR ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND ((r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) < 0 OR (r.x - q.x) * (q.x - p.x) + (r.y - q.y) * (q.y - p.y) > 0))))),
least AS (SELECT k, min(x) AS x, arg_min(y, (x, y)) AS y FROM p GROUP BY k),
walk AS (SELECT k, x, y, 0 AS n, printf('%.6f %.6f', x, y) AS line FROM least UNION ALL
 SELECT w.k, s.u, s.v, n + 1, line || ', ' || printf('%.6f %.6f', s.u, s.v) FROM walk w JOIN side s ON s.k = w.k AND s.x = w.x AND s.y = w.y JOIN least l ON l.k = w.k WHERE n = 0 OR w.x <> l.x OR w.y <> l.y)
SELECT k AS district_id, 'POLYGON((' || arg_max(line, n) || '))' AS wkt FROM walk GROUP BY k"""


@query(net(_HULL).replace("WITH", "WITH RECURSIVE", 1))
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull of each district's zones, by their columns and rows in the lattice, which are whole numbers."""
    at = c("node_id") - 1
    return space.hulls(derive.nodes(spark, sf_dir).select("district_id", (at % 5).cast("double").alias("x"), F.floor(at / 5).cast("double").alias("y")), "district_id")


@query(net_od("SELECT o, d, CASE mode WHEN 'auto' THEN 0 WHEN 'hov' THEN 1 ELSE 2 END AS mode_no, CASE period WHEN 'am' THEN 0 WHEN 'md' THEN 1 ELSE 2 END AS period_no, round(volume, 6) AS volume FROM od WHERE o <> d"))
def demand_bin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand packed into binary records and read from them."""
    od = dm.between_zones(derive.demand(spark, sf_dir), derive.nodes(spark, sf_dir))
    coded = od.join(F.broadcast(derive.modes(spark).select("mode", "mode_no")), "mode").join(F.broadcast(derive.periods(spark).select("period", "period_no")), "period")
    return readers.unpack_demand(readers.pack_demand(coded)).withColumn("volume", near("volume", 6))


@query("""WITH route AS (SELECT CAST(o_orderkey AS BIGINT) AS path_id, 1 + o_orderkey % 21 AS a, CAST(o_totalprice AS DOUBLE) AS volume FROM orders)
SELECT path_id, a AS o, a + 2 AS d, round(volume * 0.1, 4) AS volume, CAST(100 * a + a + 1 AS VARCHAR) || ';' || CAST(100 * (a + 1) + a + 2 AS VARCHAR) AS links FROM route WHERE (a - 1) % 5 < 3""")
def route_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed routes over three nodes in a row; those that leave the lattice are no routes."""
    orders = derive.table(spark, sf_dir, "orders").withColumn("a", 1 + c("o_orderkey") % 21)
    raw = orders.select(c("o_orderkey").alias("path_id"), c("a").alias("o"), (c("a") + 2).alias("d"), c("o_totalprice").alias("volume"), F.concat_ws(";", c("a").cast("string"), (c("a") + 1).cast("string"), (c("a") + 2).cast("string")).alias("node_sequence"))
    out = readers.routes(raw, derive.links(spark, sf_dir), 0.1)
    return out.select("path_id", "o", "d", near("volume", 4).alias("volume"), F.array_join(F.transform("link_seq", lambda x: x.cast("string")), ";").alias("links"))


@query("""WITH ch AS (SELECT c_custkey, 1 + c_nationkey AS h, 1 + c_custkey % 25 AS w, 1 + c_custkey % 7 AS s FROM customer)
SELECT CAST(o AS BIGINT) AS o, CAST(d AS BIGINT) AS d, round(sum(v), 4) AS volume FROM (SELECT h AS o, w AS d, 0.5 AS v FROM ch UNION ALL SELECT w, s, 0.5 FROM ch UNION ALL SELECT s, h, 0.5 FROM ch) GROUP BY o, d""")
def choice_set_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of home, work, shop and home chains."""
    chain = F.concat_ws(";", *(x.cast("string") for x in (1 + c("c_nationkey"), 1 + c("c_custkey") % 25, 1 + c("c_custkey") % 7, 1 + c("c_nationkey"))))
    choices = derive.table(spark, sf_dir, "customer").select(chain.alias("zone_chain"), F.lit(0.5).alias("volume"))
    return readers.choice_demand(choices).withColumn("volume", near("volume", 4))


@query(net("SELECT CAST(row_number() OVER (ORDER BY zone_id) - 1 AS INTEGER) AS zone_index, zone_id, district_id, round(x, 6) AS x, round(y, 6) AS y FROM node"))
def internal_zone_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.internal_zones(derive.nodes(spark, sf_dir)).withColumns({"x": near("x", 6), "y": near("y", 6)})


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = derive.table(spark, sf_dir, "events").schema
    return _kinds(counts.events(spark, f"{sf_dir}/events.parque[t]", schema))


@query(f"WITH {_EVENT.replace('CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute', chr(39) + 'x' + chr(39) + ' AS minute, ts')} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, zone, CAST(sum(a) AS BIGINT) AS arrivals, CAST(sum(d) AS BIGINT) AS departures FROM ev GROUP BY ALL")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals and departures in hourly windows of an event stream with a watermark."""
    out = counts.drained(counts.minute_windows(_stream(spark, sf_dir), "ts", "zone", "1 hour"), ["start", "zone"])
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query(f"WITH {_EVENT} SELECT zone, CAST(sum(a) AS BIGINT) AS arrivals, CAST(sum(d) AS BIGINT) AS departures FROM ev GROUP BY zone")
def streaming_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running arrivals and departures, kept as the state of a stream."""
    return counts.drained(counts.queues(_stream(spark, sf_dir), "zone"), ["zone"]).select("zone", "arrivals", "departures")
