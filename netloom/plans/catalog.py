"""The queries of the engine by name, and for each the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Values are raised by this share of them, and as much again, before they are rounded for a comparison: sums of doubles in
#: another order differ by less, and else fall on either side of a half.
NUDGE = 1e-11


def near(value: Column | str, digits: int) -> Column:
    """``value`` rounded for a comparison with SQL."""
    return F.round((F.col(value) if isinstance(value, str) else value) * (1 + NUDGE) + NUDGE * 100, digits)


def nearly(sql: str) -> str:
    """SQL whose ``round(x, digits)`` do as ``near`` does; what is rounded to a whole number inside CAST stays."""
    out, at = "", 0
    for m in re.finditer(r"(?<!CAST\()\bround\(", sql):
        if m.start() < at:
            continue  # inside another one
        depth, comma, end = 1, None, m.end()
        while depth:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        out += sql[at : m.start()]
        if comma is None:
            out += sql[m.start() : end]
        else:
            out += f"round(({nearly(sql[m.end() : comma])}) * {1 + NUDGE!r}::DOUBLE + {NUDGE * 100!r}::DOUBLE, {sql[comma + 1 : end].strip()}"
        at = end
    return out + sql[at:]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = nearly(sql)
        return f

    return add


def all_queries() -> dict[str, Query]:
    """All registered queries, after the modules that register them are read."""
    from netloom.plans import assignment_queries, network_queries, simulation_queries  # noqa: F401

    return QUERIES


#: The derived tables (see ``netloom.sources.derive``) in SQL, to begin a statement with.
BASE = """
node AS MATERIALIZED (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS node_id, CAST(n_nationkey + 1 AS BIGINT) AS zone_id, CAST(n_regionkey AS BIGINT) AS district_id,
    CAST(-90.0 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (n_nationkey % 5) AS x, CAST(40.0 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (n_nationkey // 5) AS y
  FROM nation
), ab AS (
  SELECT a.node_id AS f, b.node_id AS t FROM node a, node b
  WHERE abs((a.node_id - 1) % 5 - (b.node_id - 1) % 5) + abs((a.node_id - 1) // 5 - (b.node_id - 1) // 5) = 1
), raw AS (
  SELECT 100 * f + t AS link_id, f AS from_node_id, t AS to_node_id, CAST(2 + (7 * f + 3 * t) % 9 AS DOUBLE) AS length_mile,
    CAST(30 + 10 * ((f + t) % 4) AS DOUBLE) AS free_speed_mph, CAST(1 + (f + t) % 3 AS DOUBLE) AS lanes, CAST(1200 + 300 * ((f * t) % 5) AS DOUBLE) AS capacity,
    1 + f % 3 AS link_type, CAST(CASE WHEN (f * t) % 11 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS toll_auto,
    CAST(CASE WHEN (100 * f + t) % 7 = 0 THEN 1000 + 10 * ((100 * f + t) % 50) END AS DOUBLE) AS ref_volume,
    CASE f % 3 WHEN 0 THEN 'auto;hov' WHEN 1 THEN '' ELSE 'null' END AS allowed_uses
  FROM ab
), link AS MATERIALIZED (
  SELECT *, CAST(0.85 AS DOUBLE) * vf AS vc, distance_km / vf * 60 AS fftt, greatest(CAST(1 AS DOUBLE), distance_km * lanes * 200) AS spatial_capacity
  FROM (SELECT *, length_mile * 1609 AS length_m, length_mile * 1609 / 1000 AS distance_km, free_speed_mph * CAST(1.609 AS DOUBLE) AS vf FROM raw)
), mode_type(mode, mode_no, vot, occupancy, pce) AS (
  VALUES ('auto', 0, CAST(10 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE)), ('hov', 1, 20, 2, 1), ('truck', 2, 10, 1, 2)
), period_dim(period, period_no, start_hour, end_hour, hours) AS (
  VALUES ('am', 0, CAST(7 AS DOUBLE), CAST(8 AS DOUBLE), CAST(1 AS DOUBLE)), ('md', 1, 12, 13, 1), ('pm', 2, 17, 18, 1)
)"""

#: Demand between zones, trips within a zone included.
DEMAND = """
, cell AS (
  SELECT CAST(s_nationkey + 1 AS BIGINT) AS o, CAST(c_nationkey + 1 AS BIGINT) AS d, CASE l_returnflag WHEN 'A' THEN 'auto' WHEN 'N' THEN 'hov' WHEN 'R' THEN 'truck' END AS mode,
    CASE WHEN month(o_orderdate) <= 4 THEN 'am' WHEN month(o_orderdate) <= 8 THEN 'md' ELSE 'pm' END AS period, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), od AS MATERIALIZED (SELECT o, d, mode, period, n * CAST(60000 AS DOUBLE) / (SELECT sum(n) FROM cell) AS volume FROM cell)"""

#: Links by period with made-up volumes and default parameters.
PROBE = """
, probe AS (
  SELECT *, CAST(200 + (link_id * 37 + 911 * period_no) % 4000 AS DOUBLE) AS volume, volume / capacity AS doc FROM link, period_dim
)"""


def net(sql: str) -> str:
    return f"WITH {BASE} {sql}"


def net_od(sql: str) -> str:
    return f"WITH {BASE} {DEMAND} {sql}"


def net_probe(sql: str) -> str:
    return f"WITH {BASE} {PROBE} {sql}"
