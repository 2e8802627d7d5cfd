"""The engine's formulas as SQL functions: temporary functions with SQL bodies, which Catalyst puts in place of their calls."""

from __future__ import annotations

from pyspark.sql import SparkSession

from netloom.functions import scalar

_POINTS = r"transform(filter(split(regexp_replace(regexp_extract(wkt, r'\((.*)\)', 1), r'[()]', ''), ','), p -> trim(p) <> ''), p -> named_struct('x', CAST(split(trim(p), r'\s+')[0] AS DOUBLE), 'y', CAST(split(trim(p), r'\s+')[1] AS DOUBLE)))"

#: Name, arguments, result and body of each function.
FUNCTIONS = {
    "bpr_time": ("fftt DOUBLE, doc DOUBLE, alpha DOUBLE, beta DOUBLE", "DOUBLE", "fftt * (1 + alpha * power(doc, beta))"),
    "qvdf_speed": (
        "doc DOUBLE, vf DOUBLE, vc DOUBLE, alpha DOUBLE, beta DOUBLE", "DOUBLE",
        "CASE WHEN doc < 1 THEN vf / (1 + ((1 + alpha) * vf / greatest(0.0001D, vc) - 1) * power(doc, 4)) ELSE vc / (1 + alpha * power(doc, beta)) END",
    ),
    "qvdf_time": (
        "fftt DOUBLE, hours DOUBLE, doc DOUBLE, vf DOUBLE, vc DOUBLE, alpha DOUBLE, beta DOUBLE", "DOUBLE",
        "least(fftt * vf / greatest(0.1D, CASE WHEN doc < 1 THEN vf / (1 + ((1 + alpha) * vf / greatest(0.0001D, vc) - 1) * power(doc, 4)) ELSE vc / (1 + alpha * power(doc, beta)) END), greatest(15D, hours * 90))",
    ),
    "haversine_m": (
        "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE",
        f"2 * asin(sqrt(least(1D, power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2)))) * {scalar.EARTH_RADIUS_M!r}D",
    ),
    "hhmm_to_min": ("code STRING", "DOUBLE", "CAST(CASE WHEN length(code) = 6 THEN CAST(substring(code, 1, 2) AS INT) * 1440 ELSE 0 END + CAST(substring(right(code, 4), 1, 2) AS INT) * 60 + CAST(right(code, 2) AS INT) AS DOUBLE)"),
    "min_to_hhmm": ("minutes DOUBLE", "STRING", "concat(lpad(CAST(floor(minutes / 60) AS STRING), 2, '0'), lpad(CAST(CAST(floor(minutes) AS BIGINT) % 60 AS STRING), 2, '0'))"),
    "generalized_cost": ("minutes DOUBLE, penalty DOUBLE, toll DOUBLE, vot DOUBLE", "DOUBLE", "minutes + penalty + toll / vot * 60"),
    "pt_in_poly": (
        "px DOUBLE, py DOUBLE, wkt STRING", "BOOLEAN",
        f"""aggregate(zip_with(slice({_POINTS}, 1, size({_POINTS}) - 1), slice({_POINTS}, 2, size({_POINTS}) - 1), (u, v) -> named_struct('a', u, 'b', v)), 0, (n, s) ->
  n + CASE WHEN ((s.a.y <= py AND py < s.b.y) OR (s.b.y <= py AND py < s.a.y)) AND px < s.a.x + (py - s.a.y) / nullif(s.b.y - s.a.y, 0D) * (s.b.x - s.a.x) THEN 1 ELSE 0 END) % 2 = 1""",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in a session; their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
