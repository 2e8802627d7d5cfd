"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the mean radius of the earth in metres that distances are measured with.
EARTH_RADIUS_M = 6372797.56
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def time_to_min(text: Column) -> Column:
    """Minutes since midnight of ``HHMM`` or ``DDHHMM``, with ``:SS`` and ``:sss`` (thousandths of a minute) after it."""
    part = F.split(text, ":")
    code = part.getItem(0)
    days = F.when(F.length(code) == 6, F.substring(code, 1, 2).cast("double") * 1440).otherwise(F.lit(0.0))
    clock = F.when(F.length(code) == 6, F.substring(code, 3, 4)).otherwise(code)
    seconds = F.when(F.size(part) > 1, F.try_element_at(part, F.lit(2)).cast("double") / 60).otherwise(F.lit(0.0))
    milli = F.when(F.size(part) > 2, F.try_element_at(part, F.lit(3)).cast("double") / 1000).otherwise(F.lit(0.0))
    return days + F.substring(clock, 1, 2).cast("double") * 60 + F.substring(clock, 3, 2).cast("double") + seconds + milli


def period_to_min(text: Column) -> tuple[Column, Column]:
    """Start and end minutes of ``HHMM_HHMM``."""
    part = F.split(text, "_")
    return time_to_min(part.getItem(0)), time_to_min(part.getItem(1))


def min_to_time(minutes: Column) -> Column:
    """``HHMM:SS.sss`` of minutes since midnight."""
    milli = F.round(minutes * 60000).cast("long")
    return F.format_string("%02d%02d:%02d.%03d", F.floor(milli / 3600000), F.floor(milli / 60000) % 60, F.floor(milli / 1000) % 60, milli % 1000)


def split_numbers(text: Column, kind: str = "double") -> Column:
    """The array in a ``;``-separated field; blanks are skipped."""
    return F.transform(F.filter(F.split(text, ";"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast(kind))


def with_default(value: Column, default: object) -> Column:
    """``value``, or the default where it is null."""
    return F.coalesce(value, F.lit(default))


def allow_mode(uses: Column, mode: Column) -> Column:
    """Whether a link's ``allowed_uses`` lets a mode in: all if it is empty, ``null`` or ``all``, else by substring."""
    text = F.coalesce(uses, F.lit(""))
    return text.isin("", "null", "all") | text.contains(mode)


def haversine_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres between two points in degrees of longitude and latitude."""
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), F.lit(2.0)) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), F.lit(2.0))
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), a))) * EARTH_RADIUS_M


def bearing_deg(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The direction of a segment, in degrees from east, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)) + 360.0, F.lit(360.0))


def turn_deg(first: Column, second: Column) -> Column:
    """By how much a bearing turns to reach another, -180 to 180."""
    return F.pmod(second - first + 540.0, F.lit(360.0)) - 180.0


def point_line_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    length = F.pow(x2 - x1, F.lit(2.0)) + F.pow(y2 - y1, F.lit(2.0))
    share = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / length)))
    return F.sqrt(F.pow(px - x1 - share * (x2 - x1), F.lit(2.0)) + F.pow(py - y1 - share * (y2 - y1), F.lit(2.0)))


def _cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether segments ab and cd cross or touch, other than along one line."""
    one = _cross(ax, ay, bx, by, cx, cy) * _cross(ax, ay, bx, by, dx, dy)
    two = _cross(cx, cy, dx, dy, ax, ay) * _cross(cx, cy, dx, dy, bx, by)
    return (one <= 0) & (two <= 0) & ~((one == 0) & (two == 0))


def edge_crosses_ray(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray from a point to the right meets a polygon's edge, the upper end excluded."""
    spans = ((y1 <= py) & (py < y2)) | ((y2 <= py) & (py < y1))
    return spans & (px < x1 + (py - y1) / F.when(y2 == y1, F.lit(1.0)).otherwise(y2 - y1) * (x2 - x1))


def cell_index(value: Column, resolution: float) -> Column:
    return F.floor(value / resolution).cast("long")


def cell_id(x: Column, y: Column, resolution: float) -> Column:
    """One number for the grid cell of a point."""
    ix, iy = F.abs(cell_index(x, resolution)).cast("double"), F.abs(cell_index(y, resolution)).cast("double")
    return (ix * resolution * 1e12).cast("long") + (iy * resolution * 1e5).cast("long")


def cell_code(x: Column, y: Column, resolution: float, left: Column, top: Column) -> Column:
    """Letters for the column, counted from the left edge, and a number for the row, counted down from the top edge."""
    ix = cell_index(x, resolution) - cell_index(left, resolution)
    iy = F.ceil(top / resolution).cast("long") - cell_index(y, resolution)
    letter = lambda i: F.substring(F.lit(LETTERS), (i % 26 + 1).cast("int"), F.lit(1))
    high = F.floor(ix / 26).cast("long")
    return F.concat(F.when(high >= 1, letter(high)).otherwise(F.lit("")), letter(ix - high * 26), iy.cast("string"))


def wkt_points(text: Column) -> Column:
    """The points of a WKT geometry as an array of (x, y), rings and parts one after another."""
    inner = F.regexp_replace(F.regexp_extract(text, r"\((.*)\)", 1), r"[()]", "")
    pair = F.filter(F.split(inner, ","), lambda p: F.trim(p) != "")
    number = lambda p, i: F.split(F.trim(p), r"\s+").getItem(i).cast("double")
    return F.transform(pair, lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))


def wkt_kind(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
