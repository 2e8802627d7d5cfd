"""Readers of network, demand and parameter files. Columns are found by name; extra ones are ignored, missing ones defaulted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import scalar, vdf
from netloom.sources import settings

c = F.col

#: Type and default of each column that a file may have; those marked required must be in its header.
NODE = {"node_id": ("long", None), "x_coord": ("double", None), "y_coord": ("double", None), "zone_id": ("long", None), "district_id": ("long", 0), "is_boundary": ("int", None), "node_type": ("string", None), "mode_type": ("string", None), "subarea_id": ("int", None)}
NODE_REQUIRED = ("node_id", "x_coord", "y_coord", "zone_id")
LINK = {
    "link_id": ("string", None), "from_node_id": ("long", None), "to_node_id": ("long", None), "link_type": ("int", None), "length": ("double", None), "lanes": ("double", 1.0), "free_speed": ("double", 100.0), "capacity": ("double", 2000.0),
    "cutoff_speed": ("double", None), "dir_flag": ("int", 1), "VDF_alpha": ("double", 0.15), "VDF_beta": ("double", 4.0), "VDF_plf": ("double", 1.0), "VDF_fftt": ("double", None), "VDF_preload": ("double", 0.0), "ref_volume": ("double", None),
    "vdf_code": ("string", None), "link_type_name": ("string", None), "geometry": ("string", None), "restricted_turn_nodes": ("string", None), "saturation_flow_rate": ("double", 1800.0), "cycle_length": ("double", -1.0),
    "start_green_time": ("double", None), "end_green_time": ("double", None), "red_time": ("double", None), "tmc": ("string", None), "tmc_corridor_name": ("string", "network_wide"),
}
LINK_REQUIRED = ("from_node_id", "to_node_id", "link_type")
METRES = {"meter": 1.0, "m": 1.0, "km": 1000.0, "mile": 1609.0}
KMPH = {"kmph": 1.0, "mph": vdf.MPH}


class MissingColumn(ValueError):
    """A file's header has no column that is required."""


def read_csv(spark: SparkSession, path: str, columns: dict[str, tuple[str, object]], required: tuple[str, ...] = ()) -> DataFrame:
    """The named columns of a CSV file with a header: typed, defaulted where null or missing.

    Header names are trimmed of blanks and of a byte-order mark. No type is inferred: the file is read once, as text.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*(x.replace("﻿", "").strip() for x in raw.columns))
    if missing := [x for x in required if x not in raw.columns]:
        raise MissingColumn(f"{path}: no column {', '.join(missing)}")

    def typed(name: str, kind: str, default: object):
        value = c(f"`{name}`").try_cast(kind) if name in raw.columns else F.lit(None).cast(kind)
        return (value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name)

    return raw.select(*(typed(name, *rest) for name, rest in columns.items()))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """section, row, cells of a file of ``[section]`` lines, each followed by its rows. For settings files, which one task reads whole."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("row", "line")).where(F.trim("line") != "")
    named = text.withColumn("name", F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]+)\]", 1), F.lit("")))
    section = F.last("name", ignorenulls=True).over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return named.withColumn("section", section).where("name IS NULL").select("section", "row", F.split("line", r"\s*,\s*").alias("cells"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, x, y, zone_id (null if none), district_id and the optional columns; of repeated node_ids the least row stays."""
    out = read_csv(spark, path, NODE, NODE_REQUIRED).where("node_id IS NOT NULL")
    zone = F.when(c("zone_id") >= 1, c("zone_id"))
    first = Window.partitionBy("node_id").orderBy("x_coord", "y_coord")
    out = out.withColumn("zone_id", zone).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return out.withColumnsRenamed({"x_coord": "x", "y_coord": "y"})


def read_links(spark: SparkSession, path: str, nodes: DataFrame, cfg: settings.Settings) -> DataFrame:
    """Links with units, free-flow time, cutoff speed and storage; one row per direction.

    A link is left out if an end is not a node or its type is not declared. dir_flag 1 is forward, -1 reversed, 0 and 2 both.
    """
    names = [m.mode_type for m in cfg.mode_types]
    own = {f"{kind}_{mode}": ("double", 0.0) for mode in names for kind in ("toll", "penalty")}
    raw = read_csv(spark, path, LINK | own, LINK_REQUIRED)
    uses = lambda t: {p.period: t.allowed_uses.get(p.demand_period_id, "") for p in cfg.periods}
    kinds = spark.createDataFrame([(t.link_type, t.k_jam, t.traffic_flow_model, uses(t)) for t in cfg.link_types], "link_type int, k_jam double, traffic_flow_model string, allowed_uses map<string,string>")
    flag = c("dir_flag")
    both = F.when(flag == 1, F.array(F.lit(1))).when(flag == -1, F.array(F.lit(-1))).otherwise(F.array(F.lit(1), F.lit(-1)))
    out = raw.withColumn("direction", F.explode(both))
    ahead = c("direction") == 1
    out = out.withColumns({"from_node_id": F.when(ahead, c("from_node_id")).otherwise(c("to_node_id")), "to_node_id": F.when(ahead, c("to_node_id")).otherwise(c("from_node_id"))})
    a = nodes.select(c("node_id").alias("from_node_id"), c("x").alias("x1"), c("y").alias("y1"))
    b = nodes.select(c("node_id").alias("to_node_id"), c("x").alias("x2"), c("y").alias("y2"))
    out = out.join(a, "from_node_id").join(b, "to_node_id").join(F.broadcast(kinds), "link_type")
    out = out.withColumn("length_m", F.greatest(F.lit(1.0), F.coalesce("length", F.lit(0.0)) * METRES[cfg.length_unit])).withColumn("distance_km", c("length_m") / 1000)
    out = out.withColumn("vf", c("free_speed") * KMPH[cfg.speed_unit]).withColumn("vc", F.coalesce(c("cutoff_speed") * KMPH[cfg.speed_unit], 0.85 * c("vf")))
    out = out.withColumn("fftt", F.coalesce("VDF_fftt", c("distance_km") / c("vf") * 60)).withColumn("plf", F.when((c("VDF_plf") < 0.1) | (c("VDF_plf") > 1), 1.0).otherwise(c("VDF_plf")))
    out = out.withColumn("spatial_capacity", F.greatest(F.lit(1.0), c("distance_km") * c("lanes") * c("k_jam")))
    line = F.format_string("LINESTRING (%f %f, %f %f)", "x1", "y1", "x2", "y2")
    out = out.withColumn("geometry", F.coalesce("geometry", line)).withColumnsRenamed({"VDF_alpha": "alpha", "VDF_beta": "beta", "VDF_preload": "preload"})
    return out.withColumn("link_id", F.coalesce("link_id", F.concat_ws("_", "from_node_id", "to_node_id"))).drop("x1", "y1", "x2", "y2")


def read_demand(spark: SparkSession, path: str, mode: str, period: str, scale: float = 1.0) -> DataFrame:
    """o, d, mode, period, volume of a column file; rows below -99 and those without zones are left out."""
    raw = read_csv(spark, path, {"o_zone_id": ("long", None), "d_zone_id": ("long", None), "volume": ("double", 0.0)}, ("o_zone_id", "d_zone_id", "volume"))
    return raw.where("o_zone_id IS NOT NULL AND d_zone_id IS NOT NULL AND volume >= -99").select(c("o_zone_id").alias("o"), c("d_zone_id").alias("d"), F.lit(mode).alias("mode"), F.lit(period).alias("period"), (c("volume") * scale).alias("volume"))


#: Fixed value: a binary demand record, four 32-bit integers and a double without padding.
DEMAND_RECORD = np.dtype([("o", "<i4"), ("d", "<i4"), ("mode_no", "<i4"), ("period_no", "<i4"), ("volume", "<f8")])
_DEMAND_SCHEMA = "o long, d long, mode_no int, period_no int, volume double"


def read_demand_binary(spark: SparkSession, path: str) -> DataFrame:
    """o, d, mode_no, period_no, volume of files of binary records; bytes after the last whole record are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                rows = np.frombuffer(raw, DEMAND_RECORD, count=len(raw) // DEMAND_RECORD.itemsize)
                for at in range(0, len(rows), 1 << 16):
                    some = rows[at : at + (1 << 16)]
                    kinds = (np.int64, np.int64, np.int32, np.int32, np.float64)
                    yield pa.record_batch([pa.array(some[n].astype(k)) for n, k in zip(DEMAND_RECORD.names, kinds, strict=True)], names=list(DEMAND_RECORD.names))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _DEMAND_SCHEMA)


def pack_demand(od: DataFrame) -> DataFrame:
    """Rows of ``part`` (bytes): the demand (o, d, mode_no, period_no, volume) as binary records, one run per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty(batch.num_rows, DEMAND_RECORD)
            for i, name in enumerate(DEMAND_RECORD.names):
                rows[name] = batch.column(i).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array([rows.tobytes()], pa.binary())], names=["part"])

    return od.select(*DEMAND_RECORD.names).mapInArrow(run, "part binary")


def unpack_demand(parts: DataFrame) -> DataFrame:
    """The demand in rows that ``pack_demand`` made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0):
                rows = np.frombuffer(part.as_buffer(), DEMAND_RECORD)
                kinds = (np.int64, np.int64, np.int32, np.int32, np.float64)
                yield pa.record_batch([pa.array(rows[n].astype(k)) for n, k in zip(DEMAND_RECORD.names, kinds, strict=True)], names=list(DEMAND_RECORD.names))

    return parts.mapInArrow(run, _DEMAND_SCHEMA)


def read_taz(spark: SparkSession, path: str) -> DataFrame:
    """zone_id, points (the polygon's), x and y (their mean, the closing point left out) of a file of zone polygons (TAZ_id or zone_id, geometry)."""
    raw = read_csv(spark, path, {"zone_id": ("long", None), "TAZ_id": ("long", None), "geometry": ("string", None)}, ("geometry",))
    out = raw.select(F.coalesce("zone_id", "TAZ_id").alias("zone_id"), scalar.wkt_points(c("geometry")).alias("points")).where("zone_id IS NOT NULL AND size(points) > 2")
    closed = F.element_at("points", 1) == F.element_at("points", -1)
    open_ = F.when(closed, F.slice("points", 1, F.size("points") - 1)).otherwise(c("points"))
    mean = lambda k: F.aggregate(open_, F.lit(0.0), lambda a, p: a + p[k]) / F.size(open_)
    return out.withColumns({"x": mean("x"), "y": mean("y")})


def routes(raw: DataFrame, links: DataFrame, scale: float = 1.0) -> DataFrame:
    """Fixed routes: path_id, o, d, volume, node_seq, link_seq; a route with a step that is no link is left out.

    ``raw``: path_id, o, d, volume, node_sequence (``;``-separated).
    """
    nodes = raw.select("path_id", "o", "d", (c("volume") * scale).alias("volume"), scalar.split_numbers(c("node_sequence"), "long").alias("node_seq")).where(F.size("node_seq") > 1)
    step = F.transform(F.sequence(F.lit(1), F.size("node_seq") - 1), lambda i: F.struct(i.alias("k"), F.element_at("node_seq", i).alias("from_node_id"), F.element_at("node_seq", i + 1).alias("to_node_id")))
    steps = nodes.select("path_id", F.explode(step).alias("s")).select("path_id", "s.*")
    met = steps.join(links.select("from_node_id", "to_node_id", "link_id"), ["from_node_id", "to_node_id"], "left")
    whole = met.groupBy("path_id").agg(F.count("*").alias("n"), F.count("link_id").alias("m"), F.sort_array(F.collect_list(F.struct("k", "link_id"))).alias("s")).where("n = m")
    return nodes.join(whole.select("path_id", F.transform("s", lambda s: s["link_id"]).alias("link_seq")), "path_id")


def choice_demand(choices: DataFrame) -> DataFrame:
    """o, d, volume: trips along each alternative's chain of zones (``zone_chain``, ``;``-separated, and ``volume``), summed."""
    zones = choices.select(scalar.split_numbers(c("zone_chain"), "long").alias("z"), "volume").where(F.size("z") > 1)
    trip = F.explode(F.transform(F.sequence(F.lit(1), F.size("z") - 1), lambda i: F.struct(F.element_at("z", i).alias("o"), F.element_at("z", i + 1).alias("d"))))
    return zones.select(trip.alias("t"), "volume").groupBy("t.o", "t.d").agg(F.sum("volume").alias("volume"))


def apply_qvdf(links: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """Parameters of the queue-based function on links: of the link itself, its code, the code ``all``, the default.

    ``table``: data_type (``vdf_code`` or another), vdf_code, from_node_id, to_node_id, and some of ``names``.
    """
    have = [n for n in names if n in table.columns]
    of = lambda prefix: [F.max(n).alias(f"{prefix}_{n}") for n in have]
    codes = table.where("data_type = 'vdf_code' AND vdf_code <> 'all'").groupBy("vdf_code").agg(*of("code"))
    every = table.where("data_type = 'vdf_code' AND vdf_code = 'all'").agg(*of("all"))
    own = table.where("data_type <> 'vdf_code'").groupBy("from_node_id", "to_node_id").agg(*of("own"))
    out = links.join(own, ["from_node_id", "to_node_id"], "left").join(F.broadcast(codes), "vdf_code", "left").crossJoin(F.broadcast(every))
    values = {n: F.coalesce(*([c(f"{p}_{n}") for p in ("own", "code", "all")] if n in have else []), F.lit(vdf.DEFAULTS[n])) for n in names}
    return out.withColumns(values).drop(*(f"{p}_{n}" for p in ("own", "code", "all") for n in have))


