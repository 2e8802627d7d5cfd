"""A road network, demand and observations derived from the sample tables by integer rules.

Zones are nations on a 5 x 5 lattice; demand follows the lines of orders from the supplier's nation to the customer's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import vdf

#: Value of time (money an hour), persons and car units of each mode.
MODES = [("auto", 0, 10.0, 1.0, 1.0), ("hov", 1, 20.0, 2.0, 1.0), ("truck", 2, 10.0, 1.0, 2.0)]
#: Name, number, first and last hour.
PERIODS = [("am", 0, 7.0, 8.0), ("md", 1, 12.0, 13.0), ("pm", 2, 17.0, 18.0)]
#: All trips of a day, whatever the number of rows.
TRIPS = 60000.0
RETURN_MODE = {"A": "auto", "N": "hov", "R": "truck"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select((k + 1).alias("node_id"), (k + 1).alias("zone_id"), F.col("n_regionkey").cast("long").alias("district_id"), (-90.0 + 0.05 * (k % 5)).alias("x"), (40.0 + 0.05 * F.floor(k / 5)).alias("y"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions between lattice neighbours, with the attributes a link file would give and those derived from them."""
    c = F.col
    start = nodes(spark, sf_dir).select(c("node_id").alias("from_node_id"))
    k = c("from_node_id") - 1
    step = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    moved = start.withColumn("s", F.explode(step)).withColumn("i", k % 5 + c("s.dx")).withColumn("j", F.floor(k / 5) + c("s.dy")).where("i BETWEEN 0 AND 4 AND j BETWEEN 0 AND 4")
    ab = moved.select("from_node_id", (c("j") * 5 + c("i") + 1).alias("to_node_id"))
    f, t = c("from_node_id"), c("to_node_id")
    raw = ab.select(
        (100 * f + t).alias("link_id"), "from_node_id", "to_node_id", (2 + (7 * f + 3 * t) % 9).cast("double").alias("length_mile"), (30 + 10 * ((f + t) % 4)).cast("double").alias("free_speed_mph"),
        (1 + (f + t) % 3).cast("double").alias("lanes"), (1200 + 300 * ((f * t) % 5)).cast("double").alias("capacity"), (1 + f % 3).alias("link_type"),
        F.when((f * t) % 11 == 0, 1.0).otherwise(0.0).alias("toll_auto"), F.when((100 * f + t) % 7 == 0, 1000.0 + 10 * ((100 * f + t) % 50)).alias("ref_volume"),
        F.when(f % 3 == 0, "auto;hov").when(f % 3 == 1, "").otherwise("null").alias("allowed_uses"),
    )
    return with_units(raw)


def with_units(raw: DataFrame) -> DataFrame:
    """Metric lengths and speeds, free-flow time, cutoff speed and storage of links in miles and miles an hour."""
    c = F.col
    out = raw.withColumn("length_m", F.greatest(F.lit(1.0), c("length_mile") * 1609)).withColumn("distance_km", c("length_m") / 1000).withColumn("vf", c("free_speed_mph") * vdf.MPH)
    return out.withColumn("vc", 0.85 * c("vf")).withColumn("fftt", c("distance_km") / c("vf") * 60).withColumn("spatial_capacity", F.greatest(F.lit(1.0), c("distance_km") * c("lanes") * 200))


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODES, "mode string, mode_no int, vot double, occupancy double, pce double")


def periods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERIODS, "period string, period_no int, start_hour double, end_hour double").withColumn("hours", F.col("end_hour") - F.col("start_hour"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, d, mode, period, volume: a day's trips dealt by the number of order lines; trips within a zone are left in.

    Customers and suppliers are read as key and nation alone, orders as key, nation and month, and lines are counted after one
    shuffle by order.
    """
    c = F.col
    buyer = table(spark, sf_dir, "customer").select("c_custkey", (c("c_nationkey").cast("long") + 1).alias("d"))
    seller = table(spark, sf_dir, "supplier").select("s_suppkey", (c("s_nationkey").cast("long") + 1).alias("o"))
    month = F.month("o_orderdate")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(month <= 4, "am").when(month <= 8, "md").otherwise("pm").alias("period")).join(buyer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "d", "period")
    mode = reduce(lambda e, kv: e.when(c("l_returnflag") == kv[0], kv[1]), RETURN_MODE.items(), F)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", mode.alias("mode")).join(seller, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "o", "mode")
    counted = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o", "d", "mode", "period").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.crossJoin(F.broadcast(total)).select("o", "d", "mode", "period", (c("n") * TRIPS / c("total")).alias("volume"))


def probe_volumes(links_: DataFrame, periods_: DataFrame) -> DataFrame:
    """Links by period with a made-up volume, and default parameters of the volume-delay functions, for formula queries."""
    c = F.col
    out = links_.crossJoin(F.broadcast(periods_)).withColumn("volume", (200 + (c("link_id") * 37 + 911 * c("period_no")) % 4000).cast("double"))
    for name, value in vdf.DEFAULTS.items():
        out = out.withColumn(name, F.lit(value))
    return out
