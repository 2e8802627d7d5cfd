"""Fitting path volumes to counts on links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
#: Largest change of a path's volume in a round.
LIMIT = 0.1


def sensors(links: DataFrame, period: str | None = None) -> DataFrame:
    """link_id, observed of links with a count of at least 1."""
    return links.where("ref_volume >= 1").select("link_id", c("ref_volume").alias("observed"))


def deviations(pool: DataFrame, sensors_: DataFrame, preload: float = 0.0) -> DataFrame:
    """link_id, period, observed, estimated, deviation of each sensor and period; only sensor links are tallied."""
    steps = pool.select("period", F.explode("link_seq").alias("link_id"), "volume").join(sensors_.select("link_id"), "link_id", "left_semi")
    sums = steps.groupBy("link_id", "period").agg(F.sum("volume").alias("estimated"))
    every = sensors_.crossJoin(F.broadcast(pool.select("period").distinct()))
    out = every.join(sums, ["link_id", "period"], "left").withColumn("estimated", F.coalesce("estimated", F.lit(0.0)))
    return out.withColumn("deviation", c("estimated") + preload - c("observed"))


def step(pool: DataFrame, deviations_: DataFrame, n: int) -> DataFrame:
    """One gradient step, the n-th from 0: each path that passes a sensor loses its summed deviations over n + 2, within a tenth."""
    keys = ["o", "d", "mode", "period", "path"]
    felt = pool.select(*keys, F.explode("link_seq").alias("link_id")).join(deviations_.select("link_id", "period", "deviation"), ["link_id", "period"]).groupBy(*keys).agg(F.sum("deviation").alias("gradient"))
    out = pool.join(felt, keys, "left")
    change = F.greatest(-LIMIT * c("volume"), F.least(LIMIT * c("volume"), c("gradient") / (n + 2)))
    return out.withColumn("volume", F.when(c("gradient").isNull(), c("volume")).otherwise(F.greatest(F.lit(0.0), c("volume") - change))).drop("gradient")


def metrics(deviations_: DataFrame) -> DataFrame:
    """One row: mean absolute error, mean absolute and mean percentage error over sensors."""
    share = c("deviation") / F.greatest(F.lit(1.0), c("observed")) * 100
    return deviations_.agg(F.count("*").alias("sensors"), F.avg(F.abs("deviation")).alias("mae"), F.avg(F.abs(share)).alias("mape"), F.avg(share).alias("mpe"))
