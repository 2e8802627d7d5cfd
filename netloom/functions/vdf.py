"""Volume-delay functions as Column expressions.

Columns that the formulas read: fftt (min), vf and vc (free-flow and cutoff speed, km/h), capacity (a lane and hour), lanes,
hours (of the period), plf (peak load factor), alpha, beta, and for the queue-based form q_alpha, q_beta, q_cd, q_n, q_cp, q_s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults of the parameters.
DEFAULTS = {"alpha": 0.15, "beta": 4.0, "plf": 1.0, "q_alpha": 0.15, "q_beta": 4.0, "q_cd": 1.0, "q_n": 1.0, "q_cp": 0.28125, "q_s": 4.0}
MPH = 1.609


def demand_capacity(volume: Column, hours: Column, lanes: Column, plf: Column, capacity: Column) -> tuple[Column, Column]:
    """(lane demand an hour, ratio of demand to capacity); below 0.6 lanes the lanes count with the capacity."""
    hourly = F.greatest(volume, F.lit(0.0)) / F.greatest(hours, F.lit(0.1)) / plf
    demand = F.when(lanes < 0.6, hourly).otherwise(hourly / F.greatest(lanes, F.lit(1e-6)))
    return demand, F.when(lanes < 0.6, demand / F.greatest(capacity * lanes, F.lit(1e-5))).otherwise(demand / F.greatest(capacity, F.lit(1e-5)))


def bpr_time(fftt: Column, ratio: Column, alpha: Column, beta: Column) -> Column:
    return fftt * (1 + alpha * F.pow(ratio, beta))


def bpr(df: DataFrame) -> DataFrame:
    """``df`` with doc, bpr_min, bpr_speed, bpr_wait."""
    _, ratio = demand_capacity(*(F.col(c) for c in ("volume", "hours", "lanes", "plf", "capacity")))
    out = df.withColumn("doc", ratio)
    out = out.withColumn("bpr_min", bpr_time(F.col("fftt"), F.col("doc"), F.col("alpha"), F.col("beta")))
    return out.withColumn("bpr_speed", F.col("vf") / (1 + F.col("alpha") * F.pow("doc", F.col("beta")))).withColumn("bpr_wait", F.col("bpr_min") - F.col("fftt"))


def qvdf(df: DataFrame) -> DataFrame:
    """``df`` (with start_hour and end_hour) with the queue-based measures: doc, q_speed, q_min, q_wait, p, vt2, t0, t3, mu, gamma.

    Below capacity the speed follows a curve through the cutoff speed, above it the queue's. q_wait is taken before the time
    is held to the larger of 15 minutes and one and a half periods.
    """
    c = F.col
    demand, ratio = demand_capacity(*(c(k) for k in ("volume", "hours", "lanes", "plf", "capacity")))
    out = df.withColumn("lane_demand", demand).withColumn("doc", ratio)
    free = c("doc") < 1
    bend = (1 + c("q_alpha")) * c("vf") / F.greatest(F.lit(1e-4), c("vc")) - 1
    speed = F.when(free, c("vf") / (1 + bend * F.pow("doc", c("beta")))).otherwise(c("vc") / (1 + c("q_alpha") * F.pow("doc", c("q_beta"))))
    out = out.withColumn("q_speed", speed).withColumn("_time", c("fftt") * c("vf") / F.greatest(F.lit(0.1), c("q_speed")))
    out = out.withColumn("q_wait", c("_time") - c("fftt")).withColumn("q_min", F.least(c("_time"), F.greatest(F.lit(15.0), c("hours") * 90.0))).drop("_time")
    out = out.withColumn("p", c("q_cd") * F.pow("doc", F.when(free, c("beta")).otherwise(c("q_n"))))
    out = out.withColumn("vt2", c("vc") / F.greatest(F.lit(0.001), c("q_cp") * F.pow("p", c("q_s")) + 1))
    mid = (c("start_hour") + c("end_hour")) / 2
    out = out.withColumn("t0", mid - c("p") / 2).withColumn("t3", mid + c("p") / 2)
    out = out.withColumn("mu", F.least(c("capacity"), c("lane_demand") / F.greatest(F.lit(0.01), c("p"))))
    out = out.withColumn("rtt", F.when(free, 1 / F.greatest(F.lit(0.01), c("vf"))).otherwise(1 / c("vc")))
    gamma = (1 / c("vt2") - c("rtt")) * 64 * c("mu") / F.pow("p", F.lit(4.0))
    return out.withColumn("gamma", F.when(c("p") > 0, gamma).otherwise(F.lit(0.0)))


def qvdf_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, minute, speed: the speed every 5 minutes of the period, from the columns that ``qvdf`` adds."""
    c = F.col
    marks = F.sequence((c("start_hour") * 60).cast("int"), (c("end_hour") * 60).cast("int"), F.lit(5))
    out = df.withColumn("minute", F.explode(marks)).withColumn("_t", c("minute") / 60.0)
    queue = 0.25 * c("gamma") * F.pow(c("_t") - c("t0"), F.lit(2.0)) * F.pow(c("_t") - c("t3"), F.lit(2.0))
    inside = 1 / (queue / F.greatest(F.lit(0.001), c("mu")) + c("rtt"))
    low = F.greatest(c("vc"), c("q_speed"))
    before = (c("_t") - c("start_hour")) / F.greatest(F.lit(0.001), c("t0") - c("start_hour"))
    after = (c("_t") - c("t3")) / F.greatest(F.lit(0.001), c("end_hour") - c("t3"))
    speed = F.when((c("t0") <= c("_t")) & (c("_t") <= c("t3")), inside).when(c("_t") < c("t0"), (1 - before) * c("vf") + before * low).otherwise((1 - after) * low + after * c("vf"))
    return out.select(*keys, "minute", speed.alias("speed"), "vf")


def emission_kg(minutes: Column, fftt: Column, vf: Column, rate: Column) -> Column:
    """Kilograms a vehicle emits, from an array of four coefficients.

    The speed is converted to miles twice, and the ratio takes the speed from the product; both are part of the formula.
    """
    vf_mph = vf / MPH
    v = vf_mph / F.greatest(F.lit(1e-5), minutes / fftt) / MPH
    quadratic = v * v * rate[1] + v * rate[2] + rate[3]
    ratio = F.when(F.abs(vf_mph - v) > 1, (quadratic * vf_mph - v) / (vf_mph - v)).otherwise(F.lit(0.0))
    return rate[0] * (fftt / 60 + (minutes - fftt) / 60 * ratio) / 1000


def signal_delay(red: Column, cycle: Column, hourly: Column) -> Column:
    """Uniform delay in minutes at a signal."""
    return red * red / (2 * cycle) / 60 / F.greatest(F.lit(0.1), 1 - hourly / 1800)


def s3_speed(volume: Column, vf: Column, k_critical: Column, m: Column, kept: Column) -> Column:
    """Speed at a density of volume / kept speed, by the S-shaped three-parameter model."""
    return vf / F.pow(1 + F.pow(volume / F.greatest(F.lit(0.1), kept) / k_critical, m), 2 / m)


def s3_volume(speed: Column, vf: Column, k_critical: Column, m: Column) -> Column:
    """Flow at a speed, by the same model."""
    ratio = F.greatest(vf / F.greatest(speed, F.lit(0.1)), F.lit(1.0))
    return speed * k_critical * F.pow(F.pow(ratio, m / 2) - 1, 1 / m)


def gradient_cost(minutes: Column, penalty: Column, toll: Column, vot: Column) -> Column:
    """Generalised cost in minutes: time, penalty, and the toll at the value of time."""
    return minutes + penalty + toll / vot * 60
