"""Pools of paths: successive averages over paths, costs and gaps, and shifts to the least-cost path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import routing

c = F.col
CELL = ["o", "d", "mode", "period"]


def path_key(links) -> F.Column:
    """The path as text: its link numbers, each of a fixed width, so that text order is the order of link sequences."""
    return F.array_join(F.transform(links, lambda x: F.lpad(x.cast("string"), 10, "0")), ";")


def merge(pool: DataFrame | None, found: DataFrame, k: int, fixed: str | None = None) -> DataFrame:
    """The pool after round k: old volumes times k / (k + 1), and 1 / (k + 1) of each cell's demand on the path now found.

    Paths are the same if their links are; ``found`` is the round in which a path first was. Fixed routes (flag column ``fixed`` of
    the pool) keep their volume.
    """
    keys = [*CELL, "path"]
    new = found.select(*CELL, path_key("link_seq").alias("path"), "link_seq", (c("volume") / (k + 1)).alias("volume"), F.lit(k).alias("found"))
    if pool is not None:
        kept = c("volume") * k / (k + 1)
        old = pool.select(*keys, "link_seq", (F.when(c(fixed), c("volume")).otherwise(kept) if fixed else kept).alias("volume"), "found")
        new = old.unionByName(new)
    return new.groupBy(*keys).agg(F.first("link_seq").alias("link_seq"), F.sum("volume").alias("volume"), F.min("found").alias("found"))


def numbered(pool: DataFrame) -> DataFrame:
    """The pool with ``path_seq_no``: 0, 1, ... in each cell in the order in which paths were found, those of one round by their links."""
    return pool.withColumn("path_seq_no", F.row_number().over(Window.partitionBy(*CELL).orderBy("found", "path")).cast("long") - 1)


def with_costs(pool: DataFrame, link_costs: DataFrame) -> DataFrame:
    """The pool with ``cost`` (long), the sum over each path's links; the cost table is one network's and is broadcast when small."""
    steps = pool.select(*CELL, "path", F.explode("link_seq").alias("link_id"))
    summed = steps.join(link_costs.select("link_id", "mode", "period", F.col("cost").alias("step")), ["link_id", "mode", "period"]).groupBy(*CELL, "path").agg(F.sum("step").alias("cost"))
    return pool.drop("cost").join(summed, [*CELL, "path"])


def gap(costed: DataFrame) -> DataFrame:
    """One row: demand, total and least minutes (all paths at the least cost of their cell), relative gap in percent, mean minutes."""
    cell = costed.groupBy(*CELL).agg(F.sum("volume").alias("v"), F.sum(c("volume") * c("cost")).alias("t"), F.min("cost").alias("least"))
    out = cell.agg(F.sum("v").alias("demand"), (F.sum("t") / routing.MICRO).alias("total_min"), (F.sum(c("v") * c("least")) / routing.MICRO).alias("least_min"))
    return out.withColumn("gap_percent", F.greatest(F.lit(0.0), (c("total_min") - c("least_min")) / c("least_min")) * 100).withColumn("mean_min", c("total_min") / c("demand"))


#: Updates before a bound on what a path gives holds.
FREE_UPDATES = 5


def shift(costed: DataFrame, n: int, least_step: float = 0.0, informed: list[str] | None = None, bound: float | None = None) -> DataFrame:
    """One update of path volumes, the n-th from 0, in each cell with two paths or more; of the informed modes alone, if they are given.

    A path gives 1 / (n + 2) of max(0, its cost - the least) / the largest cost, of the cell's demand, at most its volume; all that
    is given goes to the least-cost path, the first of equals. The largest cost is at least one minute. With a ``bound`` no path gives
    more than that, from the FREE_UPDATES-th update on.
    """
    cell = Window.partitionBy(*CELL)
    out = costed.withColumns({"_v": F.sum("volume").over(cell), "_least": F.min(F.struct("cost", "path")).over(cell), "_most": F.greatest(F.lit(routing.MICRO), F.max("cost").over(cell)), "_n": F.count("*").over(cell)})
    step = max(1 / (n + 2), least_step)
    given = F.least(c("volume"), F.lit(step) * F.greatest(F.lit(0), c("cost") - c("_least.cost")) / c("_most") * c("_v"))
    if bound is not None and n >= FREE_UPDATES:
        given = F.least(given, F.lit(bound))
    moves = (c("_n") > 1) & (c("mode").isin(informed) if informed is not None else F.lit(True))
    out = out.withColumn("_given", F.when(moves, given).otherwise(0.0)).withColumn("_all", F.sum("_given").over(cell))
    moved = F.when(c("path") == c("_least.path"), c("volume") + c("_all")).otherwise(c("volume") - c("_given"))
    return out.withColumn("volume", moved).drop("_v", "_least", "_most", "_n", "_given", "_all")


def impacted(pool: DataFrame, closed: DataFrame) -> DataFrame:
    """The pool with path_impacted, od_impacted, closed_links: whether a path, or some path of its cell, uses a closed link.

    Closures are a short list of links.
    """
    listed = closed.agg(F.collect_set("link_id").alias("closed"))
    out = pool.crossJoin(F.broadcast(listed)).withColumn("closed_links", F.size(F.array_intersect("link_seq", "closed"))).drop("closed")
    return out.withColumn("path_impacted", c("closed_links") > 0).withColumn("od_impacted", F.max("path_impacted").over(Window.partitionBy(*CELL)))
