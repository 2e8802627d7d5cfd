"""The assignment driver: successive averages over paths, updates of the pool, estimation, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import columns, estimation, loading, routing
from netloom.plans import lineage


@dataclass(frozen=True)
class Inputs:
    """Tables of a run: links and modes and periods of one network, and demand by o, d, mode, period."""

    links: DataFrame
    modes: DataFrame
    periods: DataFrame
    demand: DataFrame
    share: float = loading.PERIOD_SHARE
    rules: loading.Rules = loading.Rules()
    banned: DataFrame | None = None  #: link_id, next_link_id of turns that may not be made
    banned_modes: tuple[str, ...] | None = None  #: by whom; by all if None
    fixed: DataFrame | None = None  #: o, d, mode, period, path, link_seq, volume that stay on their paths


@dataclass(frozen=True)
class Result:
    pool: DataFrame
    performance: DataFrame
    gap_percent: float


def performance(i: Inputs, pool: DataFrame | None) -> DataFrame:
    paths = [x.select("mode", "period", "link_seq", "volume") for x in (pool, i.fixed) if x is not None]
    volume = loading.volumes(loading.tally(reduce(DataFrame.unionByName, paths), i.modes)) if paths else None
    return loading.performance(i.links, i.periods, volume, i.share, i.rules)


def link_costs(i: Inputs, pool: DataFrame | None) -> DataFrame:
    return loading.costs(performance(i, pool), i.modes, i.rules)


def network(i: Inputs, costs: DataFrame) -> routing.Network:
    return routing.network(costs, banned=i.banned, banned_modes=i.banned_modes)


def generate(i: Inputs, rounds: int, lag: int = 0) -> DataFrame:
    """A pool of paths after so many rounds of column generation by successive averages.

    Round k searches with the link times of the volumes before it; ``lag`` 1 takes those of one round earlier, so that the
    first two rounds both see the empty network.
    """
    pool: DataFrame | None = None
    seen: list[DataFrame | None] = [None] * (lag + 1)
    for k in range(rounds):
        net = network(i, link_costs(i, seen[0]))
        pool = lineage.cut(columns.merge(pool, loading.all_or_nothing(i.demand, net), k))
        seen = [*seen[1:], pool]
    return pool


def update(i: Inputs, pool: DataFrame, rounds: int, gap_percent: float = 0.001) -> Result:
    """The pool after at most ``rounds`` shifts towards least-cost paths, fewer if the relative gap falls below the bound."""
    gap = float("inf")
    for n in range(rounds):
        costed = columns.with_costs(pool, link_costs(i, pool))
        gap = columns.gap(costed).first()["gap_percent"]
        if gap < gap_percent:
            break
        pool = lineage.cut(columns.shift(costed, n))
    return Result(pool, performance(i, pool), gap)


def estimate(i: Inputs, pool: DataFrame, sensors: DataFrame, rounds: int = 50) -> tuple[DataFrame, list[dict]]:
    """The pool fitted to counts, and the errors of each round.

    It stops after five rounds once the mean error grows by more than a hundredth or falls below it.
    """
    log: list[dict] = []
    for n in range(rounds):
        found = lineage.cut(estimation.deviations(pool, sensors))
        row = estimation.metrics(found).first().asDict()
        log.append(row)
        if n >= 5 and (row["mae"] > log[-2]["mae"] + 0.01 or row["mae"] < 0.01):
            break
        pool = lineage.cut(estimation.step(pool, found, n))
    return pool, log


def run(i: Inputs, rounds: int = 20, updates: int = 40, gap_percent: float = 0.001, lag: int = 0) -> Result:
    """Column generation and updates: the user equilibrium of the demand on the network."""
    return update(i, generate(i, rounds, lag), updates, gap_percent)


def _open_costs(i: Inputs, pool: DataFrame, closed: DataFrame) -> DataFrame:
    """Link costs with the pool's volumes; links of ``closed`` (link_id) are shut."""
    shut = closed.select("link_id", F.lit(True).alias("_shut"))
    costs = link_costs(i, pool).join(F.broadcast(shut), "link_id", "left")  # a scenario's short list
    return costs.withColumn("cost", F.when(F.col("_shut"), -1).otherwise(F.col("cost"))).drop("_shut")


#: What a new path adds to the cost of its links for those who are dealt with after it.
NEW_PATH_PENALTY = 0.25


def regenerate(i: Inputs, pool: DataFrame, closed: DataFrame, informed: list[str], turns: int = 1) -> DataFrame:
    """The pool with one more path, of no volume yet, for each cell of the informed modes: the best that uses no closed link.

    With several ``turns`` origins are dealt with one part after another, and links of new paths cost a quarter more for later parts, so
    that not all are sent the same way.
    """
    costs = _open_costs(i, pool, closed)
    cells = i.demand.where(F.col("mode").isin(informed))
    parts = []
    for turn in range(turns):
        mine = cells.where(F.pmod(F.xxhash64("o"), F.lit(turns)) == turn)
        parts.append(lineage.cut(loading.all_or_nothing(mine, network(i, costs))))
        if turn + 1 < turns:
            used = parts[-1].select("mode", "period", F.explode("link_seq").alias("link_id")).distinct().withColumn("_used", F.lit(True))
            dearer = F.when(F.col("_used") & (F.col("cost") >= 0), F.round(F.col("cost") * (1 + NEW_PATH_PENALTY)).cast("long")).otherwise(F.col("cost"))
            costs = lineage.cut(costs.join(used, ["mode", "period", "link_id"], "left").withColumn("cost", dearer).drop("_used"))
    found = reduce(DataFrame.unionByName, parts)
    keys = [*columns.CELL, "path"]
    new = found.select(*columns.CELL, columns.path_key("link_seq").alias("path"), "link_seq", F.lit(0.0).alias("volume"))
    return pool.select(*keys, "link_seq", "volume").unionByName(new).groupBy(*keys).agg(F.first("link_seq").alias("link_seq"), F.sum("volume").alias("volume"))


#: Minutes that a closed link takes those who do not know of it.
CLOSED_MIN = 1440.0
#: Least share of a shift in a scenario.
SCENARIO_STEP = 0.05


def sensitivity(i: Inputs, pool: DataFrame, closed: DataFrame, informed: list[str], rounds: int = 20) -> Result:
    """What closures change: informed modes get a way round and shift to it, the others stay on their paths.

    Closed links take a day's minutes; each round shifts at least a twentieth.
    """
    if not informed:
        raise ValueError("a closure needs a mode with real-time information")
    pool = lineage.cut(regenerate(i, pool, closed, informed))
    day = closed.select("link_id", F.lit(CLOSED_MIN).alias("_min"))
    links = lineage.cut(i.links.join(F.broadcast(day), "link_id", "left").withColumn("fftt", F.coalesce("_min", "fftt")).drop("_min"))
    shut = replace(i, links=links)
    gap = float("inf")
    for n in range(rounds):
        costed = columns.with_costs(pool, link_costs(shut, pool))
        gap = columns.gap(costed).first()["gap_percent"]
        pool = lineage.cut(columns.shift(costed, n - 1 if n else 0, SCENARIO_STEP, informed))
    return Result(pool, performance(shut, pool), gap)


def link_based(i: Inputs, rounds: int) -> DataFrame:
    """link_id, period, volume by successive averages over links alone, without paths."""
    volume: DataFrame | None = None
    for k in range(rounds):
        perf = loading.performance(i.links, i.periods, volume, i.share, i.rules)
        net = network(i, loading.costs(perf, i.modes, i.rules))
        loaded = loading.volumes(loading.tally(loading.all_or_nothing(i.demand, net), i.modes))
        volume = lineage.cut(loading.average(volume, loaded, k))
    return volume


def sample_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """Inputs derived from the sample tables."""
    from netloom.operators import demand
    from netloom.sources import derive

    od = demand.between_zones(derive.demand(spark, sf_dir), derive.nodes(spark, sf_dir))
    return Inputs(derive.links(spark, sf_dir), derive.modes(spark), derive.periods(spark), od.where(F.col("volume") > 1e-6))
