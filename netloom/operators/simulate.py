"""Mesoscopic simulation: agents, capacities, signals, a queue kernel, and what is counted from it.

The kernel moves vehicles through entrance and exit queues of links in small steps of time, which is sequential by nature. It runs
once for each group (a period, a scenario, or a subarea with its own network), so groups go side by side; everything before
and after it is tables.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import demand

c = F.col
#: Multiplier, modulus and seed of the linear congruential generator of capacity rounding.
LCG = (17364, 65521, 101)


def lcg(n: int, seed: int = LCG[2]) -> np.ndarray:
    """The first n uniform numbers of the generator, in [0, 1)."""
    out, state = np.empty(n), seed
    for i in range(n):
        state = LCG[0] * state % LCG[1]
        out[i] = state / LCG[1]
    return out


def agents(pool: DataFrame) -> DataFrame:
    """Paths with ``n``, their number of vehicles, volume rounded half up; those of no links or vehicles are left out."""
    return pool.where(F.size("link_seq") > 0).withColumn("n", F.floor(c("volume") + 0.5).cast("int")).where("n > 0")


def vehicles(pool: DataFrame, start_min: dict[str, float], span_min: float = 60.0) -> DataFrame:
    """One row per vehicle: agent_id, period, link_seq, departure_s; a path's vehicles leave evenly over the period.

    Numbers are given by path and vehicle, so they do not depend on how rows are dealt.
    """
    first = F.create_map(*(x for k, v in start_min.items() for x in (F.lit(k), F.lit(v))))
    out = agents(pool).withColumn("v", F.explode(F.sequence(F.lit(0), c("n") - 1)))
    key = F.xxhash64("o", "d", "mode", "period", "path", "v")
    return out.select(key.alias("agent_id"), "o", "d", "mode", "period", "link_seq", ((F.element_at(first, c("period")) + (c("v") + 0.5) / c("n") * span_min) * 60).alias("departure_s"))


def profiled(pool: DataFrame, slots: DataFrame) -> DataFrame:
    """One row per vehicle as ``vehicles`` gives, leaving by a departure profile (slot of 5 minutes, weight) instead of evenly."""
    keys = ["o", "d", "mode", "period", "path", "link_seq"]
    out = demand.departures(agents(pool).select(*keys, "n"), demand.profile(slots))
    late = (c("v") % 3) / 3 * 0.05  # minutes, by the vehicle's number
    return out.select(F.xxhash64("o", "d", "mode", "period", "path", "v").alias("agent_id"), "o", "d", "mode", "period", "link_seq", ((c("departure_min") + late) * 60).alias("departure_s"))


def capacity_seconds(links: DataFrame, seconds: int) -> DataFrame:
    """link_id, second, capacity: whole vehicles that may leave each second; fractions add up to the hourly rate."""
    rate = c("capacity") * c("lanes") / 3600
    at = links.select("link_id", rate.alias("rate"), F.explode(F.sequence(F.lit(0), F.lit(seconds - 1))).alias("second"))
    return at.select("link_id", "second", (F.floor(c("rate") * (c("second") + 1)) - F.floor(c("rate") * c("second"))).cast("int").alias("capacity"))


def signal_seconds(links: DataFrame, seconds: int) -> DataFrame:
    """link_id, second, state, capacity at signals (cycle_s, green_s, green_len_s; green may go on into the next cycle).

    Outside green nothing leaves; inside, one vehicle a lane in even seconds.
    """
    at = links.select("link_id", "lanes", "cycle_s", "green_s", "green_len_s", F.explode(F.sequence(F.lit(0), F.lit(seconds - 1))).alias("second"))
    green = F.pmod(c("second") - c("green_s"), c("cycle_s")) < c("green_len_s")
    return at.select("link_id", "second", green.cast("int").alias("state"), F.when(green & (c("second") % 2 == 0), c("lanes")).otherwise(0.0).alias("capacity"))


def state_runs(states: DataFrame) -> DataFrame:
    """link_id, state, first, last second of each run of one state."""
    order = Window.partitionBy("link_id").orderBy("second")
    change = (c("state") != F.lag("state", 1).over(order)).cast("int")
    marked = states.withColumn("_run", F.sum(F.coalesce(change, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("link_id", "_run", "state").agg(F.min("second").alias("first"), F.max("second").alias("last")).drop("_run")


Detours = dict[tuple[int, int], tuple[list[int], int]]


def queue_kernel(cars: pd.DataFrame, net: pd.DataFrame, step_s: float, tail_min: float, detours: Detours | None = None) -> pd.DataFrame:
    """agent_id, k, link_id, arrival_s, departure_s of each vehicle on each of its links; departure null if it never left.

    Each step: due vehicles enter their first link; on every node the links that end there take turns (the first in turn moves with
    the step) and pass vehicles on while they have capacity, the head of their exit queue has spent its free-flow time,
    and the next link has room. Trips end at their last link. A link with a signal (cycle_s above 0) passes vehicles on in its green
    time alone, and gathers no capacity in red. ``detours``: for a link with a sign and the last link of a trip, the links to take after the
    sign, and how many of a hundred vehicles, by their numbers, take them; a vehicle decides as it enters the link.
    """
    cars = cars.sort_values(["departure_s", "agent_id"], kind="stable")
    routes = [list(map(int, x)) for x in cars.link_seq]
    ids, due = cars.agent_id.to_numpy(), cars.departure_s.to_numpy()
    free = dict(zip(net.link_id, net.fftt * 60, strict=True))
    rate = dict(zip(net.link_id, net.capacity * net.lanes / 3600 * step_s, strict=True))
    room = dict(zip(net.link_id, net.spatial_capacity, strict=True))
    rate |= {int(x): n / 2 * step_s for x, cy, n in zip(net.link_id, net.cycle_s, net.lanes, strict=True) if cy > 0}  # a vehicle a lane every other second of green
    signal = {int(x): (cy, g, n) for x, cy, g, n in zip(net.link_id, net.cycle_s, net.green_s, net.green_len_s, strict=True) if cy > 0}
    at_node: dict[int, list[int]] = {}
    for link, node in sorted(zip(net.link_id, net.to_node_id, strict=True)):
        at_node.setdefault(int(node), []).append(int(link))
    queue: dict[int, deque] = {int(x): deque() for x in net.link_id}
    credit = dict.fromkeys(queue, 0.0)
    rows: list[list] = []
    place = np.zeros(len(ids), np.int64)
    if not len(ids):
        return pd.DataFrame({"agent_id": [], "k": [], "link_id": [], "arrival_s": [], "departure_s": []})
    waiting: deque[int] = deque()

    def enter(i: int, k: int, now: float) -> None:
        link = routes[i][k]
        if detours and (link, routes[i][-1]) in detours and k + 1 < len(routes[i]):
            rest, rate_ = detours[link, routes[i][-1]]
            if ids[i] % 100 < rate_:
                routes[i] = routes[i][: k + 1] + rest
        place[i] = len(rows)
        rows.append([ids[i], k, link, now, None])
        queue[link].append((i, k, now + free[link]))

    t, end, nxt, turn = float(due[0]), float(due[-1]) + tail_min * 60, 0, 0
    while t <= end:
        while nxt < len(ids) and due[nxt] <= t:
            waiting.append(nxt)
            nxt += 1
        for _ in range(len(waiting)):
            i = waiting.popleft()
            if len(queue[routes[i][0]]) < room[routes[i][0]]:
                enter(i, 0, t)
            else:
                waiting.append(i)
        for incoming in at_node.values():
            for j in range(len(incoming)):
                link = incoming[(j + turn) % len(incoming)]
                q = queue[link]
                if link in signal:
                    cycle, green, lasts = signal[link]
                    if (t - green) % cycle >= lasts:
                        continue
                credit[link] = credit[link] % 1 + rate[link]  # fractions are kept; whole places that nobody took are lost
                while q and credit[link] >= 1 and q[0][2] <= t:
                    i, k, _ = q[0]
                    if k + 1 < len(routes[i]):
                        ahead = routes[i][k + 1]
                        if len(queue[ahead]) >= room[ahead]:
                            break
                    q.popleft()
                    credit[link] -= 1
                    rows[place[i]][4] = t
                    if k + 1 < len(routes[i]):
                        enter(i, k + 1, t)
        if nxt == len(ids) and not waiting and not any(queue.values()):
            break
        t += step_s
        turn += 1
    return pd.DataFrame(rows, columns=["agent_id", "k", "link_id", "arrival_s", "departure_s"])


#: Links of one network that are broadcast to the kernel at most.
MOST_LINKS = 5_000_000


#: Vehicles of a group that one task takes at most.
MOST_VEHICLES = 5_000_000


def simulate(cars: DataFrame, links: DataFrame, group: str = "period", step_s: float = 2.0, tail_min: float = 10.0, detours: DataFrame | None = None) -> DataFrame:
    """group, agent_id, k, link_id, arrival_s, departure_s: the queue kernel run once for each group of vehicles.

    ``links`` is one network, which goes to each task after its size is checked. All traffic flow models hold a link to its storage.
    Columns cycle_s, green_s and green_len_s set signals. A group is one task, since
    what happens on a link depends on all others at that moment: it may have at most MOST_VEHICLES, else that is an error.
    ``detours`` (link_id, last_link, rest, rate): what message signs offer, a few rows; see ``queue_kernel``.
    """
    most = cars.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST_VEHICLES:
        raise ValueError(f"{most} vehicles in one group; at most {MOST_VEHICLES} are simulated by one task")
    offered = {(r["link_id"], r["last_link"]): (list(r["rest"]), r["rate"]) for r in detours.collect()} if detours is not None else None
    if (n := links.count()) > MOST_LINKS:
        raise ValueError(f"{n} links; at most {MOST_LINKS} are broadcast")
    have = links.columns
    signal = [F.coalesce(c(x), F.lit(0.0)).cast("double").alias(x) if x in have else F.lit(0.0).alias(x) for x in ("cycle_s", "green_s", "green_len_s")]
    net = links.select("link_id", "to_node_id", "fftt", "capacity", "lanes", "spatial_capacity", *signal).toPandas()
    shared = cars.sparkSession.sparkContext.broadcast(net)

    def run(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        out = queue_kernel(some, shared.value, step_s, tail_min, offered)
        out.insert(0, group, key[0])
        return out

    return cars.select(group, "agent_id", "link_seq", "departure_s").groupBy(group).applyInPandas(run, f"{group} string, agent_id long, k int, link_id long, arrival_s double, departure_s double")


def trips(events: DataFrame, links: DataFrame, group: str = "period") -> DataFrame:
    """group, agent_id, links, done, start_s, travel_s, km, worst_link (the link of the longest wait, the least of equals)."""
    met = events.join(links.select("link_id", "fftt", "distance_km"), "link_id").withColumn("wait", c("departure_s") - c("arrival_s") - c("fftt") * 60)
    out = met.groupBy(group, "agent_id").agg(
        F.count("*").alias("links"), (F.count("departure_s") == F.count("*")).alias("done"), F.min("arrival_s").alias("start_s"), (F.max("departure_s") - F.min("arrival_s")).alias("travel_s"), F.sum("distance_km").alias("km"),
        F.max_by("link_id", F.struct(F.coalesce("wait", F.lit(0.0)), -c("link_id"))).alias("worst_link"),
    )
    return out.withColumn("speed_kmph", F.when(c("travel_s") > 0, c("km") / (c("travel_s") / 3600)))


def trajectories(events: DataFrame, group: str = "period") -> DataFrame:
    """group, agent_id and its links and times, in driving order, as ``;``-separated text."""
    seen = F.sort_array(F.collect_list(F.struct("k", "link_id", "arrival_s")))
    text = lambda field: F.array_join(F.transform(c("s"), lambda x: x[field].cast("string")), ";")
    return events.groupBy(group, "agent_id").agg(seen.alias("s")).select(group, "agent_id", text("link_id").alias("link_sequence"), text("arrival_s").alias("time_sequence"))


def minute_counts(events: DataFrame, group: str = "period") -> DataFrame:
    """link_id, minute, arrivals, departures of a simulation, by minute of the day."""
    a = events.select(group, "link_id", F.floor(c("arrival_s") / 60).cast("int").alias("minute"), F.lit(1).alias("arrivals"), F.lit(0).alias("departures"))
    d = events.where("departure_s IS NOT NULL").select(group, "link_id", F.floor(c("departure_s") / 60).cast("int").alias("minute"), F.lit(0), F.lit(1))
    return a.union(d).groupBy(group, "link_id", "minute").agg(F.sum("arrivals").alias("arrivals"), F.sum("departures").alias("departures"))


def minute_waits(events: DataFrame, links: DataFrame, group: str = "period") -> DataFrame:
    """group, link_id, minute, vehicles, wait_min: minutes that vehicles wait on a link beyond its free-flow time, by the minute they arrive in."""
    met = events.where("departure_s IS NOT NULL").join(links.select("link_id", "fftt"), "link_id")
    wait = F.greatest(F.lit(0.0), (c("departure_s") - c("arrival_s")) / 60 - c("fftt"))
    return met.groupBy(group, "link_id", F.floor(c("arrival_s") / 60).cast("int").alias("minute")).agg(F.count("*").alias("vehicles"), F.sum(wait).alias("wait_min"))


def queue_positions(events: DataFrame, at_s: float, keys: list[str]) -> DataFrame:
    """keys, agent_id, position: the place, from 1, of each vehicle that is on a link at a moment, in order of arrival."""
    there = events.where((c("arrival_s") <= at_s) & (c("departure_s").isNull() | (c("departure_s") > at_s)))
    return there.select(*keys, "agent_id", F.row_number().over(Window.partitionBy(*keys).orderBy("arrival_s", "agent_id")).cast("long").alias("position"))


def cumulative(counts: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """keys, minute, ca, cd: running arrivals and departures for every minute of the span."""
    every = counts.select(*keys).distinct().withColumn("minute", F.explode(F.sequence(F.lit(first), F.lit(last))))
    order = Window.partitionBy(*keys).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    dense = every.join(counts, [*keys, "minute"], "left")
    return dense.select(*keys, "minute", F.sum(F.coalesce("arrivals", F.lit(0))).over(order).alias("ca"), F.sum(F.coalesce("departures", F.lit(0))).over(order).alias("cd"))


def td_performance(cum: DataFrame, keys: list[str], interval: int = 15) -> DataFrame:
    """Inflow, outflow, queue, density, queue ratio and travel minutes at each full interval.

    ``cum``: keys, minute, ca, cd, distance_km, lanes, fftt, k_jam. The wait of an interval is its vehicle minutes in queue.
    """
    order = Window.partitionBy(*keys).orderBy("minute")
    back = lambda x: F.lag(x, interval, 0).over(order)
    held = F.sum(c("ca") - c("cd")).over(order.rowsBetween(-(interval - 1), 0))
    out = cum.withColumns({"inflow": c("ca") - back("ca"), "outflow": c("cd") - back("cd"), "queue": c("ca") - c("cd"), "_held": held})
    out = out.where(c("minute") % interval == interval - 1).withColumn("density", c("queue") / (c("distance_km") * c("lanes")))
    out = out.withColumn("queue_ratio", F.least(F.lit(1.0), c("density") / c("k_jam")))
    return out.withColumn("travel_min", c("fftt") + F.when(c("inflow") > 0, c("_held") / c("inflow")).otherwise(0.0)).select(*keys, "minute", "inflow", "outflow", "queue", "density", "queue_ratio", "travel_min")


def rerouted(cars: DataFrame, alternatives: DataFrame, at_min: float, share: int = 50) -> DataFrame:
    """Vehicles that leave after a minute and answer a message sign take their cell's alternative: agent number modulo 100 below ``share``.

    ``alternatives``: o, d, mode, period, alt_seq.
    """
    met = cars.join(alternatives, ["o", "d", "mode", "period"], "left")
    answers = (c("departure_s") >= at_min * 60) & (F.pmod("agent_id", F.lit(100)) < share) & c("alt_seq").isNotNull()
    return met.withColumn("rerouted", answers).withColumn("link_seq", F.when(answers, c("alt_seq")).otherwise(c("link_seq"))).drop("alt_seq")


def diversion(cars: DataFrame) -> DataFrame:
    """mode, period, vehicles, rerouted and the share of those that ``rerouted`` marked."""
    out = cars.groupBy("mode", "period").agg(F.count("*").alias("vehicles"), F.count_if("rerouted").alias("rerouted"))
    return out.withColumn("share", c("rerouted") / c("vehicles"))
