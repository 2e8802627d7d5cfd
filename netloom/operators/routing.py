"""Shortest path trees per origin, by a kernel over a broadcast network, and the same in DataFrames as a cross-check.

Costs are whole millionths of a minute, so sums are exact and ties are real; of equal routes the one with the least sequence
of link numbers is taken. The network goes to each task as arrays once; origins are dealt over tasks. Where turns are banned,
labels are kept for links instead of nodes, which is exact. A node with a number below 0 is a zone's centroid: trips begin and end
there, and none passes it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000
#: Costs of links by mode and period that are broadcast at most.
MOST_COSTS = 50_000_000


@dataclass(frozen=True)
class Star:
    """Links that leave each node: those of node i are first[i]:first[i + 1], by link number."""

    node_ids: np.ndarray
    first: np.ndarray
    head: np.ndarray
    link_ids: np.ndarray

    def index(self) -> dict[int, int]:
        return {int(n): i for i, n in enumerate(self.node_ids)}


@dataclass(frozen=True)
class Network:
    """A star and its costs for each (mode, period); a cost below 0 closes a link.

    ``banned``: pairs of links that may not follow each other, for ``banned_modes`` alone if these are given.
    """

    star: Star
    costs: dict[tuple[str, str], np.ndarray]
    banned: frozenset[tuple[int, int]] = frozenset()
    banned_modes: frozenset[str] | None = None

    def bans(self, mode: str) -> frozenset[tuple[int, int]]:
        return self.banned if self.banned_modes is None or mode in self.banned_modes else frozenset()


def network(costs: DataFrame, reverse: bool = False, banned: DataFrame | None = None, banned_modes: tuple[str, ...] | None = None) -> Network:
    """A network from link_id, from_node_id, to_node_id, mode, period, cost (long), all modes and periods of a few nodes' links.

    The table is checked before it comes to the driver: it has a row for each link, mode and period of one network.
    """
    n = costs.count()
    if n > MOST_COSTS:
        raise ValueError(f"{n} link costs; at most {MOST_COSTS} are broadcast")
    rows = costs.select("link_id", "from_node_id", "to_node_id", "mode", "period", "cost").toPandas()
    if reverse:
        rows = rows.rename(columns={"from_node_id": "to_node_id", "to_node_id": "from_node_id"})
    links = rows[["link_id", "from_node_id", "to_node_id"]].drop_duplicates("link_id").sort_values(["from_node_id", "link_id"])
    node_ids = np.unique(np.concatenate((links.from_node_id, links.to_node_id))) if len(links) else np.zeros(0, np.int64)
    star = Star(node_ids, np.searchsorted(links.from_node_id.to_numpy(), np.append(node_ids, np.iinfo(np.int64).max)), np.searchsorted(node_ids, links.to_node_id.to_numpy()), links.link_id.to_numpy())
    place = {int(x): i for i, x in enumerate(star.link_ids)}
    by: dict[tuple[str, str], np.ndarray] = {}
    for (mode, period), part in rows.groupby(["mode", "period"]):
        cost = np.full(len(star.link_ids), -1, np.int64)
        cost[[place[int(x)] for x in part.link_id]] = part.cost.to_numpy()
        by[str(mode), str(period)] = cost
    pairs = frozenset((int(r[0]), int(r[1])) for r in banned.select("link_id", "next_link_id").collect()) if banned is not None else frozenset()
    return Network(star, by, pairs, None if banned_modes is None else frozenset(banned_modes))


def search(star: Star, cost: np.ndarray, origin: int, banned: frozenset[tuple[int, int]] = frozenset(), wanted: set[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each node, place of the link it is reached by, place of the link before each link), from an origin's place; -1 where there is none.

    A heap of (cost, node or link) with strict updates; where two ways cost the same, the less link sequence wins. With ``wanted`` places
    the search ends once all of them are reached for good.
    """
    n, m = len(star.node_ids), len(star.link_ids)
    first, head, cost, name = star.first.tolist(), star.head.tolist(), cost.tolist(), star.link_ids.tolist()  # lists are read one by one faster
    end = (star.node_ids < 0).tolist()
    label, link, before = [-1] * n, [-1] * n, [-1] * m
    label[origin] = 0
    left = set(wanted) - {origin} if wanted is not None else None

    def ahead(node: int) -> range:
        return range(first[node], first[node + 1]) if node == origin or not end[node] else range(0)

    def found() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(label, np.int64), np.array(link, np.int64), np.array(before, np.int64)

    if banned:
        reach = [-1] * m
        done = [False] * m
        heap = []
        for e in ahead(origin):
            if cost[e] >= 0:
                reach[e] = cost[e]
                heapq.heappush(heap, (cost[e], e))
        while heap:
            at, e = heapq.heappop(heap)
            if done[e]:
                continue
            done[e] = True
            node = head[e]
            if label[node] < 0 or (label[node] == at and node != origin and route(star, e, before) < route(star, link[node], before)):
                label[node], link[node] = at, e
            if left is not None and all(label[x] >= 0 and label[x] < at for x in left):
                break
            for f in ahead(node) if node != origin else ():
                step = cost[f]
                if step < 0 or done[f] or (name[e], name[f]) in banned:
                    continue
                new = at + step
                if reach[f] < 0 or new < reach[f]:
                    reach[f], before[f] = new, e
                    heapq.heappush(heap, (new, f))
                elif new == reach[f] and route(star, e, before) < route(star, before[f], before):
                    before[f] = e
        return found()

    done = [False] * n
    heap = [(0, origin)]
    while heap:
        at, node = heapq.heappop(heap)
        if done[node]:
            continue
        done[node] = True
        if left is not None:
            left.discard(node)
            if not left:
                break
        for e in ahead(node):
            step, to = cost[e], head[e]
            if step < 0 or done[to]:
                continue
            new = at + step
            if label[to] < 0 or new < label[to]:
                label[to], link[to], before[e] = new, e, link[node]
                heapq.heappush(heap, (new, to))
            elif new == label[to]:
                before[e] = link[node]
                if route(star, e, before) < route(star, link[to], before):
                    link[to] = e
    return found()


def tree(star: Star, cost: np.ndarray, origin: int) -> tuple[np.ndarray, np.ndarray]:
    """(label of each node, place of the link it is reached by) without banned turns: a tree, whose links lead back to the origin."""
    return search(star, cost, origin)[:2]


def route(star: Star, last: int, before: np.ndarray) -> list[int]:
    """Link numbers, in driving order, of the way that ends with a link's place."""
    out = []
    while last >= 0:
        out.append(int(star.link_ids[last]))
        last = int(before[last])
    return out[::-1]


#: Rows that a task of ``trees`` holds before it hands them on.
FLUSH = 2000


def trees(origins: DataFrame, net: Network) -> DataFrame:
    """o, d, mode, period, cost, link_seq for each reachable d of each row of ``origins`` (o, mode, period); links in driving order.

    With a column ``dests`` (an array of nodes) only ways to these are traced.
    """
    shared = origins.sparkSession.sparkContext.broadcast(net)
    tasks = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = "dests" in origins.columns
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))

    def packed(out: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["o", "d", "mode", "period", "cost", "link_seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        star, place = net.star, net.star.index()
        out: list[list] = [[] for _ in kinds]
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                o, mode, period = row[:3]
                if o not in place or (mode, period) not in net.costs:
                    continue
                origin = place[o]
                wanted = {place[d] for d in row[3] if d in place} if some else None
                label, link, before = search(star, net.costs[mode, period], origin, net.bans(mode), wanted)
                for node in sorted(wanted) if some else np.flatnonzero(label >= 0):
                    if label[node] >= 0 and node != origin:
                        for column, value in zip(out, (o, int(star.node_ids[node]), mode, period, int(label[node]), route(star, int(link[node]), before)), strict=True):
                            column.append(value)
                        if len(out[0]) >= FLUSH:
                            yield packed(out)
                            out = [[] for _ in kinds]
        if out[0]:
            yield packed(out)

    names = ["o", "mode", "period", *(["dests"] if some else [])]
    return origins.select(*names).repartition(tasks, "o", "mode", "period").mapInArrow(run, "o long, d long, mode string, period string, cost long, link_seq array<long>")


def labels_by_rounds(origins: DataFrame, costs: DataFrame, rounds: int) -> DataFrame:
    """o, node, mode, period, cost after so many sweeps over all links: Bellman and Ford's method in joins, for cross-checks."""
    now = origins.select("o", F.col("o").alias("node"), "mode", "period", F.lit(0).cast("long").alias("cost"))
    links = F.broadcast(costs.select(F.col("from_node_id").alias("node"), "to_node_id", "mode", "period", F.col("cost").alias("step")))
    for _ in range(rounds):
        moved = now.join(links, ["node", "mode", "period"]).select("o", F.col("to_node_id").alias("node"), "mode", "period", (F.col("cost") + F.col("step")).alias("cost"))
        now = now.unionByName(moved).groupBy("o", "node", "mode", "period").agg(F.min("cost").alias("cost"))
    return now


def forward(star: Star, link: np.ndarray, node: int) -> list[int]:
    """Links from a node's place along a tree of the reversed network to its root."""
    source = np.repeat(np.arange(len(star.node_ids)), np.diff(star.first))
    out = []
    while link[node] >= 0:
        out.append(int(star.link_ids[link[node]]))
        node = int(source[link[node]])
    return out
