"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import store

#: Links that one task joins by itself at most, in memory of a fixed size; more are joined in rounds over all tasks.
ONE_TASK = 300_000


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of it and its neighbours."""
    around = _both(links)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of links (a, b) that are not roots: the least label spreads along links and is jumped over."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        n += x.num_rows
        if n > 4 * ONE_TASK:
            yield _stars(held)
            held, n = [], 0
    if held:
        yield _stars(held)


def _stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in stars(*(np.concatenate(y) for y in zip(*held, strict=True)))], names=["a", "b"])


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b) but the roots; a root is the least node of its component.

    Each task first joins the links it holds, so that chains and cliques are stars. If that leaves at most ONE_TASK links, one
    task ends it; else rounds go on until all links are stars. Each round is written to the shared folder.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = store.written(ordered.mapInArrow(_joined, "a long, b long").distinct(), "stars", narrow=True)
    if now.count() <= ONE_TASK:
        done = store.written(now.repartition(1).mapInArrow(_joined, "a long, b long"), "stars")
        store.drop(now)
        return store.renamed(done, "node", "root")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            return store.renamed(now, "node", "root")
        mark, before = seen, now
        now = store.written(_small_star(_large_star(now).distinct()).distinct(), "stars", narrow=True)
        store.drop(before)
