"""Removal of long repeated passages by a compacted de Bruijn graph of words.

A window of K words is an edge of the graph, from the node of its first K - 1 words to that of its last K - 1. Only edges that
come in several documents matter:

* Neighbouring windows with one minimizer (the GRAM-word string of least hash in them) form a path; equal windows have equal
  minimizers, so an edge can only repeat among the paths of one minimizer. A minimizer seen in one document alone is left out.
* Equal paths are one long edge. Where different paths meet in one minimizer, the path of each is taken apart into single edges.
* ``graph``: the repeated edges, each with the coordinates of its first occurrence, its source.
* ``compacted``: nodes with one edge in and one out, whose edges go on in the source, are passed through; joins that double the
  distance each round tie all edges of such a path to its head.
* ``spans_of``: what a document has of one compacted path at one distance from it is a span, with the span of the source.
* ``verified``: the words at both coordinates are compared by a cryptographic digest before anything is removed. Edges are
  found by a 64-bit hash; should two unlike spans share one, all is done again with other hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import scan, store

K = 50
GRAM = 8
_LAST = 2**63 - 1
KEY = ("doc_id", "text_key")
#: Where an edge starts in its source, and how many windows it has.
PIECE = ("s_rank", "s_key", "s_at", "n")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text. The two first name a row, up to repeated rows, which are treated alike."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.coalesce("doc_id", F.lit(_LAST)))


def _words(batch: pa.RecordBatch, column: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts joined, words of each text as offsets)."""
    data, offsets = scan.text_bytes(batch.column(column))
    starts, ends, first = scan.word_spans(data, offsets, scan.NOT_SPACE)
    return scan.Spans(data, salt)(starts, ends), first


def paths(docs: DataFrame, k: int = K, gram: int = GRAM, salt: int = 0) -> DataFrame:
    """Runs of windows with one minimizer: mini, content (hashes), doc_id, text_key, at (first word), n (windows), rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "text"):
            words, first = _words(batch, 2, salt)
            at = np.arange(max(len(words) - gram + 1, 0))
            grams = scan.span_hash(scan.prefix_sums(words), at, at + gram)
            start, windows, mini = scan.minimizer_runs(grams, np.repeat(first[1:], np.diff(first)), gram, k)
            owner = np.searchsorted(first, start, "right") - 1
            content = scan.Spans(words, salt)(start, start + windows + k - 1)
            yield pa.record_batch(
                [pa.array(scan.signed(grams[mini])), pa.array(scan.signed(content)), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array((start - first[owner]).astype(np.int32)), pa.array(windows.astype(np.int32))],
                names=["mini", "content", "doc_id", "text_key", "at", "n"],
            )

    return _ranked(keyed(docs).mapInArrow(run, "mini long, content long, doc_id long, text_key long, at int, n int"))


def edges(docs: DataFrame, wanted: DataFrame, k: int = K, salt: int = 0) -> DataFrame:
    """Edges with their nodes (hashes left and right): mini, edge, left, right, doc_id, text_key, at, n, whole, rank.

    ``wanted``: paths (mini, doc_id, text_key, at, n, content); one with a content is one edge, another is taken apart.
    """
    by_doc = wanted.groupBy(*KEY).agg(F.collect_set(F.struct("mini", "at", "n", "content")).alias("runs"))
    joined = keyed(docs).alias("d").join(by_doc.alias("w").hint("shuffle_hash"), F.expr("d.doc_id <=> w.doc_id AND d.text_key = w.text_key")).select("d.doc_id", "d.text_key", "d.text", "w.runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "text"):
            words, first = _words(batch, 2, salt)
            spans = scan.Spans(words, salt)
            flat = batch.column(3).flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(3).offsets.to_numpy()))
            mini, at, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("mini", "at", "n"))
            is_whole = flat.field("content").is_valid().to_numpy(zero_copy_only=False)
            rows = np.where(is_whole, 1, n)
            inside = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
            size, whole = np.repeat(np.where(is_whole, n, 1), rows), np.repeat(is_whole, rows)
            owner, mini, at = np.repeat(owner, rows), np.repeat(mini, rows), np.repeat(at, rows) + inside
            start = first[owner] + at
            node = spans(np.concatenate((start, start + size)), np.concatenate((start, start + size)) + k - 1)
            take = pa.array(owner)
            yield pa.record_batch(
                [pa.array(mini), *(pa.array(scan.signed(x)) for x in (spans(start, start + size + k - 1), node[: len(start)], node[len(start) :])), *(batch.column(c).take(take) for c in range(2)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(whole)],
                names=["mini", "edge", "left", "right", "doc_id", "text_key", "at", "n", "whole"],
            )

    return _ranked(joined.mapInArrow(run, "mini long, edge long, left long, right long, doc_id long, text_key long, at int, n int, whole boolean"))


def graph(docs: DataFrame, k: int, gram: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """(the repeated edges: left, right and PIECE; their occurrences after the source: KEY, at and PIECE).

    What is joined back to many rows is written first, so that a hot minimizer's or path's rows can be split over tasks.
    """
    source = F.min(F.struct("rank", "text_key", "at")).alias("source")
    piece = [F.col("source.rank").alias("s_rank"), F.col("source.text_key").alias("s_key"), F.col("source.at").alias("s_at"), "n"]
    runs = store.written(paths(docs, k, gram, salt), "paths")
    shared = store.written(runs.groupBy("mini").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.min("content").alias("c0"), F.max("content").alias("c1")).where("low < high").select("mini", (F.col("c0") != F.col("c1")).alias("branches")), "shared-minimizers", narrow=True)
    met = store.written(runs.join(shared, "mini"), "shared-paths")
    store.drop(runs, shared)
    classes = store.written(met.groupBy("mini", "content").agg(source, F.max("rank").alias("last")), "path-classes", narrow=True)
    placed = met.join(classes, ["mini", "content"])
    again = store.written(placed.where("rank > source.rank").select(*KEY, "at", *piece), "equal-paths")
    apart = placed.where("branches AND rank = source.rank").select("mini", *KEY, "at", "n", F.lit(None).cast("long").alias("content"))
    long_ones = placed.where("source.rank < last AND rank = source.rank AND text_key = source.text_key AND at = source.at").select("mini", *KEY, "at", "n", "content")
    single = store.written(edges(docs, apart.union(long_ones), k, salt), "edges")
    store.drop(met, classes)
    first = store.written(single.where("NOT whole").groupBy("mini", "edge").agg(source, F.max("rank").alias("last"), F.first("left").alias("left"), F.first("right").alias("right")).where("source.rank < last").drop("last"), "repeated-edges", narrow=True)
    parts = single.where("NOT whole").join(first.select("mini", "edge", "source"), ["mini", "edge"]).where("rank > source.rank").select(*KEY, "at", *piece)
    whole = single.where("whole").select("left", "right", F.struct("rank", "text_key", "at").alias("source"), "n")
    found = store.written(first.select("left", "right", "source", F.lit(1).alias("n")).union(whole).select("left", "right", *piece).distinct(), "graph", narrow=True)
    occurrences = store.written(again.union(parts), "occurrences")
    store.drop(again, single, first)
    return found, occurrences


def compacted(found: DataFrame) -> DataFrame:
    """The edges of a graph (PIECE) with the head of their path: head_at and head_n, in the same source.

    A node is passed through where one edge comes in and one goes out, and the source of the second goes on from that of the first.
    """
    piece = F.struct(*PIECE)
    ends = found.select(F.col("right").alias("node"), piece.alias("in"), F.lit(None).cast(found.select(piece.alias("x")).schema["x"].dataType).alias("out"))
    starts = found.select(F.col("left").alias("node"), F.lit(None).cast(ends.schema["in"].dataType).alias("in"), piece.alias("out"))
    nodes = ends.union(starts).groupBy("node").agg(F.count("in").alias("comes"), F.count("out").alias("goes"), F.max("in").alias("in"), F.max("out").alias("out"))
    passed = nodes.where("comes = 1 AND goes = 1 AND in.s_rank = out.s_rank AND in.s_key = out.s_key AND in.s_at + in.n = out.s_at")
    steps = passed.select("out.*", F.col("in.s_at").alias("head_at"), F.col("in.n").alias("head_n"))
    now = store.written(found.select(*PIECE).join(steps, list(PIECE), "left").withColumn("ended", F.col("head_at").isNull()).withColumn("head_at", F.coalesce("head_at", "s_at")).withColumn("head_n", F.coalesce("head_n", "n")), "heads", narrow=True)
    while not now.where("NOT ended").isEmpty():
        ahead = now.select("s_rank", "s_key", F.col("s_at").alias("head_at"), F.col("n").alias("head_n"), F.col("head_at").alias("to_at"), F.col("head_n").alias("to_n"), F.col("ended").alias("there"))
        moved = now.where("NOT ended").join(ahead, ["s_rank", "s_key", "head_at", "head_n"]).select(*PIECE, F.col("to_at").alias("head_at"), F.col("to_n").alias("head_n"), F.col("there").alias("ended"))
        before = now
        now = store.written(now.where("ended").select(*moved.columns).union(moved), "heads", narrow=True)
        store.drop(before)
    return now


_SPAN = "doc_id long, text_key long, start int, end int, s_rank long, s_key long, s_start int"


def spans_of(occurrences: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, start, end (words), s_rank, s_key, s_start: what a document has of a compacted path, in one piece."""
    placed = occurrences.join(heads, list(PIECE))
    by_path = placed.groupBy(*KEY, "s_rank", "s_key", "head_at", "head_n", (F.col("at") - F.col("s_at")).alias("shift")).agg(F.collect_set(F.struct("at", "n")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            flat = column["found"].flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(column["found"].offsets.to_numpy()))
            at, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
            order = np.lexsort((at, owner))
            owner, at, end = owner[order], at[order], (at + n)[order]
            reach = np.maximum.accumulate(owner * (1 << 32) + end) - owner * (1 << 32)  # of what came before in the same row
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (at[1:] > reach[:-1]))) if len(at) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            last = np.append(start[1:], len(at)) - 1 if len(start) else start
            take = pa.array(owner[start])
            shift = column["shift"].to_numpy()[owner[start]]
            yield pa.record_batch(
                [column["doc_id"].take(take), column["text_key"].take(take), pa.array(at[start].astype(np.int32)), pa.array((reach[last] + k - 1).astype(np.int32)), column["s_rank"].take(take), column["s_key"].take(take), pa.array((at[start] - shift).astype(np.int32))],
                names=["doc_id", "text_key", "start", "end", "s_rank", "s_key", "s_start"],
            )

    return by_path.mapInArrow(run, _SPAN)


def verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` with ``same``: whether the words at both coordinates are the same, by their digests."""
    own = spans.select(*KEY, "start", "end")
    far = spans.select(F.col("s_rank").alias("doc_id"), F.col("s_key").alias("text_key"), F.col("s_start").alias("start"), (F.col("s_start") + F.col("end") - F.col("start")).alias("end"))
    asked = store.written(own.union(far).groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("places")), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, first, second = [], [], [], [], []
            for row, (text, places) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                words = (text.as_py() or "").encode().split()
                flat = places.values
                start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
                size = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
                x, y = scan.digests(b" ".join(words), size[start], size[end] - 1)
                rows.append(np.full(len(start), row))
                for column, value in zip((starts, ends, first, second), (start, end, x, y), strict=True):
                    column.append(value)
            take = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            both = [pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in (starts, ends, first, second)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), *(x.cast(t) for x, t in zip(both, kinds, strict=True))], names=["doc_id", "text_key", "start", "end", "x", "y"])

    read = store.written(store.beside(keyed(docs), asked, "places").mapInArrow(run, "doc_id long, text_key long, start int, end int, x long, y long").distinct(), "digests")
    mine = spans.alias("s").join(read.alias("r"), F.expr("s.doc_id <=> r.doc_id AND s.text_key = r.text_key AND s.start = r.start AND s.end = r.end")).select("s.*", "r.x", "r.y")
    both = mine.alias("s").join(read.alias("r"), F.expr("s.s_rank = r.doc_id AND s.s_key = r.text_key AND s.s_start = r.start AND s.s_start + s.end - s.start = r.end"))
    out = store.written(both.select(*(f"s.{c}" for c in spans.columns), F.expr("s.x = r.x AND s.y = r.y").alias("same")), "verified-spans", narrow=True)
    store.drop(asked, read)
    return out


def repeated_spans(docs: DataFrame, k: int = K, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, start, end (words, end exclusive), s_rank, s_key, s_start: spans of windows that also start in a smaller document.

    The last three are the doc_id and text_key of the first document that has the span's words, and where they start there.
    A null doc_id counts as larger than all others. Repeats inside one document, or among rows with one doc_id, are none.
    """
    for salt in itertools.count():
        found, occurrences = graph(docs, k, gram, salt)
        heads = compacted(found)
        spans = store.written(spans_of(occurrences, heads, k), "spans", narrow=True)
        store.drop(found, occurrences, heads)
        checked = verified(docs, spans)
        store.drop(spans)
        if checked.where("NOT same").isEmpty():
            return checked.drop("same")
        store.drop(checked)


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each text without the words in its spans, the rest joined by one space."""
    by_doc = store.written(spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans-of-document")
    joined = store.beside(keyed(docs), by_doc, "spans", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                n = len(words)
                if found.is_valid:
                    change = np.zeros(n + 1, np.int32)
                    flat = found.values
                    np.add.at(change, flat.field("start").to_numpy(), 1)
                    np.add.at(change, flat.field("end").to_numpy(), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                total.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary").select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def remove_repeats(docs: DataFrame, k: int = K, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of ``docs``.

    A word goes if a window of ``k`` words that covers it has its word sequence in a document with a smaller doc_id too.
    Null and empty texts have no words; texts of fewer than ``k`` words stay whole; repeated rows are cut alike; other columns are ignored.
    """
    return cut(docs, repeated_spans(docs, k, gram))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(store.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
