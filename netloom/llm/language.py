"""Language of whole texts by prediction by partial matching over bytes.

For each language a tree of byte contexts up to ORDER bytes long is counted on a bounded sample and then frozen. A byte's
code length comes from the longest context of it that the tree has: log2 of its share there, or an escape and the next
shorter context. With frozen trees the code length is a function of the last ORDER + 1 bytes alone, so texts are scored by
table look-ups, whole batches at a time, and the sums are the exact code lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm import scan, store

ORDER = 3
#: Different texts of each language that trees are counted on at most; the bound of what a fit reads and, with all their nodes, of the model.
SAMPLE = 400
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


@dataclass(frozen=True)
class Trees:
    """Frozen trees of all languages as tables over nodes that any language has; node 0 of an order is 'not seen'."""

    languages: tuple[str, ...]
    first: np.ndarray  #: [byte, language] cost without a context
    second: np.ndarray  #: [two bytes, language] cost in a context of one byte
    node2: np.ndarray  #: two bytes -> node
    node3: np.ndarray  #: node of two bytes * 256 + byte -> node
    node4: np.ndarray  #: node of three bytes * 256 + byte -> node
    cost3: np.ndarray  #: node of three bytes -> cost of the last
    cost4: np.ndarray
    escape2: np.ndarray  #: node of two bytes -> cost of leaving it as a context
    escape3: np.ndarray

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; data is lower-cased bytes of texts joined."""
        n = len(data)
        bits = np.zeros((n, len(self.languages)), dtype=np.float32)
        if n:
            place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
            d = data.astype(np.int32)
            pair = d.copy()
            pair[1:] += d[:-1] << 8
            two = np.where(place >= 1, self.node2[pair], 0)
            before2 = np.concatenate(([0], two[:-1]))
            three = np.where(place >= 2, self.node3[before2 * 256 + d], 0)
            before3 = np.concatenate(([0], three[:-1]))
            four = np.where(place >= 3, self.node4[before3 * 256 + d], 0)
            rest = np.flatnonzero(four == 0)
            bits[:] = self.cost4[four]
            at = three[rest]
            context3 = np.where(place[rest] >= 3, before3[rest], 0)
            low = self.cost3[at] + self.escape3[context3]
            lower = np.flatnonzero(at == 0)
            far = rest[lower]
            context2 = np.where(place[far] >= 2, before2[far], 0)
            low[lower] = np.where((place[far] >= 1)[:, None], self.second[pair[far]], self.first[d[far]]) + self.escape2[context2] + self.escape3[context3[lower]]
            bits[rest] = low
        sums = np.concatenate((np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]


def counts_of(texts: DataFrame) -> DataFrame:
    """(lang, order, gram, n) of the byte strings of 1 to ORDER + 1 bytes within each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                data, offsets = scan.text_bytes(batch.column(1).filter(pa.array(langs == lang)))
                data = scan.LOWER[data].astype(np.int64)
                if not len(data):
                    continue
                place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
                gram = np.zeros(len(data), np.int64)
                for k in range(ORDER + 1):
                    gram[k:] += data[: len(data) - k] << (8 * k)
                    grams, n = np.unique(gram[place >= k], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), k, np.int32)), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "order", "gram", "n"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, order int, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))


def freeze(rows: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], languages: tuple[str, ...]) -> Trees:
    """Trees from (grams, counts) by language and order, with escapes in the share of different bytes seen (PPM's method C)."""
    width = len(languages)
    seen, tables = [], []
    for k in range(ORDER + 1):
        grams = np.unique(np.concatenate([rows[lang, k][0] for lang in languages if (lang, k) in rows] or [np.zeros(0, np.int64)]))
        table = np.zeros((len(grams), width))
        for j, lang in enumerate(languages):
            if (lang, k) in rows:
                table[np.searchsorted(grams, rows[lang, k][0]), j] = rows[lang, k][1]
        seen.append(grams)
        tables.append(table)

    def context(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For order k: the contexts, their totals and their different bytes."""
        names, inverse = np.unique(seen[k] >> 8, return_inverse=True)
        total, kinds = np.zeros((len(names), width)), np.zeros((len(names), width))
        np.add.at(total, inverse, tables[k])
        np.add.at(kinds, inverse, tables[k] > 0)
        return names, total, kinds

    def bits(share: np.ndarray) -> np.ndarray:
        return -np.log2(share)

    def seen_cost(k: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cost of each gram of order k, its contexts, the escape cost of each); lower: the grams' cost one order down."""
        names, total, kinds = context(k)
        escape = np.where(total > 0, bits(np.maximum(kinds, 1e-9) / np.maximum(total + kinds, 1e-9)), 0)
        row = np.searchsorted(names, seen[k] >> 8)
        share = tables[k] / np.maximum(total + kinds, 1)[row]
        return np.where(tables[k] > 0, bits(np.maximum(share, 1e-12)), lower + escape[row]), names, escape

    total, kinds = tables[0].sum(axis=0), (tables[0] > 0).sum(axis=0)
    escape0 = np.where(total > 0, bits(np.maximum(kinds, 1e-9) / np.maximum(total + kinds, 1e-9)), 0)
    first = np.tile(escape0 + 8.0, (256, 1))
    have = tables[0] > 0
    first[seen[0]] = np.where(have, bits(np.maximum(tables[0] / np.maximum(total + kinds, 1), 1e-12)), first[seen[0]])
    cost2, names1, escape1 = seen_cost(1, first[seen[1] & 255])
    by_byte = np.zeros((256, width))
    by_byte[names1] = escape1
    second = np.repeat(by_byte, 256, axis=0) + np.tile(first, (256, 1))
    second[seen[1]] = cost2
    cost3, names2, escape2 = seen_cost(2, second[seen[2] & 0xFFFF])
    known = np.searchsorted(seen[2], seen[3] & 0xFFFFFF)
    cost4, names3, escape3 = seen_cost(3, cost3[np.minimum(known, max(len(seen[2]) - 1, 0))] if len(seen[3]) else np.zeros((0, width)))

    def with_none(x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.zeros((1, width)), x)).astype(np.float32)

    def spread(names: np.ndarray, escape: np.ndarray, grams: np.ndarray) -> np.ndarray:
        out = np.zeros((len(grams), width))
        out[np.searchsorted(grams, names)] = escape
        return with_none(out)

    node2 = np.zeros(65536, np.int32)
    node2[seen[1]] = np.arange(1, len(seen[1]) + 1)
    node3 = np.zeros((len(seen[1]) + 1) * 256, np.int32)
    node3[node2[seen[2] >> 8] * 256 + (seen[2] & 255)] = np.arange(1, len(seen[2]) + 1)
    three = np.zeros(len(seen[3]), np.int64) if not len(seen[2]) else np.searchsorted(seen[2], seen[3] >> 8) + 1
    node4 = np.zeros((len(seen[2]) + 1) * 256, np.int32)
    node4[three * 256 + (seen[3] & 255)] = np.arange(1, len(seen[3]) + 1)
    return Trees(languages, first.astype(np.float32), second.astype(np.float32), node2, node3, node4, with_none(cost3), with_none(cost4), spread(names2, escape2, seen[1]), spread(names3, escape3, seen[2]))


def fit(train: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees of the languages in ``train`` (text, lang), each from at most ``sample`` different texts chosen by their hash.

    Rows without a language or text teach nothing, copies of a text teach once. None if no row is left. Counts and tables
    come to the driver: of ``sample`` whole texts a language, for as many languages as there are in ``lang``.
    """
    usable = train.select("lang", "text").where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & (F.length("text") > 0)).withColumn("_h", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * sample / max(n, 1)))).otherwise(share)
    likely = usable.where((F.pmod("_h", F.lit(1 << 30)) <= share * float(1 << 30))).groupBy("lang", "_h").agg(F.min("text").alias("text"))
    chosen = likely.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))).where(F.col("_r") <= sample)
    counted = counts_of(chosen).toArrow()
    lang, order = (np.array(counted.column(c).to_pylist()) for c in ("lang", "order"))
    gram, n = (counted.column(c).to_numpy() for c in ("gram", "n"))
    rows = {}
    for name in sizes:
        for k in range(ORDER + 1):
            mine = np.flatnonzero((lang == name) & (order == k))
            mine = mine[np.argsort(gram[mine])]
            rows[name, k] = gram[mine], n[mine]
    return freeze(rows, tuple(sorted(sizes)))


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, lang_pred, score: the language with the shortest code, and how likely the code lengths make it.

    ``und`` and 0 for a text that is null or has no letter, or when there are no trees; ties go to the first by name. One row per
    input row, repeated ones included; other columns are ignored.
    """
    if trees is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(trees)  # tables of SAMPLE texts a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        names = np.array(trees.languages, dtype=object)
        for batch in scan.parts(batches, "text"):
            data, offsets = scan.text_bytes(batch.column(1))
            bits = trees.code_lengths(scan.LOWER[data], offsets)
            best = bits.argmin(axis=1)
            gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
            score = 1 / np.exp2(-gap).sum(axis=1)
            letters = np.array([has_letter(t.as_py()) for t in batch.column(1)], dtype=bool)
            yield pa.record_batch([batch.column(0), pa.array(np.where(letters, names[best], UNKNOWN), pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for all documents; trees learn from the text and lang of those not held out."""
    docs = store.documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    trees = fit(docs.where(~F.coalesce(held_out, F.lit(True))))
    return predict(docs, trees).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
