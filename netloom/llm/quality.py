"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all grades, over hashed words and shape features. The
thresholds are ordered by construction. The fit is on a bounded sample of rated documents; every document is then scored
on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm import scan, store

BITS = 18
#: Rated documents that a fit reads at most.
SAMPLE = 6000
#: Sampled documents that a word must be in to get a weight.
LEAST_DOCS = 8
ROUNDS = 300
RIDGE = 1e-3
#: Standard errors by which a feature's share of some grade must differ from its share of all, to get a weight: a text of
#: thousands of words else sums up the noise of thousands of weights.
SCREEN = 6.0
#: A document is kept when it is likelier not toxic than toxic, and the best grade is at least this likely.
KEEP = 0.2
#: Grades: 0 toxic, 1 poor, 2 good.
GRADES = 3
_WORD = scan.lut((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_UPPER = scan.lut((0x41, 0x5A))
_LETTER = scan.lut((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_DIGIT = scan.lut((0x30, 0x39))
_MARK = scan.lut(0x21, (0x23, 0x26), (0x2A, 0x2B), 0x2F, (0x3C, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_SHAPES = ("upper", "digit", "mark", "short", "repeat", "words", "lines")
_LEVELS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all texts joined, offsets of each text's): each text's different words, and its shape.

    Words are runs of letters and digits, ASCII letters lower-cased. Shape features tell the shares of upper case, digits,
    marks, short words and repeated words, and the size, each in levels.
    """
    n = len(offsets) - 1
    starts, ends, first = scan.word_spans(data, offsets, _WORD)
    hashes = scan.span_hash(scan.prefix_sums(scan.BYTE_CODES[scan.LOWER[data]]), starts, ends) >> np.uint64(64 - BITS) if len(starts) else np.zeros(0, np.uint64)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    keys = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | hashes)
    distinct = np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=n)
    size = np.maximum(np.diff(offsets), 1)

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[data])))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(of, 1)

    letters = share(_LETTER, np.ones(n)).astype(float)
    short = np.bincount(owner, weights=(ends - starts) <= 2, minlength=n) / np.maximum(words, 1)
    lines = share(scan.lut(0x0A), np.ones(n)) + 1
    values = (share(_UPPER, letters), share(_DIGIT, size), share(_MARK, size), short, 1 - distinct / np.maximum(words, 1))
    shape = [np.searchsorted(_LEVELS, v) for v in values] + [np.log2(words + 1).astype(np.int64), np.minimum(np.log2(np.maximum(words, 1) / lines + 1), 15).astype(np.int64)]
    codes = np.stack([scan.mix(np.full(n, 1000 * j, np.uint64) + s.astype(np.uint64)) >> np.uint64(64 - BITS) for j, s in enumerate(shape, 1)]) if n else np.zeros((len(_SHAPES), 0), np.uint64)
    keys = np.unique(np.concatenate((keys, ((np.arange(n, dtype=np.uint64) << np.uint64(BITS))[None, :] | codes).ravel())))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  #: ascending, one fewer than the grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def train(indices: np.ndarray, offsets: np.ndarray, grades: np.ndarray, least: int = LEAST_DOCS, rounds: int = ROUNDS) -> Model:
    """Ridge-penalised maximum likelihood by Adam on the full sample, classes weighted alike, over screened features."""
    grade_of = np.repeat(grades, np.diff(offsets))
    seen = np.stack([np.bincount(indices[grade_of == k], minlength=1 << BITS) for k in range(GRADES)])
    sizes = np.bincount(grades, minlength=GRADES)[:, None]
    share = seen.sum(axis=0) / max(len(grades), 1)
    apart = np.abs(seen - sizes * share) / np.sqrt(np.maximum(sizes * share * (1 - share), 1e-9))
    slot = np.full(1 << BITS, -1)
    kept = np.flatnonzero((seen.sum(axis=0) >= least) & (apart.max(axis=0) >= SCREEN))
    slot[kept] = np.arange(len(kept))
    mine = slot[indices] >= 0
    rows, columns = np.repeat(np.arange(len(grades)), np.diff(offsets))[mine], slot[indices[mine]]
    weight = 1 / np.maximum(np.bincount(grades, minlength=GRADES), 1)[grades]
    weight = weight / weight.sum()
    w = np.zeros(len(kept))
    t = np.array([-1.0, 0.0])  # first threshold, log of the next gap
    moments = [np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(2), np.zeros(2)]
    for step in range(1, rounds + 1):
        score = np.bincount(rows, weights=w[columns], minlength=len(grades)) if len(rows) else np.zeros(len(grades))
        cuts = np.array([-np.inf, t[0], t[0] + np.exp(t[1]), np.inf])
        upper = 1 / (1 + np.exp(-np.clip(cuts[grades + 1] - score, -40, 40)))
        lower = 1 / (1 + np.exp(-np.clip(cuts[grades] - score, -40, 40)))
        p = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper), lower * (1 - lower)
        slope = weight * (up - low) / p  # of the loss by the score
        g = (np.bincount(columns, weights=slope[rows], minlength=len(kept)) if len(rows) else np.zeros(len(kept))) + RIDGE * w / 10
        by_cut = [-(weight * ((grades == k) * up - (grades == k + 1) * low) / p).sum() for k in range(2)]
        gt = np.array([by_cut[0] + by_cut[1], by_cut[1] * np.exp(t[1])])
        for x, dx, m, v, rate in ((w, g, moments[0], moments[1], 0.02), (t, gt, moments[2], moments[3], 0.02)):
            m += 0.1 * (dx - m)
            v += 0.01 * (dx * dx - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[kept] = w
    return Model(weights, np.array([t[0], t[0] + np.exp(t[1])]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade from quality and toxic marks: 0 toxic, 1 poor, 2 good; rows without a mark are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull())


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` rated documents, a third of each grade where there are enough, chosen by a hash.

    A document rated more than once counts with its lowest grade, and one with several rows with its least text, so no more than
    ``sample`` lists of hashed words come to the driver. None if no rated document has a row.
    """
    rated = ratings.groupBy("doc_id").agg(F.min("grade").alias("grade")).withColumn("_h", F.xxhash64("doc_id"))
    sizes = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # one row a grade
    share = F.lit(0.0)
    for grade, n in sizes.items():
        share = F.when(F.col("grade") == grade, F.lit(min(1.0, sample / GRADES * 1.5 / n))).otherwise(share)
    likely = rated.where(F.pmod("_h", F.lit(1 << 30)) <= share * float(1 << 30))
    chosen = likely.withColumn("_r", F.row_number().over(Window.partitionBy("grade").orderBy("_h", "doc_id"))).where(F.col("_r") <= sample // GRADES).select("doc_id", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "text"):
            found, ends = features(*scan.text_bytes(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.astype(np.int32)))
            yield pa.record_batch([batch.column(0), lists], names=["grade", "found"])

    one_each = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = one_each.select("grade", "text").mapInArrow(run, "grade int, found array<int>").toArrow()
    if not rows.num_rows:
        return None
    lists = rows.column("found").combine_chunks()
    grades, flat, sizes_ = rows.column("grade").to_numpy(), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    order = np.lexsort((np.add.reduceat(flat, lists.offsets.to_numpy()[:-1]), sizes_, grades))  # the same sums whatever the order of rows
    offsets = np.concatenate(([0], np.cumsum(sizes_)))
    indices = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in order])
    return train(indices.astype(np.int64), np.concatenate(([0], np.cumsum(sizes_[order]))), grades[order].astype(np.int64))


def _tails(model: Model, texts: pa.Array) -> np.ndarray:
    found, ends = features(*scan.text_bytes(texts))
    sums = np.concatenate(([0.0], np.cumsum(model.weights[found])))
    return model.tails(sums[ends[1:]] - sums[ends[:-1]])


def score(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, p_at_least_1, p_at_least_2, keep; one row per input row.

    Null text is scored as empty text. Without a model all documents are kept, with null scores.
    """
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("expected_grade"), none.alias("p_at_least_1"), none.alias("p_at_least_2"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "text"):
            tails = _tails(shared.value, batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array((tails[:, 0] >= 0.5) & (tails[:, 1] >= keep))], names=["doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, p_at_least_1 double, p_at_least_2 double, keep boolean")


def select(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score`` would keep."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "text"):
            tails = _tails(shared.value, batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array((tails[:, 0] >= 0.5) & (tails[:, 1] >= keep)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir)
    return score(docs, fit(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))))
