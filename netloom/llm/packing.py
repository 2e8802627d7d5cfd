"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

Only lengths decide a packing, so the plan is made from the histogram of piece lengths, which has at most ``size`` entries
however many documents there are. A plan is a list of bin patterns with repeat counts; each piece then finds its place from
its rank among the pieces of its length. No document leaves its partition except as (length, rank).
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm import store

SIZE = 2048
END_ID = 0
#: Rows of one length that one task ranks at most on average.
RANK_ROWS = 50_000
_OTHER = regex.compile(r"[^\x00-ɏ]|<\|endoftext\|>")


@lru_cache(maxsize=2)
def encoders(vocabulary: str | None, ranks: str | None):
    """(tokenizers.Tokenizer, tiktoken.Encoding) of one vocabulary.

    Both give the same ids; the second is faster and takes the texts of Latin letters alone, where the two libraries' Unicode
    tables cannot differ and no special token occurs. The first takes all others.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return whole, tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def token_ids(text: str, vocabulary: str | None = None, ranks: str | None = None) -> array:
    """The ids of ``text`` as unsigned 32-bit numbers, without an end mark."""
    whole, fast = encoders(vocabulary, ranks)
    return array("I", whole.encode(text, add_special_tokens=False).ids if _OTHER.search(text) else fast.encode_ordinary(text))


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then END_ID; null text is empty, so it is END_ID alone. Only a document of more than ``size``
    ids is cut: its first piece has the remainder, the others are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py() or "", vocabulary, ranks)
                ids.append(END_ID)
                n = len(ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                view = memoryview(ids).cast("B")
                start, k = 0, 0
                while start < n:
                    length = min(size, n) if k or n <= size else n % size or size
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(view[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
                    start, k = start + length, k + 1
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Pattern:
    """``repeat`` bins that each hold pieces of these lengths, longest first."""

    lengths: tuple[int, ...]
    repeat: int


def best_two_fit(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Bin patterns for ``histogram[length]`` pieces of each length.

    A bin is filled greedily, always with the longest piece that fits. While it has a gap, its smallest piece gives way to
    the two unpacked pieces whose sum is largest within the gap so widened, if they fill more than it did. The same
    bin is repeated for as long as the pieces last; then the next is formed.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= size:
            raise ValueError(f"a piece of {length} in bins of {size}")
        left[length] = n
    longest = np.maximum.accumulate(np.where(left > 0, np.arange(size + 1), 0))
    plan: list[Pattern] = []
    while longest[size]:
        bin_: list[int] = []
        spare = left.copy()

        def fits(gap: int) -> int:
            """The longest piece of at most ``gap`` that is still unpacked."""
            length = int(longest[gap])
            while length and not spare[length]:
                length = int(longest[length - 1])
            return length

        gap = size
        while gap and (length := fits(gap)):
            bin_.append(length)
            spare[length] -= 1
            gap -= length
        while gap and bin_ and (two := _closest_two(spare, gap + bin_[-1])) and sum(two) > bin_[-1]:
            gap += bin_[-1] - sum(two)
            spare[bin_.pop()] += 1
            bin_ += two
            for length in two:
                spare[length] -= 1
            bin_.sort(reverse=True)
        kinds, used = np.unique(bin_, return_counts=True)
        repeat = int((left[kinds] // used).min())
        left[kinds] -= used * repeat
        longest = np.maximum.accumulate(np.where(left > 0, np.arange(size + 1), 0))
        plan.append(Pattern(tuple(bin_), repeat))
    return plan


def _closest_two(spare: np.ndarray, gap: int) -> list[int] | None:
    """The two unpacked lengths with the largest sum within ``gap``, the more even pair of equals."""
    have = np.flatnonzero(spare[: gap + 1] > 0)
    if not len(have):
        return None
    fit = np.searchsorted(have, gap - have, "right") - 1
    partner = np.where(fit >= 0, have[np.maximum(fit, 0)], 0)
    twice = (partner == have) & (spare[have] < 2)
    fit = np.where(twice, fit - 1, fit)
    partner = np.where(fit >= 0, have[np.maximum(fit, 0)], 0)
    total = np.where(partner > 0, have + partner, 0)
    if not total.max():
        return None
    best = int(np.flatnonzero(total == total.max())[-1])
    return sorted((int(have[best]), int(partner[best])), reverse=True)


def places(plan: list[Pattern]) -> dict[str, np.ndarray]:
    """The plan as arrays: for each (length, pattern) the ranks it serves, its first sequence, and offsets in it."""
    taken: dict[int, int] = {}
    rows, offsets, sequence = [], [], 0
    for p in plan:
        at: dict[int, list[int]] = {}
        offset = 0
        for length in p.lengths:
            at.setdefault(length, []).append(offset)
            offset += length
        for length, slots in at.items():
            first = taken.get(length, 0)
            rows.append((length, first, len(slots), sequence, len(offsets)))
            offsets += slots
            taken[length] = first + len(slots) * p.repeat
        sequence += p.repeat
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "first": table[:, 1], "slots": table[:, 2], "sequence": table[:, 3], "at": table[:, 4], "offsets": np.array(offsets, dtype=np.int64)}


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` with ``rank``: 0, 1, ... among the pieces of each length.

    Pieces of a length are dealt into buckets by a hash, ranked in each, and moved up by the sizes of the buckets before;
    a length that a third of all pieces have is ranked by many tasks, even if they are one piece repeated (``salt``).
    """
    total = cut.count()
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *(x for x in cut.columns if x == "salt")), F.lit(max(1, total // RANK_ROWS))))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return bucketed.withColumn("within", F.row_number().over(inside) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("within")).drop("bucket", "base", "within", "salt")


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces with sequence_id and offset; each sequence is gapless from 0 and holds at most ``size`` ids.

    Null and empty texts are pieces of one id. Repeated rows are packed as often as they come. An empty table gives no rows.
    Other columns of ``docs`` are ignored.
    """
    cut = store.written(pieces(docs, size, vocabulary, ranks).withColumn("salt", F.monotonically_increasing_id()), "pieces")  # written, so the same to all who read it
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length of at most size
    plan = places(best_two_fit(histogram, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(max(plan["first"].max(initial=0), 1)) * 2 + 1
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            lo = np.searchsorted(plan["length"], length, "left")
            key = plan["length"].astype(np.float64) * span + plan["first"]
            row = np.maximum(lo, np.searchsorted(key, length.astype(np.float64) * span + np.minimum(rank, span - 1), "right") - 1)
            nth = rank - plan["first"][row]
            slots = plan["slots"][row]
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            out["sequence_id"] = pa.array(plan["sequence"][row] + nth // slots)
            out["offset"] = pa.array(plan["offsets"][plan["at"][row] + nth % slots])
            yield pa.record_batch(list(out.values()), names=list(out))

    return ranked(cut).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(store.documents(spark, sf_dir))
