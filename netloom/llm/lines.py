"""Near-duplicate lines by a segment-partition join under edit distance.

Every line that is not blank is judged. Equal lines are grouped by a cryptographic digest, whatever their length, whose first half
is the line's name; that no two lines of the data have one name is checked. How many edits may part unequal ones depends on the length of the shorter (EDITS). A line that allows e edits is cut into e + 1 segments; a line within
e edits of it has one of them unchanged, moved by no more than the edits before and after it allow. Each line indexes its
segments under its length, and looks up the substrings that could be such a segment in lines of its own length or shorter by
as many edits as those allow. Lines that meet are compared by a banded bit-parallel edit distance, whole batches of pairs at a
time, or where these are few and long, pair by pair along the diagonals. Lengths and distances are in UTF-8 bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import pigeonhole, scan, store

Steps = tuple[tuple[int, int], ...]
#: (bytes, edits): from how many bytes of the shorter line on how many edits may part two lines, one in twenty bytes. Shorter
#: lines must be equal: their segments would be of a few bytes, and an edit makes another word of them.
EDITS: Steps = ((1, 0), (20, 1), (40, 2))
KEY = ("doc_id", "text_key")
#: Bytes of text whose index entries are made at once: arrays are of a word a line, so more texts are taken than elsewhere.
INDEX_BYTES = 1 << 18


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def steps_of(edits: int | Steps, least: int) -> Steps:
    """``edits`` by length; a number allows as many from ``least`` bytes on."""
    return ((least, edits),) if isinstance(edits, int) else edits


def allowed(length: np.ndarray, steps: Steps) -> np.ndarray:
    """Edits that may part a line of each length from a longer one."""
    at = np.searchsorted([n for n, _ in steps], length, "right")
    return np.array([0, *(e for _, e in steps)])[at]


def _judged_lines(batch: pa.RecordBatch, column: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text of each line of at least ``least`` bytes that is not blank)."""
    data, offsets = scan.text_bytes(batch.column(column))
    breaks = np.flatnonzero(data == 0x0A)
    start, end = np.sort(np.append(offsets[:-1], breaks + 1)), np.sort(np.append(breaks, offsets[1:]))
    some = np.flatnonzero(end - start >= max(1, least))
    start, end = start[some], end[some]
    keep = scan.NOT_SPACE[data[start]]
    for i in np.flatnonzero(~keep):
        keep[i] = scan.NOT_SPACE[data[start[i] : end[i]]].any()
    start, end = start[keep], end[keep]
    return data, start, end, np.searchsorted(offsets, start, "right") - 1


def places(docs: DataFrame, least: int = 1, salt: int = 0) -> DataFrame:
    """Every line of at least ``least`` bytes that is not blank: line and check (halves of its digest), doc_id, text_key, start, size (bytes in its text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "text"):
            data, start, end, owner = _judged_lines(batch, 2, least)
            base = scan.offsets_of(batch.column(2))[owner]
            take = pa.array(owner)
            line, check = scan.digests(data.data, start, end, salt)
            yield pa.record_batch(
                [pa.array(line), pa.array(check), batch.column(0).take(take), batch.column(1).take(take), pa.array(start - base), pa.array((end - start).astype(np.int32))],
                names=["line", "check", "doc_id", "text_key", "start", "size"],
            )

    return keyed(docs).mapInArrow(run, "line long, check long, doc_id long, text_key long, start long, size int")


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of the edits + 1 segments of lines of these lengths; the longer ones come last."""
    parts = edits + 1
    short = length // parts
    long_ones = length - short * parts
    out, at = [], np.zeros_like(length)
    for i in range(parts):
        size = short + (i >= parts - long_ones)
        out.append((at, size))
        at = at + size
    return out


def index(docs: DataFrame, edits: int | Steps = EDITS, least: int = 1, salt: int = 0) -> DataFrame:
    """Index entries of all lines that an edit may part from others; those of negative size only look up. Segments are proposed by a cheap hash."""
    steps = steps_of(edits, least)
    near = max(least, min((n for n, e in steps if e), default=1 << 62))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pigeonhole.Entries]:
        for batch in scan.parts(batches, "text", INDEX_BYTES):
            data, start, end, _ = _judged_lines(batch, 2, near)
            sums = scan.prefix_sums(scan.BYTE_CODES[data])
            line, one = np.unique(scan.digests(data.data, start, end, salt)[0], return_index=True)
            line = line.view(np.uint64)
            start, length = start[one], (end - start)[one]
            for most in sorted({e for _, e in steps if e}):
                for shorter in range(most + 1):
                    mine = np.flatnonzero((length - shorter >= near) & (allowed(length - shorter, steps) == most))
                    of = length[mine] - shorter
                    for i, (at, size) in enumerate(segments(of, most)):
                        name = scan.mix((of.astype(np.uint64) << np.uint64(8)) | np.uint64(i))
                        for move in range(max(-i, shorter - (most - i)), min(i, shorter + most - i) + 1):
                            place = at + move
                            fits = np.flatnonzero((place >= 0) & (place + size <= of + shorter))
                            begin = start[mine[fits]] + place[fits]
                            code = scan.mix(scan.span_hash(sums, begin, begin + size[fits]) ^ name[fits])
                            own = 1 if shorter == 0 and move == 0 else -1
                            yield pigeonhole.entries(code, line[mine[fits]], own * length[mine[fits]])

    return keyed(docs).mapInArrow(lambda batches: pigeonhole.blocks(found(batches)), pigeonhole.BLOCKS)


def within(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """For each pair of byte strings, whether at most ``edits`` edits part them (edits at most 15).

    Hyyro's banded bit-parallel scheme: one column a step, the 2 * edits + 1 rows around the diagonal as bits of one word,
    all pairs of the batch side by side. A pair leaves once its band has no value of at most ``edits`` ahead.
    """
    n = len(a)
    out = np.zeros(n, bool)
    if not n:
        return out
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    short = (la < edits) | (lb == 0)
    live = np.flatnonzero((np.abs(la - lb) <= edits) & ~short)
    for i in np.flatnonzero((np.abs(la - lb) <= edits) & short):
        out[i] = _plain(a[i], b[i]) <= edits
    if not len(live):
        return out
    pad = 2 * edits + 2
    width = int(max(la[live].max(), lb[live].max())) + 2 * pad
    x, y = np.zeros((len(live), width), np.uint16), np.zeros((len(live), width), np.uint16)
    for r, i in enumerate(live):
        x[r, pad : pad + la[i]] = a[i].astype(np.uint16) + 1
        y[r, : lb[i]] = b[i].astype(np.uint16) + 1
    la, lb = la[live], lb[live]
    top = np.uint32(2 * edits)
    mask = np.uint32((1 << (2 * edits + 1)) - 1)
    one = np.uint32(1)
    vp = np.full(len(live), (mask >> np.uint32(edits)) << np.uint32(edits), np.uint32)
    vn = np.zeros(len(live), np.uint32)
    score = np.full(len(live), edits, np.int64)
    row = np.full(len(live), 2 * edits - 1, np.int64)  # bit of the last row once the band has passed it
    for j in range(int(lb.max())):
        match = np.zeros(len(live), np.uint32)
        for bit in range(2 * edits + 1):
            match |= (x[:, pad + j - edits + bit] == y[:, j]).astype(np.uint32) << np.uint32(bit)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        down = j < la - edits
        score += np.where(down, 1 - ((d0 >> top) & one).astype(np.int64), 0)
        shift = np.maximum(row, 0).astype(np.uint32)
        score += np.where(down, 0, ((hp >> shift) & one).astype(np.int64) - ((hn >> shift) & one).astype(np.int64))
        row -= ~down
        d1 = d0 >> one
        vp, vn = (hn | ~(d1 | hp)) & mask, d1 & hp
        ended = lb == j + 1
        if ended.any():
            out[live[ended]] = score[ended] <= edits
        stay = ~ended & (score <= 3 * edits)
        if stay.sum() < 0.8 * len(stay):
            live, la, lb, x, y, vp, vn, score, row = (v[stay] for v in (live, la, lb, x, y, vp, vn, score, row))
            if not len(live):
                break
    return out


def _plain(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance by the textbook recurrence, for lines shorter than the band."""
    before = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return before[-1]


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """item, content for the wanted places (line, doc_id, text_key, start, size), one of each line."""
    by_doc = store.written(wanted.groupBy(*KEY).agg(F.collect_list(F.struct("line", "start", "size")).alias("found")), "wanted")
    joined = store.beside(keyed(docs), by_doc, "found").select("text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "text"):
            data, offsets = scan.text_bytes(batch.column(0))
            raw = data.tobytes()
            flat = batch.column(1).flatten()
            line, start, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("line", "start", "size"))
            begin = start + np.repeat(offsets[:-1], np.diff(batch.column(1).offsets.to_numpy()))
            yield pa.record_batch([pa.array(line), pa.array([raw[p : p + s] for p, s in zip(begin, size, strict=True)], pa.binary())], names=["item", "content"])

    return joined.mapInArrow(run, "item long, content binary").dropDuplicates(["item"])


def reaches(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """Whether at most ``edits`` edits part two byte strings, by how far each diagonal gets with 0, 1, ... edits (Ukkonen)."""
    n, m = len(a), len(b)
    if abs(n - m) > edits:
        return False
    far = {0: 0}
    for e in range(edits + 1):
        if e:
            past = {d: max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1) for d in range(-e, e + 1)}
            far = {d: min(i, n, m - d) for d, i in past.items() if i >= 0 and i + d >= 0}
        for d, i in far.items():
            k = min(n - i, m - d - i)
            if k > 0:
                differ = a[i : i + k] != b[i + d : i + d + k]
                first = int(differ.argmax())
                far[d] = i + (first if differ[first] else k)
        if far.get(m - n, -1) >= n:
            return True
    return False


def pair_marks(line: np.ndarray) -> np.ndarray:
    """The parity of neighbouring pairs of bytes in each of 256 cells, as four words."""
    pairs = line[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + line[1:].astype(np.uint32) * np.uint32(0x85EBCA77)
    return np.packbits((np.bincount(pairs >> np.uint32(24), minlength=256) & 1).astype(np.uint8)).view(np.uint64)


def close_lines(left: list, right: list, edits: int) -> np.ndarray:
    """Whether at most ``edits`` edits part the lines of each pair; pairs of like lengths are compared together.

    An edit takes away two pairs of neighbouring bytes and makes two at most, so it turns at most four cells of ``pair_marks``;
    lines that differ in more cells than that allows are not compared further.
    """
    good = np.zeros(len(left), bool)
    if not len(left):
        return good
    lines = {id(v): np.frombuffer(v, np.uint8) for side in (left, right) for v in side}
    marks = {k: pair_marks(v) for k, v in lines.items()}
    apart = np.stack([marks[id(v)] for v in left]) ^ np.stack([marks[id(v)] for v in right])
    likely = np.flatnonzero(np.bitwise_count(apart).sum(axis=1) <= 4 * edits)
    x, y = [lines[id(v)] for v in left], [lines[id(v)] for v in right]
    order = likely[np.argsort([len(x[i]) for i in likely], kind="stable")]
    for at in range(0, len(order), 512):
        some = order[at : at + 512]
        if len(some) < 2 * len(x[some[-1]]):  # a step a byte of the longest costs more than a few steps a pair
            good[some] = [reaches(x[i], y[i], edits) for i in some]
        else:
            good[some] = within([x[i] for i in some], [y[i] for i in some], edits)
    return good


def linked_lines(left: list, right: list, steps: Steps) -> np.ndarray:
    """Whether no more edits part the lines of each pair than the shorter one allows."""
    good = np.zeros(len(left), bool)
    most = allowed(np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64), steps)
    for edits in np.unique(most):
        some = np.flatnonzero(most == edits)
        good[some] = close_lines([left[i] for i in some], [right[i] for i in some], int(edits))
    return good


def repeats(docs: DataFrame, edits: int | Steps = EDITS, least: int = 1) -> DataFrame:
    """doc_id, text_key, start, size of each line that is not the first of its class.

    Lines of at least ``least`` bytes that are not blank are linked when they are equal or no more edits part them than ``edits``
    allows the shorter one; a class is what links reach. Its first line is the one in the least doc_id (nulls last), then the
    earliest in its text.
    """
    steps = steps_of(edits, least)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"), F.col("start"))
    for salt in itertools.count():
        at = store.written(places(docs, least, salt), "line-places")
        lines = store.written(at.groupBy("line").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.min("size").alias("size"), (F.min("check") != F.max("check")).alias("clash")), "line-classes")
        if lines.where("clash").isEmpty():
            break
        store.drop(at, lines)
    one_each = lines.select("line", "first.doc_id", "first.text_key", "first.start", "size")

    near = pigeonhole.roots(
        index(docs, edits, least, salt),
        lambda x, y: np.abs(x - y) <= allowed(np.minimum(x, y), steps),
        lambda items: fetched(docs, one_each.join(items.withColumnRenamed("item", "line"), "line")),
        lambda x, y: linked_lines(x, y, steps),
    )
    tied = near.select("node", "root").union(near.select(F.col("root").alias("node"), "root")).distinct()
    classed = lines.join(tied.withColumnRenamed("node", "line"), "line", "left").where("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "line"))
    first = classed.groupBy("root").agg(F.min("first").alias("first"))
    known = store.written(classed.select("line", "root").join(first, "root").select("line", "first"), "first-of-class")
    return at.join(known, "line").where(order != F.col("first")).select(*KEY, "start", "size")


def _cut(text: str | None, spans: list | None) -> str | None:
    """``text`` without the lines at the given places, each with its line break."""
    if not spans:
        return text
    data, kept, at = text.encode(), [], 0
    for start, size in sorted((s["start"], s["size"]) for s in spans):
        kept.append(data[at:start])
        at = start + size + 1
    return (b"".join(kept) + data[at:]).decode()


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, cut (each text without the given lines), row (all columns of ``docs``)."""
    by_doc = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    rows = store.packed(docs).drop("text")
    joined = rows.alias("d").join(by_doc.alias("s").hint("shuffle_hash"), F.expr("d.doc_id <=> s.doc_id AND d.text_key = s.text_key"), "left").select("d.doc_id", "d.row", "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(1)
            texts = row.field(row.type.get_field_index("text"))
            found = batch.column(2).to_pylist()
            new = [_cut(t.as_py() if f else None, f) if f else None for t, f in zip(texts, found, strict=True)]
            changed = pa.array([bool(f) for f in found])
            cut = pa.compute.if_else(changed, pa.array(new, pa.string()), texts.cast(pa.string()))
            total = [t.as_py().count("\n") + 1 if t.is_valid and t.as_py() else 0 for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array([len(f or ()) for f in found], pa.int64()), cut, row], names=["doc_id", "n_lines", "n_removed", "cut", "row"])

    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id long, n_lines long, n_removed long, cut string, row {kind}")


def dedup(docs: DataFrame, edits: int | Steps = EDITS, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed, cut, row for each row of ``docs``: what stays of its text, and all its columns as they were.

    Of each class of lines (see ``repeats``) the first stays, whole; lines under ``least`` bytes and blank lines all stay. Null text stays null
    and has no lines, nor has empty text. Rows that repeat are cut alike.
    """
    return without(docs, repeats(docs, edits, least))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(store.documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("cut", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
