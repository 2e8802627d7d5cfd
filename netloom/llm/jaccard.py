"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole, and the classes of its links.

Sets are put into bands by size. In a band whose largest set has u elements, two similar sets differ in at most
H = 2u(1-t)/(1+t) elements. The universe of shingles is cut by hash into m segments, and each segment of a band is allocated a
value: 0, it has no index entries; 1, sets that agree in it wholly meet; 2, its one-deletion neighbourhoods are indexed beside
it, so that sets meet there too whose subsets differ in one element. Where the values sum up to more than H, two
similar sets meet in some segment. Which segment gets which value is decided by cost: entries, and pairs that would meet,
estimated over all sets by second moments of the segments' contents. All have value 1 at first; a segment whose contents are so
frequent that its pairs cost more than the neighbourhoods of another one gives its value to that one.

Empty subsets are the most frequent of all: m exceeds H by 1 + spare, and up to ``spare`` empty subsets of value 1 are left
out. Only a set with more of them indexes them as well; any two sets that need one then both have it. Sets that meet are
compared exactly. Equal sets count as one throughout.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm import pigeonhole, scan, store

WORDS = 4
#: Least similarity, in hundredths.
PERCENT = 85
#: Largest size over least size in a band.
RATIO = 1.25
#: Segments of a band that may give up their value at most: the bound of what the driver is sent. It changes costs, not results.
SWAPS = 64
#: How many times what it costs a change must save, since costs are estimates.
MARGIN = 1.5
#: Independent estimates of a second moment.
SIGNS = 8
KEY = ("doc_id", "text_key")
#: (band, segment, value) of the segments whose value is not 1.
Allocation = tuple[tuple[int, int, int], ...]


def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest size, segments, empty segments left out) of each band, for sets of up to ``most`` elements.

    Bands whose sets differ in no element if they are similar are left out: equal sets need no index.
    """
    sizes, u = [], 1
    while not sizes or sizes[-1] < most:
        if 2 * u * (100 - percent) >= 100 + percent:
            sizes.append(u)
            u = max(u + 1, int(u * RATIO))
        else:
            u += 1
    largest = np.array(sizes, dtype=np.int64)
    differ = 2 * largest * (100 - percent) // (100 + percent)
    spare = 3 + differ // 20
    return largest, differ + 1 + spare, spare


def shingle_sets(batch: pa.RecordBatch, column: int, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's different shingles, ascending, all texts joined; offsets of each text's).

    Words are parted by ASCII white space, A-Z lower-cased. A text of 1 to n - 1 words has one shingle, all of them.
    """
    data, offsets = scan.text_bytes(batch.column(column))
    starts, ends, first = scan.word_spans(data, offsets, scan.NOT_SPACE)
    words = np.diff(first)
    at = np.arange(len(starts))
    whole = np.repeat(first[1:], words)
    hashes = scan.Spans(scan.Spans(scan.LOWER[data], salt)(starts, ends), salt)(at, np.minimum(at + n, whole))
    use = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    sets = [np.unique(hashes[a : a + k]) for a, k in zip(first[:-1], use, strict=True)]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def _set_ids(elements: np.ndarray, offsets: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a digest of each set."""
    return scan.digests(elements.tobytes(), 8 * offsets[:-1], 8 * offsets[1:], salt)


def outline(elements: np.ndarray) -> bytes:
    """The size of a set, and for each of at least two cells an element the parity of the elements in it."""
    cells = 1 << max(6, int(2 * len(elements) - 1).bit_length())
    parity = np.bincount((elements & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.int64(len(elements)).tobytes() + np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(left: list, right: list, percent: int) -> np.ndarray:
    """Whether outlines leave it open that their sets are similar: each cell of unlike parity has an element in one set alone."""
    slot: dict[int, int] = {}
    items = []
    for x in itertools.chain(left, right):
        if id(x) not in slot:
            slot[id(x)] = len(items)
            items.append(x)
    i, j = (np.array([slot[id(x)] for x in side], np.int64) for side in (left, right))
    return may_be_similar_among(items, i, j, percent)


def may_be_similar_among(outlines: list, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """``may_be_similar`` for pairs given by their places in a list of outlines.

    Pairs are compared by the cells of the smaller outline, all of one size at once; the larger is folded to as many.
    """
    good = np.zeros(len(i), bool)
    if not len(i):
        return good
    items = [np.frombuffer(x, np.uint64) for x in outlines]
    width = np.array([len(x) - 1 for x in items])
    size = np.array([int(x[0]) for x in items])
    common = np.minimum(width[i], width[j])
    row = np.zeros(len(items), np.int64)
    for w in np.unique(common).tolist():
        some = np.flatnonzero(common == w)
        used = np.flatnonzero(np.bincount(np.concatenate((i[some], j[some])), minlength=len(items)))
        row[used] = np.arange(len(used))
        folded = np.stack([np.bitwise_xor.reduce(items[k][1:].reshape(-1, w), axis=0) for k in used.tolist()])
        x, y = row[i[some]], row[j[some]]
        for at in range(0, len(some), 4096):
            part = slice(at, at + 4096)
            differ = np.bitwise_count(folded[x[part]] ^ folded[y[part]]).sum(axis=1, dtype=np.int64)
            good[some[part]] = differ * (100 + percent) <= (size[used[x[part]]] + size[used[y[part]]]) * (100 - percent)
    return good


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _sign(code: np.ndarray, r: int) -> np.ndarray:
    return 1 - 2 * ((code >> np.uint64(r)) & np.uint64(1)).astype(np.int64)


class Cells(NamedTuple):
    """The segments of some sets in one band each, set by set."""

    of: np.ndarray  #: which of the sets
    number: np.ndarray  #: which segment
    place: np.ndarray  #: name of band and segment
    filled: np.ndarray  #: elements in it
    content: np.ndarray  #: sum of their mixed hashes
    begin: np.ndarray  #: where its elements begin among all
    use: np.ndarray  #: not an empty one that is left out, if its value is 1

    def deletions(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, place of the element left out) of each one-deletion neighbour of the given segments."""
        many = self.filled[of]
        which = np.repeat(of, many)
        return which, self.begin[which] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)

    def code(self, which: np.ndarray, less: np.ndarray | int = 0, fewer: int = 0) -> np.ndarray:
        """The index key of the given segments' contents, or of these without an element of mixed hash ``less`` (``fewer``: 1)."""
        return scan.mix(self.content[which] - np.uint64(less) + (self.filled[which] - fewer).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + scan.mix(self.place[which] + np.uint64(1)))


def _cells(elements: np.ndarray, sums: np.ndarray, offsets: np.ndarray, mine: np.ndarray, band: np.ndarray, segments: np.ndarray, spare: np.ndarray, value: np.ndarray) -> Cells:
    """``mine``: sets by number, ``band`` of each; ``value`` of each segment of all bands."""
    m = segments[band]
    count = np.diff(offsets)[mine]
    at = np.repeat(offsets[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    row = np.repeat(np.arange(len(mine)), count)
    segment = (((elements[at] >> np.uint64(32)) * m[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    base = np.cumsum(m) - m
    edge = np.searchsorted(base[row] + segment, np.arange(int(m.sum()) + 1))  # ascending, as elements are
    filled = np.diff(edge)
    of = np.repeat(np.arange(len(mine)), m)
    number = np.arange(len(of)) - base[of]
    begin = at[np.minimum(edge[:-1], len(at) - 1)]
    content = np.where(filled > 0, sums[begin + filled] - sums[begin], np.uint64(0))
    first = np.cumsum(segments) - segments
    worth = value[first[band][of] + number]
    empty = (filled == 0) & (worth == 1)
    many = np.bincount(of, weights=empty, minlength=len(mine)) > spare[band]
    place = (band[of].astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)
    return Cells(of, number, place, filled, content, begin, (worth > 0) & (~empty | many[of]))


def _in_bands(size: np.ndarray, percent: int, largest: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bands above the set's own, sets, band): each set is indexed in its own band and looks up those of similar larger sets."""
    own = np.searchsorted(largest, size)
    last = np.searchsorted(largest, size * 100 // percent)
    for step in range(int((last - own).max(initial=-1)) + 1):
        mine = np.flatnonzero((own + step <= last) & ((size + size * 100 // percent) * (100 - percent) >= 100 + percent))  # others are similar to equal sets alone
        if len(mine):
            yield step, mine, (own + step)[mine]


def _values(segments: np.ndarray, allocation: Allocation) -> np.ndarray:
    first = np.cumsum(segments) - segments
    out = np.ones(int(segments.sum()), np.int8)
    for band, segment, value in allocation:
        if band < len(first):
            out[first[band] + segment] = value
    return out


_SIZED = "doc_id long, text_key long, set long, check long, n_shingles long, outline binary, band int, segment int, entries long, elements long, signs array<long>, both array<long>"


def sets_of(docs: DataFrame, n: int, percent: int, salt: int = 0) -> DataFrame:
    """doc_id, text_key, set and check (halves of its digest; null for a text without words), n_shingles, outline; band is null.

    Further rows, with a band, tell of a task's segments: entries, elements, and sums of random signs of their contents, and of these
    and their one-deletion neighbourhoods, from which second moments are estimated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((2 + 2 * SIGNS, 0), np.int64)
        segments = np.zeros(0, np.int64)
        done = np.zeros(0, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("set", pa.int64()), ("check", pa.int64()), ("n_shingles", pa.int64()), ("outline", pa.binary()), ("band", pa.int32()), ("segment", pa.int32()), ("entries", pa.int64()), ("elements", pa.int64()), ("signs", pa.list_(pa.int64())), ("both", pa.list_(pa.int64()))])
        for batch in scan.parts(batches, "text"):
            elements, offsets = shingle_sets(batch, 2, n, salt)
            size = np.diff(offsets)
            ids, check = _set_ids(elements, offsets, salt)
            none = size == 0
            found = [batch.column(0), batch.column(1), pa.array(ids, mask=none), pa.array(check, mask=none), pa.array(size), pa.array([outline(elements[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())]
            yield pa.record_batch(found + [pa.nulls(batch.num_rows, f.type) for f in list(schema)[6:]], schema=schema)
            _, once = np.unique(ids, return_index=True)
            fresh = once[~np.isin(ids[once], done) & ~none[once]]
            done = np.concatenate((done[-50_000:], ids[fresh]))
            largest, wider, spare = bands(percent, int(size.max(initial=1)) * 100 // percent + 1)
            if len(wider) > len(segments):
                segments = wider
                tally = np.concatenate((tally, np.zeros((len(tally), int(segments.sum()) - tally.shape[1]), np.int64)), axis=1)
            first = np.cumsum(segments) - segments
            mixed = scan.mix(elements)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
            for _, mine, band in _in_bands(size[fresh], percent, largest):
                cells = _cells(elements, sums, offsets, fresh[mine], band, wider, spare, _values(wider, ()))
                keep = np.flatnonzero(cells.use)
                slot = first[band][cells.of[keep]] + cells.number[keep]
                code = cells.code(keep)
                np.add.at(tally[0], slot, 1)
                np.add.at(tally[1], slot, cells.filled[keep])
                which, gone = cells.deletions(keep)
                fewer = cells.code(which, mixed[gone], 1)
                at = first[band][cells.of[which]] + cells.number[which]
                for r in range(SIGNS):
                    np.add.at(tally[2 + r], slot, _sign(code, r))
                    np.add.at(tally[2 + SIGNS + r], at, _sign(fewer, r))
        used = np.flatnonzero(tally[0]) if tally.shape[1] else np.zeros(0, np.int64)
        if len(used):
            first = np.cumsum(segments) - segments
            band = np.searchsorted(first, used, "right") - 1
            listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * SIGNS), pa.array(x.T.ravel()))
            exact, fewer = tally[2 : 2 + SIGNS, used], tally[2 + SIGNS :, used]
            told = [pa.array(band.astype(np.int32)), pa.array((used - first[band]).astype(np.int32)), pa.array(tally[0, used]), pa.array(tally[1, used]), listed(exact), listed(exact + fewer)]
            yield pa.record_batch([pa.nulls(len(used), f.type) for f in list(schema)[:6]] + told, schema=schema)

    return keyed(docs).mapInArrow(run, _SIZED)


def allocated(told: DataFrame) -> Allocation:
    """The segments that give up their value, and those that take it on, by the rows of ``sets_of`` that have a band.

    A segment of value 1 costs its entries and the pairs of equal ones; one of value 2 has its elements (deletions) as entries too, and
    the pairs of all these. In each band the dearest are matched with those that are cheapest to double, as long as that saves.
    """
    moment = lambda x: sum((F.pow(F.sum(F.col(x)[r]), 2) for r in range(SIGNS)), F.lit(0.0)) / SIGNS
    costs = told.groupBy("band", "segment").agg(F.sum("entries").alias("n"), F.sum("elements").alias("filled"), moment("signs").alias("one"), moment("both").alias("two"))
    costs = costs.withColumn("pairs", F.greatest(F.lit(0.0), F.col("one") - F.col("n")) / 2).withColumn("more", F.greatest(F.col("pairs"), (F.col("two") - F.col("n") - F.col("filled")) / 2))
    band = Window.partitionBy("band")
    ranked = costs.select("band", "segment", (F.col("n") + F.col("pairs")).alias("saved"), (F.col("filled") + F.col("more") - F.col("pairs")).alias("extra"), F.floor(F.count("*").over(band) / 2).alias("half"))
    dear = ranked.withColumn("k", F.row_number().over(band.orderBy(F.desc("saved"), "segment"))).where(F.col("k") <= F.least("half", F.lit(SWAPS)))
    cheap = ranked.withColumn("k", F.row_number().over(band.orderBy("extra", "saved", F.desc("segment")))).where(F.col("k") <= F.least("half", F.lit(SWAPS)))
    both = dear.alias("x").join(cheap.alias("y"), ["band", "k"]).where(f"x.saved > {MARGIN} * y.extra AND x.segment <> y.segment")
    rows = both.select("band", "k", F.col("x.segment").alias("off"), F.col("y.segment").alias("on")).collect()  # at most SWAPS for each band
    off = {(r["band"], r["off"]) for r in rows}
    good = [r for r in rows if (r["band"], r["on"]) not in off]
    return tuple(sorted(x for r in good for x in ((r["band"], r["off"], 0), (r["band"], r["on"], 2))))


def index(docs: DataFrame, n: int, percent: int, salt: int = 0, allocation: Allocation = ()) -> DataFrame:
    """The index entries of all sets: segment (hash of band, segment and content), set, size (negative in a band above its own)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pigeonhole.Entries]:
        done = np.zeros(0, np.int64)
        for batch in scan.parts(batches, "text"):
            elements, offsets = shingle_sets(batch, 2, n, salt)
            size = np.diff(offsets)
            ids, _ = _set_ids(elements, offsets, salt)
            _, once = np.unique(ids, return_index=True)
            fresh = once[~np.isin(ids[once], done) & (size[once] > 0)]
            done = np.concatenate((done[-50_000:], ids[fresh]))
            largest, segments, spare = bands(percent, int(size.max(initial=1)) * 100 // percent + 1)
            value = _values(segments, allocation)
            mixed = scan.mix(elements)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
            first = np.cumsum(segments) - segments
            for step, mine, band in _in_bands(size[fresh], percent, largest):
                cells = _cells(elements, sums, offsets, fresh[mine], band, segments, spare, value)
                item, signed = ids[fresh[mine]], (1 if step == 0 else -1) * size[fresh[mine]]
                keep = np.flatnonzero(cells.use)
                yield pigeonhole.entries(cells.code(keep), item[cells.of[keep]], signed[cells.of[keep]])
                if allocation:
                    which, gone = cells.deletions(np.flatnonzero(value[first[band][cells.of] + cells.number] == 2))
                    yield pigeonhole.entries(cells.code(which, mixed[gone], 1), item[cells.of[which]], signed[cells.of[which]])

    return keyed(docs).mapInArrow(lambda batches: pigeonhole.blocks(found(batches)), pigeonhole.BLOCKS)


def elements_of(docs: DataFrame, chosen: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """item, content: the elements of the chosen sets (item, doc_id, text_key), ascending 64-bit numbers."""
    chosen = store.written(chosen.groupBy(*KEY).agg(F.collect_list("item").alias("items")), "chosen", narrow=True)
    texts = store.beside(keyed(docs), chosen, "items").select(F.col("items")[0].alias("item"), "text")  # a text has one set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "text"):
            values, offsets = shingle_sets(batch, 1, n, salt)
            raw = values.tobytes()
            yield pa.record_batch([batch.column(0), pa.array([raw[8 * i : 8 * j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["item", "content"])

    return texts.mapInArrow(run, "item long, content binary").dropDuplicates(["item"])


def similar(left: list, right: list, percent: int) -> np.ndarray:
    """Whether the sets of each pair are similar."""
    good = np.zeros(len(left), bool)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.sort(np.concatenate((x, y)), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        good[i] = 100 * common >= percent * (len(x) + len(y) - common)
    return good


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, allocation: Allocation | None = None) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, root for each row of ``docs``.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of n-word shingles; component_id is the
    least doc_id that links reach, the document's own included (a null doc_id counts as none). A null, empty or blank
    text has no shingles and no links: its component_id is its own doc_id. ``root`` is the same for what links reach, whatever its
    doc_ids, and null without shingles. Repeated rows are linked. Other columns are ignored. Without
    an ``allocation`` one is made by cost; results are the same with any whose values of each band sum up to its segments.
    """
    for salt in itertools.count():
        sized = store.written(sets_of(docs, n, percent, salt), "set-of-document")
        real = sized.where("set IS NOT NULL")
        sets = store.written(real.groupBy("set").agg(F.min("doc_id").alias("least"), F.min(F.struct(*KEY)).alias("one"), (F.min("check") != F.max("check")).alias("clash")), "sets", narrow=True)
        if sets.where("clash").isEmpty():  # so a set's name is its own
            break
        store.drop(sized, sets)
    if allocation is None:
        allocation = allocated(sized.where("band IS NOT NULL"))
    chosen = sets.select("one.*", F.col("set").alias("item"))
    outlines = real.select(F.col("set").alias("item"), F.col("outline").alias("content")).dropDuplicates(["item"])
    near = pigeonhole.roots(
        index(docs, n, percent, salt, allocation),
        lambda x, y: np.minimum(x, y) * 100 >= np.maximum(x, y) * percent,
        lambda items: elements_of(docs, chosen.join(items, "item"), n, salt),
        lambda x, y: similar(x, y, percent),
        outlines,
        lambda x, y: may_be_similar(x, y, percent),
        lambda x, i, j: may_be_similar_among(x, i, j, percent),
    )
    rooted = sets.select("set", "least").join(near.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = rooted.join(least, "root").select("set", "component_id", "root")
    out = sized.where("band IS NULL").join(by_set, "set", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(store.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
