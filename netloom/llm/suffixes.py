"""Removal of repeated byte strings by suffix arrays, sorted by induction from disk-backed queues.

A string of LENGTH bytes has a minimizer, the GRAM-byte string of least hash in it; equal strings have equal ones. Runs of
strings with one minimizer are compared by hash first: a minimizer that comes once has no repeats, and runs with equal
content are repeats of each other. What is left, runs of unlike content around one minimizer, may have single strings in
common. Such strings agree on at least half of what surrounds the minimizer, on its left or its right, so these halves name
the shards: all runs with one half go to one shard, whose suffix array and common prefixes say which of their strings
start anywhere else. Only the bytes around such minimizers are ever sorted. Where more runs share a half than a task should
take, their strings are compared by hashed keys instead.
""" 

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import scan, store

LENGTH = 400
GRAM = 32
KEY = ("doc_id", "text_key")
#: Bytes that a shard gathers before it is sorted; runs with one half of a surrounding stay together.
SHARD_BYTES = 1 << 22
#: Bytes of text that are cut into runs at once.
RUN_BYTES = 1 << 16
#: Runs of one half beyond which its strings are compared by key over all tasks, not in one shard.
LARGE = 16_384
#: Suffix tuples that queues hold in memory; the others are on disk.
HELD = 1 << 20
#: Bytes of an array beyond which it is on disk.
MAPPED = 1 << 22
#: Names of a recursion that are sorted in memory.
DIRECT = 1 << 20


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs of strings of ``length`` bytes with one minimizer: mini (hash), content, check (halves of a digest), doc_id, text_key, at, n (strings), mid.

    ``left`` and ``right``: hashes, which only propose, of the minimizer at ``mid`` with the bytes before or after it that half of a string could have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "text", RUN_BYTES):
            data, offsets = scan.text_bytes(batch.column(2))
            sums = scan.prefix_sums(scan.BYTE_CODES[data])
            at = np.arange(max(len(data) - gram + 1, 0))
            grams = scan.span_hash(sums, at, at + gram)
            start, n, mini = scan.minimizer_runs(grams, np.repeat(offsets[1:], np.diff(offsets)), gram, length)
            owner = np.searchsorted(offsets, start, "right") - 1
            take = pa.array(owner)
            # two equal strings that hold a gram share at least half of what they have besides it on one side of it
            side = (length - gram) // 2
            before, after = mini - side, mini + gram + side
            left = np.where(before >= offsets[owner], scan.span_hash(sums, np.maximum(before, 0), mini + gram), np.uint64(0))
            right = np.where(after <= offsets[owner + 1], scan.span_hash(sums, mini, np.minimum(after, len(data))), np.uint64(0))
            content, check = scan.digests(data.data, start, start + n + length - 1)
            yield pa.record_batch(
                [pa.array(scan.signed(grams[mini])), pa.array(content), pa.array(check), batch.column(0).take(take), batch.column(1).take(take), pa.array(start - offsets[owner]), pa.array(n.astype(np.int32)), pa.array(mini - offsets[owner]), pa.array(scan.signed(left), mask=left == 0), pa.array(scan.signed(right), mask=right == 0)],
                names=["mini", "content", "check", "doc_id", "text_key", "at", "n", "mid", "left", "right"],
            )

    return keyed(docs).mapInArrow(run, "mini long, content long, check long, doc_id long, text_key long, at long, n int, mid long, left long, right long")


class Queues:
    """A disk-backed priority queue of suffix tuples (place, common prefix), by first symbol and then by arrival.

    Induced sorting inserts tuples of one symbol in their final order, so each symbol has a first-in, first-out queue and the
    queue of the next symbol is the next to be served. Tuples beyond ``held`` in memory go to a file in runs, one
    run of each symbol at a time, and come back when their symbol is served. The file is a task's own scratch, like Spark's
    spills: it has no name, no other process reads it, and it is gone when the task ends.
    """

    def __init__(self, symbols: int, held: int) -> None:
        self.memory: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(symbols)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.held, self.inside = held, 0
        self.file = None

    def put(self, symbol: int, place: np.ndarray, common: np.ndarray) -> None:
        self.memory[symbol].append((place, common))
        self.inside += len(place)
        if self.inside > self.held:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, runs_ in enumerate(self.memory):
            if runs_:
                place = np.concatenate([x for x, _ in runs_]).astype(np.int64)
                self.spilled[symbol].append((self.file.tell(), len(place)))
                self.file.write(place.tobytes())
                self.file.write(np.concatenate([x for _, x in runs_]).astype(np.int32).tobytes())
                self.memory[symbol] = []
        self.inside = 0

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tuples of a symbol in order, those that arrive meanwhile included."""
        while self.spilled[symbol] or self.memory[symbol]:
            for at, n in self.spilled[symbol]:
                self.file.seek(at)
                yield np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(4 * n), np.int32)
            self.spilled[symbol] = []
            now, self.memory[symbol] = self.memory[symbol], []
            if now:
                place, common = (np.concatenate(x) for x in zip(*now, strict=True)) if len(now) > 1 else now[0]
                self.inside -= len(place)
                yield place, common

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Scratch:
    """Arrays of over MAPPED bytes are kept in a nameless file, a task's own scratch like Spark's spills, and mapped from there."""

    def __init__(self) -> None:
        self.file, self.end = None, 0

    def keep(self, array: np.ndarray) -> np.ndarray:
        if array.nbytes <= MAPPED:
            return array
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        self.file.write(np.ascontiguousarray(array).data)
        self.file.flush()
        self.end += array.nbytes
        return np.memmap(self.file, array.dtype, "r+", self.end - array.nbytes, array.shape)


def suffix_types(text: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """True where a suffix is less than the next one (type S), block by block from the end. The last symbol is the least and occurs once."""
    n = len(text)
    up = np.zeros(n, bool)
    up[-1] = True
    for a in range((n - 2) // block * block, -1, -block):
        b = min(a + block, n - 1)
        differs = text[a:b] != text[a + 1 : b + 1]
        index = np.where(differs, np.arange(a, b), b)
        ahead = np.minimum.accumulate(index[::-1])[::-1]  # the next symbol that differs from the one after it
        up[a:b] = np.where(ahead == b, up[b], text[np.minimum(ahead, n - 2)] < text[np.minimum(ahead, n - 2) + 1])
    return up


def _substring_names(text: np.ndarray, up: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ascending names of the substrings between neighbouring LMS places, by their symbols and types; equal ones share a name."""
    length = np.diff(np.append(lms, len(text) - 1)) + 1
    length[-1] = 1
    bits = int(2 * int(text.max()) + 2).bit_length()
    fit = 63 // bits
    end = len(text) - 1

    def word(which: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for j in range(k * fit, (k + 1) * fit):
            at = np.minimum(lms[which] + j, end)
            out = (out << np.uint64(bits)) | np.where(j < length[which], text[at].astype(np.uint64) * np.uint64(2) + up[at] + np.uint64(1), np.uint64(0))
        return out

    everything = np.arange(len(lms))
    _, rank, sizes = np.unique(word(everything, 0), return_inverse=True, return_counts=True)
    rank = (np.cumsum(sizes) - sizes)[rank]
    k = 1
    open_ = everything
    while True:
        _, first, inverse, sizes = np.unique(rank[open_], return_index=True, return_inverse=True, return_counts=True)
        longest = np.zeros(len(sizes), np.int64)
        np.maximum.at(longest, inverse, length[open_])
        open_ = open_[(sizes > 1)[inverse] & (longest > k * fit)[inverse]]
        if not len(open_):
            return np.unique(rank, return_inverse=True)[1]
        w = word(open_, k)
        order = np.lexsort((w, rank[open_]))
        r, w = rank[open_][order], w[order]
        group = np.concatenate(([True], r[1:] != r[:-1]))
        new = group | np.concatenate(([True], w[1:] != w[:-1]))
        at = np.arange(len(order))
        begin, tie = np.maximum.accumulate(np.where(group, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank[open_[order]] = r + (tie - begin)
        k += 1


def _doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ``names`` by doubling the symbols compared; only places still tied are sorted again."""
    m = len(names)
    sizes = np.bincount(names)
    rank = (np.cumsum(sizes) - sizes)[names]
    open_ = np.flatnonzero(sizes[names] > 1)
    h = 1
    while len(open_):
        after = np.where(open_ + h < m, rank[np.minimum(open_ + h, m - 1)] + 1, 0)
        key = rank[open_] * (m + 1) + after
        order = np.argsort(key, kind="stable")
        key, at = key[order], np.arange(len(order))
        r = key // (m + 1)
        group, new = np.concatenate(([True], r[1:] != r[:-1])), np.concatenate(([True], key[1:] != key[:-1]))
        begin, tie = np.maximum.accumulate(np.where(group, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank[open_[order]] = r + (tie - begin)
        edge = np.append(np.flatnonzero(new), len(order))
        open_ = open_[order[np.repeat(np.diff(edge) > 1, np.diff(edge))]]
        h *= 2
    out = np.empty(m, np.int64)
    out[rank] = np.arange(m)
    return out


def _in_fours(padded: np.ndarray) -> np.ndarray:
    """Four symbols at each place as one word, of 16-bit symbols with four more at the end."""
    return np.ndarray((len(padded) - 4,), np.uint64, padded, strides=(2,))


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, known: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``most``; at least ``known``, which is not compared again.

    The last symbol is in one of them alone, so they part before its end.
    """
    out = np.full(len(a), most, np.int64)
    at = np.zeros(len(a), np.int64) if known is None else np.minimum(known, most)
    live = np.flatnonzero(at < most)
    at = at[live]
    while len(live):
        differ = words[a[live] + at] ^ words[b[live] + at]
        ended = differ != 0
        if ended.any():
            low = differ[ended]
            low &= np.uint64(0) - low  # the lowest bit that differs
            inside = (low > np.uint64(0xFFFF)).astype(np.int64) + (low > np.uint64(0xFFFFFFFF)) + (low > np.uint64(0xFFFFFFFFFFFF))
            out[live[ended]] = np.minimum(at[ended] + inside, most)
        at += 4
        on = ~ended & (at < most)
        live, at = live[on], at[on]
    return out


#: Of so many LMS suffixes in text order, one is compared from its start.
SPARSE = 8


def _lms_common(words: np.ndarray, lms: np.ndarray, sorted_lms: np.ndarray, most: int) -> np.ndarray:
    """What each of the sorted LMS suffixes shares with the one before it, up to ``most``.

    If the suffix at p shares L with its predecessor q, that at p + d shares at least L - d with its own, provided that q + d is an
    LMS place too: for then it is a lesser suffix of the list, and no one between them shares less. So most suffixes
    are only compared beyond what one a little before them in the text shares.
    """
    out = np.zeros(len(lms), np.int64)
    listed = np.zeros(len(words), bool)
    listed[lms] = True
    ranks = np.empty(len(words), np.int32)  # by place
    ranks[sorted_lms] = np.arange(len(lms))
    rank = ranks[lms]
    before = np.where(rank > 0, sorted_lms[np.maximum(rank - 1, 0)], -1)  # in text order
    sample = np.arange(0, len(lms), SPARSE)
    some = sample[before[sample] >= 0]
    shared = np.zeros(len(lms), np.int64)
    shared[some] = _common(words, lms[some], before[some], most)
    rest = np.flatnonzero((np.arange(len(lms)) % SPARSE > 0) & (before >= 0))
    of = rest - rest % SPARSE
    d = lms[rest] - lms[of]
    far = before[of] + d
    known = np.where((before[of] >= 0) & listed[np.minimum(far, len(words) - 1)], np.maximum(shared[of] - d, 0), 0)
    shared[rest] = _common(words, lms[rest], before[rest], most, known)
    out[rank] = shared
    return out


def _range_min(values: np.ndarray):
    """A function of (lo, hi) arrays: the least of values[lo:hi] in each, for hi > lo."""
    levels = [values]
    while (1 << len(levels)) <= len(values):
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-half], last[half:]))

    def of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), values.dtype)
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(levels[k][lo[some]], levels[k][hi[some] - (1 << k)])
        return out

    return of


class _Induction:
    """One direction of induced sorting: sources in order give their predecessors to queues, with common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: int, most: int, held: int) -> None:
        self.text, self.wanted, self.most = text, wanted, most
        self.queues = Queues(symbols, held)
        self.since = np.zeros(symbols, np.int64)  # least common prefix of the sources since a symbol's last insertion

    def feed(self, place: np.ndarray, common: np.ndarray) -> None:
        """Sources in order; common[i] is what source i shares with the source before it."""
        keep = np.flatnonzero(place > 0)
        keep = keep[self.wanted[place[keep] - 1]]
        if not len(keep):
            if self.most and len(common):
                np.minimum(self.since, common.min(), out=self.since)
            return
        before = place[keep] - 1
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        index, symbol, before = keep[order], symbol[order], before[order]
        first = np.concatenate(([True], symbol[1:] != symbol[:-1]))
        edge = np.flatnonzero(np.append(first, True)).tolist()
        shared = np.zeros(len(index), np.int64)
        if self.most:
            lo = np.where(first, 0, np.concatenate(([0], index[:-1] + 1)))
            least = _range_min(common)
            shared = least(lo, index + 1)
            shared = np.where(first, np.minimum(shared, self.since[symbol]), shared)
            shared = np.minimum(shared + 1, self.most)
            np.minimum(self.since, common.min(), out=self.since)
            ends = index[np.array(edge[1:]) - 1] + 1  # after a symbol's last source
            rest = np.minimum.accumulate(common[::-1])[::-1]
            self.since[symbol[edge[:-1]]] = np.where(ends < len(common), rest[np.minimum(ends, len(common) - 1)], self.most)
        for a, b, s in zip(edge[:-1], edge[1:], symbol[edge[:-1]].tolist(), strict=True):
            self.queues.put(s, before[a:b], shared[a:b])


def suffix_array(text: np.ndarray, most: int = 0, held: int = HELD, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray]:
    """(places of all suffixes in order, what each shares with the one before, up to ``most``), from ``suffix_blocks``."""
    blocks = list(suffix_blocks(text, most, held, direct))
    return np.concatenate([x for x, _ in blocks]), np.concatenate([x for _, x in blocks])


def suffix_blocks(text: np.ndarray, most: int = 0, held: int = HELD, direct: int = DIRECT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffix array by first symbol: (places, what each shares with the one before it, up to ``most``).

    ``text``: symbols of 16 bits, of which the last is the least and occurs once. LMS suffixes are named by their substrings;
    the string of names is sorted in memory up to ``direct`` names, and else, in digits of one symbol each, by this same function.
    From their order queues induce that of the L suffixes, ascending, and then of the S suffixes, descending; a tuple's
    common prefix is one more than the least among the sources since the last of its symbol. With ``most`` 0 only the order is made.
    The text, its types, the sorted L suffixes and the blocks are mapped from a file where they are large.
    """
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    scratch = Scratch()
    padded = scratch.keep(np.concatenate((text, np.zeros(4, text.dtype))).astype(np.uint16))
    text, words = padded[:n], _in_fours(padded)
    symbols = int(text.max()) + 1
    up = scratch.keep(suffix_types(text))
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    names = _substring_names(text, up, lms)
    kinds = int(names.max()) + 1
    if kinds == len(lms) or len(lms) <= direct:
        sorted_lms = lms[_doubled(names)]
    else:
        digits = 1 if kinds <= 512 else 2  # of 16 bits, for up to 2**32 names
        base = kinds if digits == 1 else int(np.ceil(np.sqrt(kinds)))
        parts = [names] if digits == 1 else [names // base, names % base]
        # the last name is the least and occurs once; it alone is written with the least digit, once
        string = np.stack(parts, axis=1).ravel().astype(np.int64) + 1
        string = np.concatenate((string[: digits * (len(lms) - 1)], [0]))
        order, _ = suffix_array(string, 0, held, direct)
        order = order[order % digits == 0] // digits
        sorted_lms = lms[order]
    lms_common = _lms_common(words, lms, sorted_lms, most) if most else np.zeros(len(lms), np.int64)
    bounds = np.searchsorted(text[sorted_lms], np.arange(symbols + 1))
    sorted_lms, lms_common = scratch.keep(sorted_lms), scratch.keep(lms_common.astype(np.int32))
    none = np.zeros(0, np.int64)
    ascending = _Induction(text, ~up, symbols, most, held)
    lows: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(symbols):
        got = []
        started = False
        for place, common in ascending.queues.take(s):
            if not started:
                common = np.concatenate(([0], common[1:]))  # first of its symbol
                started = True
            got.append((place, common))
            ascending.feed(place, common)
        place, common = sorted_lms[bounds[s] : bounds[s + 1]], lms_common[bounds[s] : bounds[s + 1]].astype(np.int64)
        if len(place):
            common[0] = _common(words, got[-1][0][-1:], place[:1], most)[0] if got and most else 0
            ascending.feed(place, common)
        lows.append(tuple(scratch.keep(np.concatenate(x)) for x in zip(*got, strict=True)) if got else (none, none))
    ascending.queues.close()
    descending = _Induction(text, up, symbols, most, held)
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(symbols - 1, -1, -1):
        low, low_common = lows.pop()
        got = []
        started = False
        for place, common in ([(np.array([n - 1]), np.zeros(1, np.int64))] if s == text[-1] else descending.queues.take(s)):
            if not started:
                common = np.concatenate(([0], common[1:]))
                started = True
            got.append((place, common))
            descending.feed(place, common)
        high = np.concatenate([x for x, _ in got]) if got else none
        high_common = np.concatenate([x for _, x in got]) if got else none
        meets = _common(words, low[-1:], high[-1:], most) if len(low) and len(high) and most else np.zeros(1, np.int64)
        if len(low):
            # descending: each source's value is what it shares with the source before it, the next greater one
            back = np.concatenate((meets if len(high) else [0], low_common[1:][::-1]))
            descending.feed(low[::-1], back)
        # ascending values of the S part: the shift by one of the descending ones
        up_common = np.concatenate((meets if len(low) else [0], high_common[1:][::-1])) if len(high) else high_common
        blocks.append((scratch.keep(np.concatenate((low, high[::-1]))), scratch.keep(np.concatenate((low_common, up_common)).astype(np.int32))))
    descending.queues.close()
    while blocks:
        yield blocks.pop()


def repeated_starts(shard: list[np.ndarray], length: int, held: int = HELD, direct: int = DIRECT) -> list[np.ndarray]:
    """For each byte string of a shard, where in it a string of ``length`` bytes starts that also starts elsewhere in the shard."""
    sizes = np.array([len(x) for x in shard])
    text = np.zeros(int(sizes.sum()) + len(shard) + 1, np.uint16)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    for x, a in zip(shard, begins, strict=True):
        text[a : a + len(x)] = x
        text[a : a + len(x)] += 2
    text[ends - 1] = 1
    found = []
    for place, common in suffix_blocks(text, length, held, direct):  # strings of different blocks differ
        near = common >= length
        found.append(place[near | np.append(near[1:], False)])
    again = np.concatenate(found)
    owner = np.searchsorted(ends, again, "right")
    inside = again - begins[np.minimum(owner, len(shard) - 1)]
    good = (owner < len(shard)) & (inside + length <= sizes[np.minimum(owner, len(shard) - 1)])
    owner, inside = owner[good], inside[good]
    order = np.lexsort((inside, owner))
    return np.split(inside[order], np.searchsorted(owner[order], np.arange(1, len(shard))))


def regions(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs (half, doc_id, text_key, at, n, lone), each from its first string's start to its last one's end."""
    by_doc = wanted.groupBy(*KEY).agg(F.collect_set(F.struct("half", "at", "n", "lone")).alias("found"))
    joined = keyed(docs).alias("d").join(by_doc.alias("w").hint("shuffle_hash"), F.expr("d.doc_id <=> w.doc_id AND d.text_key = w.text_key")).select("d.doc_id", "d.text_key", "d.text", "w.found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "text"):
            data, offsets = scan.text_bytes(batch.column(2))
            raw = data.tobytes()
            flat = batch.column(3).flatten()
            many = np.diff(batch.column(3).offsets.to_numpy())
            at, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
            begin = at + np.repeat(offsets[:-1], many)
            take = pa.array(np.repeat(np.arange(batch.num_rows), many))
            content = pa.array([raw[a : a + k + length - 1] for a, k in zip(begin, n, strict=True)], pa.binary())
            yield pa.record_batch([flat.field("half"), batch.column(0).take(take), batch.column(1).take(take), flat.field("at"), flat.field("lone"), content], names=["half", "doc_id", "text_key", "at", "lone", "content"])

    return joined.mapInArrow(run, "half long, doc_id long, text_key long, at long, lone boolean, content binary")


def sorted_shards(texts: DataFrame, length: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text_key, start, end: the strings of lone runs that other runs of their half have too, joined where they overlap."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([np.frombuffer(r[5], np.uint8) for r in rows], length)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for row, starts in zip(rows, found, strict=True):
            if row[4] and len(starts):
                gap = np.flatnonzero(np.diff(starts) > length)
                for a, b in zip(starts[np.concatenate(([0], gap + 1))], starts[np.append(gap, len(starts) - 1)], strict=True):
                    for column, value in zip(out, (row[1], row[2], row[3] + int(a), row[3] + int(b) + length), strict=True):
                        column.append(value)
        return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["doc_id", "text_key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if rows and row[:4] == rows[-1][:4]:
                    continue  # of a repeated row
                if size >= shard_bytes and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield solve(rows)

    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(tasks, "half").sortWithinPartitions("half", *KEY, "at").mapInArrow(run, "doc_id long, text_key long, start long, end long")


def keyed_strings(texts: DataFrame, length: int) -> DataFrame:
    """The same as ``sorted_shards`` for halves that very many runs have: strings are grouped by a digest, beside the hash of their half.

    Counts are summed before they are shuffled, and the rows of a frequent string can be split over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.parts(batches, "content", 1 << 18):
            data, offsets = scan.text_bytes(batch.column(5))
            many = np.diff(offsets) - length + 1
            owner = np.repeat(np.arange(batch.num_rows), many)
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start = offsets[owner] + inside
            take = pa.array(owner)
            at = batch.column(3).to_numpy()[owner] + inside
            string, check = scan.digests(data.data, start, start + length)
            yield pa.record_batch([batch.column(0).take(take), pa.array(string), pa.array(check), batch.column(1).take(take), batch.column(2).take(take), pa.array(at), batch.column(4).take(take)], names=["half", "string", "check", "doc_id", "text_key", "start", "lone"])

    strings = store.written(texts.mapInArrow(run, "half long, string long, check long, doc_id long, text_key long, start long, lone boolean"), "strings")
    again = store.written(strings.groupBy("half", "string", "check").agg(F.count("*").alias("k")).where("k > 1").drop("k"), "repeated-strings", narrow=True)
    return strings.where("lone").join(again, ["half", "string", "check"]).select(*KEY, "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, start, end (bytes, end exclusive) of strings of ``length`` bytes that also start anywhere else."""
    same = ["mini", "content", "check"]
    found = store.written(runs(docs, length, gram), "runs")
    shared = store.written(found.groupBy("mini").agg(F.count("*").alias("k"), F.min(F.struct("content", "check")).alias("c0"), F.max(F.struct("content", "check")).alias("c1")).where("k > 1").select("mini", (F.col("c0") != F.col("c1")).alias("branches")), "shared-minimizers", narrow=True)
    met = store.written(found.join(shared, "mini"), "shared-runs")
    store.drop(found, shared)
    one = F.struct(*KEY, "at", "n", "mid", "left", "right")
    contents = store.written(met.groupBy(*same).agg(F.count("*").alias("copies"), F.min(one).alias("one"), F.max("branches").alias("branches")), "run-contents")
    copied = met.join(contents.where("copies > 1").select(*same), same)
    whole = copied.select(*KEY, F.col("at").alias("start"), (F.col("at") + F.col("n") + (length - 1)).alias("end"))
    branching = contents.where("branches").select("one.*", (F.col("copies") == 1).alias("lone"))
    last = F.col("at") + F.col("n") - 1
    pivot = F.col("mid") - (length - gram) // 2
    before = branching.where("left IS NOT NULL").select(F.col("left").alias("half"), *KEY, "at", (F.least(last, pivot) - F.col("at") + 1).cast("int").alias("n"), "lone")
    start = F.greatest(F.col("at"), pivot + 1)
    after = branching.where("right IS NOT NULL").select(F.col("right").alias("half"), *KEY, start.alias("at"), (last - start + 1).cast("int").alias("n"), "lone")
    halves = store.written(before.union(after).where("n > 0"), "halves")
    several = halves.groupBy("half").agg(F.count("*").alias("k"), F.max("lone").alias("open")).where("k > 1 AND open").select("half", (F.col("k") > LARGE).alias("large"))
    several = store.written(several, "shared-halves", narrow=True)
    wanted = store.written(halves.join(several, "half"), "wanted-halves")
    store.drop(halves)
    sorted_ = store.written(sorted_shards(regions(docs, wanted.where("NOT large"), length), length), "sorted-spans", narrow=True)
    spans = whole.union(sorted_)
    if not several.where("large").isEmpty():
        spans = spans.union(keyed_strings(regions(docs, wanted.where("large"), length), length))
    return spans


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes): each text without the bytes in its spans."""
    by_doc = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = keyed(docs).alias("d").join(by_doc.alias("s").hint("shuffle_hash"), F.expr("d.doc_id <=> s.doc_id AND d.text_key = s.text_key"), "left").select("d.doc_id", F.col("d.text").cast("binary").alias("text"), "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, parts, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py() or b""
                left, at, gone, n = [], 0, 0, 0
                if found.is_valid:
                    flat = found.values
                    start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
                    for a, b in zip(start[first].tolist(), end[np.append(first[1:], len(end)) - 1].tolist(), strict=True):
                        left.append(raw[at:a])
                        at, gone, n = b, gone + b - a, n + 1
                left.append(raw[at:])
                sizes.append(len(raw))
                removed.append(gone)
                parts.append(n)
                kept.append(b"".join(left))
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, parts)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept for each row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in another row or its own, overlaps
    included; strings are judged on the input. n_spans counts the maximal runs of removed bytes. Null and empty texts have no
    bytes; shorter texts stay whole; rows that repeat are repeats of each other. What is kept may end within a character, so
    it is bytes. Other columns are ignored.
    """
    return cut(docs, repeated_spans(docs, length, gram))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(store.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
