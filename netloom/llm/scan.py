"""Whole-batch text scanning with numpy, for functions run by ``mapInArrow``.

Strings are looked at as UTF-8 bytes in Arrow's own buffers, so a batch of documents costs a few array passes and no
Python object per word. Hashes depend on content alone, never on the place, the batch or the process, and there are two kinds:

* ``prefix_sums`` and ``span_hash``, polynomials modulo 2**64, are cheap, and unlike strings that are made to (Thue-Morse ones)
  share a hash whatever the base. They may only propose: what they join is compared by content before it counts.
* ``Spans``, polynomials over random codes modulo the prime 2**31 - 1 in two bases, have no such strings; two unlike spans
  of n symbols share a hash with a probability of (n / 2**31)**2 at most over the choice of the bases.

``digests`` (128 bits, cryptographic) stand for content where it decides what goes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

# Where the C library can be told (glibc), arrays of up to 4 MB come from memory that the worker keeps, since fresh pages cost
# more than the arithmetic on them; larger ones go back to the system once they are free, and so does what is over 8 MB at
# the end of the heap, so that a worker that has scanned a large batch does not stay large.
if hasattr(_libc := ctypes.CDLL(None), "mallopt"):
    _libc.mallopt(-3, 4 << 20)
    _libc.mallopt(-1, 8 << 20)

U64 = np.uint64
#: Bytes of text that are scanned at once: arrays of a word a byte stay in a core's cache.
CHUNK_BYTES = 1 << 17

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finisher of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of codes[i:j] * base**position, modulo 2**64."""
    out = np.empty(len(codes) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(codes * _power(_BASE, len(codes)), out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of the sequence that ``sums`` was made of; equal content gives equal hashes, and unlike content may too."""
    raw = (sums[ends] - sums[starts]) * _power(_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


_PRIME = U64(2**31 - 1)
_lanes: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A number below 2**33 congruent to x modulo 2**31 - 1."""
    out = x >> U64(31)
    out += x & _PRIME
    return out


def _lane_power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**31 - 1; kept and grown between calls."""
    have = _lanes.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = U64(pow(base, len(have), 2**31 - 1))
        have = np.concatenate((have, have * step % _PRIME))
    _lanes[base] = have
    return have[:n]


@functools.cache
def _lane(lane: int, salt: int) -> tuple[int, np.ndarray]:
    """(base, codes of bytes) of a lane, random by its number and ``salt``."""
    rng = np.random.Generator(np.random.PCG64([20240229, lane, salt]))
    return int(rng.integers(2**20, 2**31 - 2)), rng.integers(1, 2**31 - 1, 256, dtype=np.uint64)


class Spans:
    """Hashes of spans of one sequence: of bytes, or of 64-bit symbols such as the hashes of words. Another salt, other hashes."""

    def __init__(self, symbols: np.ndarray, salt: int = 0) -> None:
        n = len(symbols)
        self.lanes = []
        for lane in range(2):
            base, codes = _lane(lane, salt)
            if symbols.dtype == np.uint8:
                codes = codes[symbols]
            else:
                codes = mix(symbols + U64(2 * salt + lane + 1)) >> U64(33)
            codes = _fold(codes * _lane_power(base, n))
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(codes, out=sums[1:])  # below 2**33 each, so whole for 2**31 symbols
            self.lanes.append((sums, pow(base, -1, 2**31 - 1)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span."""
        out = None
        for sums, inverse in self.lanes:
            raw = _fold(_fold(sums[ends] - sums[starts]))
            raw *= _lane_power(inverse, len(sums))[starts]
            raw = _fold(_fold(raw))
            raw -= np.where(raw >= _PRIME, _PRIME, U64(0))
            out = raw if out is None else (out << U64(31)) | raw
        return mix(out + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def digests(raw: bytes | memoryview, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit cryptographic digest of each span of bytes, as signed words."""
    key = salt.to_bytes(8, "little")
    joined = b"".join([blake2b(raw[a:b], digest_size=16, salt=key).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(joined, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(batch.schema.get_field_index(column)))[1:]
        at, base = 0, 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, upto - at)
            base, at = int(ends[upto - 1]), upto
    pa.default_memory_pool().release_unused()


def offsets_of(column: pa.Array) -> np.ndarray:
    """Ends of each value within the joined bytes, from 0; a null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, kind)
    return raw.astype(np.int64) - int(raw[0])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values joined, offsets of each value in them); a null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    offsets = offsets_of(column)
    if not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    first = int(np.frombuffer(column.buffers()[1], dtype=kind, count=1 + column.offset)[column.offset])
    return np.frombuffer(column.buffers()[2], dtype=np.uint8, count=int(offsets[-1]), offset=first), offsets


def lut(*inside: int | tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is true for the given byte values and inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for x in inside:
        lo, hi = x if isinstance(x, tuple) else (x, x)
        out[lo : hi + 1] = True
    return out


#: Bytes of words split at ASCII white space.
NOT_SPACE = ~lut(0x20, (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words of each text as offsets into the two): maximal runs of ``inside`` bytes; no word crosses texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    is_in = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    opens = is_in.copy()
    opens[1:] &= ~is_in[:-1] | edge[1:n]
    closes = is_in
    closes = closes.copy()
    closes[:-1] &= ~is_in[1:] | edge[1:n]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (by its upper 32 bits, then the leftmost) in each window of ``width`` values."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    packed = (values & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    whole = -(-n // width) * width
    padded = np.full(whole, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & U64(0xFFFFFFFF)).astype(np.int64)


def minimizer_runs(hashes: np.ndarray, ends_of_text: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows that share their minimizer.

    ``hashes``: of the gram of ``gram`` symbols that starts at each symbol of all texts joined; ``ends_of_text``: for each
    symbol, where its text ends. A window is ``window`` symbols of one text; its minimizer, the gram with the least hash
    in it, depends on the window's symbols alone, so equal windows have equal minimizers wherever they stand.
    Returns (first window, windows in the run, place of the minimizer).
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window - gram + 1:
        return none, none, none
    place = sliding_min(hashes, window - gram + 1)
    starts = np.arange(len(place))
    good = np.flatnonzero(starts + window <= ends_of_text[: len(place)])
    if not len(good):
        return none, none, none
    at = place[good]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (good[1:] != good[:-1] + 1))))
    return good[cut], np.diff(np.append(cut, len(good))), at[cut]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
