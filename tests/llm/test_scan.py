import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import scan
from tests.llm import cases

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\tÉ", max_size=30)), max_size=8)


def arrow(rows):
    return pa.array(rows, pa.string())


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_are_those_of_bytes_split(rows):
    data, offsets = scan.text_bytes(arrow(rows))
    starts, ends, first = scan.word_spans(data, offsets, scan.NOT_SPACE)
    raw = data.tobytes()
    found = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert found == [(r or "").encode().split() for r in rows]


@settings(max_examples=60, deadline=None)
@given(texts)
def test_equal_spans_have_equal_hashes_and_others_not(rows):
    data, offsets = scan.text_bytes(arrow(rows))
    starts, ends, _ = scan.word_spans(data, offsets, scan.NOT_SPACE)
    if len(starts):
        names = [data.tobytes()[a:b] for a, b in zip(starts, ends)]
        for hashes in (scan.span_hash(scan.prefix_sums(scan.BYTE_CODES[data]), starts, ends), scan.Spans(data)(starts, ends), scan.Spans(data, 3)(starts, ends), scan.digests(data.data, starts, ends)[0]):
            assert len(set(zip(names, hashes.tolist()))) == len(set(names)) == len(set(hashes.tolist()))


def test_strings_made_to_share_a_hash_share_no_span_hash():
    for n in (1024, 2048, 4096, 8192):
        x = np.frombuffer((cases.thue_morse(n) + cases.thue_morse(n, "ba")).encode(), np.uint8)
        starts, ends = np.array([0, n]), np.array([n, 2 * n])
        a, b = scan.span_hash(scan.prefix_sums(scan.BYTE_CODES[x]), starts, ends)
        assert a == b
        a, b = scan.Spans(x)(starts, ends)
        assert a != b
        symbols = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a, b = scan.Spans(symbols)(starts, ends)
        assert a != b


def test_another_salt_gives_other_hashes():
    x = np.arange(200).astype(np.uint8)
    at = np.arange(100)
    assert not (scan.Spans(x)(at, at + 9) == scan.Spans(x, 1)(at, at + 9)).any()
    assert not (scan.digests(x.data, at, at + 9)[0] == scan.digests(x.data, at, at + 9, 1)[0]).any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 9))
def test_sliding_min_is_the_leftmost_least(values, width):
    v = np.array(values, np.uint64) << np.uint64(40)
    want = [i + int(np.argmin(v[i : i + width])) for i in range(len(v) - width + 1)]
    assert scan.sliding_min(v, width).tolist() == want


def test_slices_keep_all_rows_and_offsets():
    batch = pa.record_batch([pa.array(range(50)), pa.array(["x" * (i % 7) for i in range(50)])], names=["i", "text"])
    got = [b for b in scan.parts(iter([batch.slice(3)]), "text", 10)]
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(3, 50))
    for b in got:
        data, offsets = scan.text_bytes(b.column(1))
        assert len(data) == offsets[-1] == sum(len(t) for t in b.column(1).to_pylist())
