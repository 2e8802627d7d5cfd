"""Long repeats of words and of bytes against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from netloom.llm import paths, store, suffixes
from tests.llm import cases


def covered(n, starts, size):
    out = [False] * n
    for s in starts:
        out[s : s + size] = [True] * size
    return out


def words_by_force(data, k):
    """Rows (doc_id, words, removed, kept text) by the definition."""
    least = defaultdict(lambda: 2**63 - 1)
    words = [(i, (t or "").encode().split()) for i, t in data]
    rank = lambda i: 2**63 - 1 if i is None else i
    for i, w in words:
        for a in range(len(w) - k + 1):
            least[tuple(w[a : a + k])] = min(least[tuple(w[a : a + k])], rank(i))
    want = Counter()
    for i, w in words:
        gone = covered(len(w), [a for a in range(len(w) - k + 1) if least[tuple(w[a : a + k])] < rank(i)], k)
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    return want


@pytest.mark.parametrize("rows", [0, 200_000])
@pytest.mark.parametrize("k, gram", [(50, 8), (6, 2)])
def test_word_spans(spark, monkeypatch, k, gram, rows):
    monkeypatch.setattr(store, "BROADCAST_ROWS", rows)
    data = cases.rows()
    want = words_by_force(data, k)
    got = Counter(tuple(r) for r in paths.remove_repeats(cases.frame(spark, data), k, gram).select("doc_id", "n_words", "n_removed", "kept_text").collect())
    assert got == want


def test_spans_name_their_source(spark):
    data = cases.rows()
    words = defaultdict(set)
    for i, t in data:
        words[i].add(tuple((t or "").encode().split()))
    rows = paths.repeated_spans(cases.frame(spark, data), 6, 2).collect()
    assert rows
    for r in rows:
        size = r.end - r.start
        mine = {w[r.start : r.end] for w in words[r.doc_id]}
        assert (r.doc_id is None or r.s_rank < r.doc_id) and size >= 6
        assert mine & {w[r.s_start : r.s_start + size] for w in words[r.s_rank]}


def test_word_spans_of_equal_weak_hash_stay_apart(spark):
    data = cases.twins()
    got = Counter(tuple(r) for r in paths.remove_repeats(cases.frame(spark, data)).select("doc_id", "n_words", "n_removed", "kept_text").collect())
    assert got == words_by_force(data, 50)


def test_spans_that_only_share_a_hash_are_found_out(spark, monkeypatch):
    words, salts = paths._words, []

    def weak(batch, column, salt):
        hashes, first = words(batch, column, salt)
        return (hashes & np.uint64(1) if salt == 0 else hashes), first

    verified = paths.verified
    monkeypatch.setattr(paths, "_words", weak)
    monkeypatch.setattr(paths, "verified", lambda docs, spans: salts.append(1) or verified(docs, spans))
    data = cases.rows(n=24)
    got = Counter(tuple(r) for r in paths.remove_repeats(cases.frame(spark, data), 6, 2).select("doc_id", "n_words", "n_removed", "kept_text").collect())
    assert got == words_by_force(data, 6) and len(salts) == 2


def test_paths_are_compacted_to_their_heads(spark):
    # 1 -> 2 -> 3 in a chain of one source, then a fork after 3, and a node whose edges come from two sources
    edges = [(10, 11, 1, 0, 0, 1), (11, 12, 1, 0, 1, 4), (12, 13, 1, 0, 5, 1), (13, 14, 1, 0, 6, 1), (13, 15, 2, 0, 9, 1), (15, 16, 1, 0, 30, 1)]
    found = spark.createDataFrame(edges, "left long, right long, s_rank long, s_key long, s_at int, n int")
    got = {(r.s_rank, r.s_at): (r.head_at, r.head_n) for r in paths.compacted(found).collect()}
    assert got == {(1, 0): (0, 1), (1, 1): (0, 1), (1, 5): (0, 1), (1, 6): (6, 1), (2, 9): (9, 1), (1, 30): (30, 1)}


def test_byte_spans_of_equal_weak_hash_stay_apart(spark):
    data = cases.twins()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(cases.frame(spark, data), 400, 32).collect())
    assert got == bytes_by_force(data, 400)


def bytes_by_force(data, length):
    """Rows (doc_id, bytes, removed, spans, digest of what is kept) by the definition."""
    seen = Counter(b[a : a + length] for _, t in data for b in [(t or "").encode()] for a in range(len(b) - length + 1))
    want = Counter()
    for i, t in data:
        b = (t or "").encode()
        gone = np.array(covered(len(b), [a for a in range(len(b) - length + 1) if seen[b[a : a + length]] > 1], length), bool)
        runs = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        want[i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("length, gram, large", [(400, 32, 16_384), (24, 6, 16_384), (24, 6, 2), (24, 6, 0)])
def test_byte_spans(spark, monkeypatch, length, gram, large):
    monkeypatch.setattr(suffixes, "LARGE", large)
    data = cases.rows()
    want = bytes_by_force(data, length)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(cases.frame(spark, data), length, gram).collect())
    assert got == want


def brute(text, most):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < most and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        common.append(k)
    return order, common


def test_suffix_arrays_with_queues_on_disk_and_recursion(monkeypatch):
    monkeypatch.setattr(suffixes, "MAPPED", 40)
    rng = np.random.default_rng(0)
    for turn in range(400):
        text = rng.integers(1, 1 + rng.integers(1, 5), rng.integers(1, 60))
        if turn % 3 == 0:
            text = np.concatenate((text, text[: len(text) // 2], text))
        text = np.append(text, 0)
        most = int(rng.integers(1, 12))
        order, common = suffixes.suffix_array(text, most, held=int(rng.integers(1, 50)), direct=int(rng.integers(0, 2)) * 100)
        assert (order.tolist(), common.tolist()) == brute(text.tolist(), most)


def test_types_block_by_block():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = np.append(rng.integers(1, 3, rng.integers(1, 30)), 0).astype(np.uint16)
        want = [a == len(text) - 1 or text[a:].tolist() < text[a + 1 :].tolist() for a in range(len(text))]
        assert suffixes.suffix_types(text, int(rng.integers(1, 9))).tolist() == want


def test_empty_tables(spark):
    empty = cases.frame(spark, [])
    assert paths.remove_repeats(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0
