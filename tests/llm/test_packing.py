import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netloom.llm import packing
from tests.llm import cases


def whole():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizer():
    rnd = random.Random(3)
    tokenizer = whole()
    alphabet = [chr(c) for c in range(1, 0x250)] + list("  \n\n\t ' 's 're 12 345") + ["<|endoftext|>", "漢", "🙂", " ", "\xa0", "\x85"]
    for _ in range(400):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))
        assert packing.token_ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plans_hold_all_pieces_and_waste_little(lengths):
    histogram = Counter(lengths)
    plan = packing.best_two_fit(histogram, 40)
    used = Counter()
    for p in plan:
        assert sum(p.lengths) <= 40
        for x in p.lengths:
            used[x] += p.repeat
    assert used == histogram
    bins = sum(p.repeat for p in plan)
    least = max(-(-sum(lengths) // 40), sum(x > 20 for x in lengths))  # two of more than half a bin never share one
    assert bins <= 11 * least / 9 + 1


def test_two_that_fit_tighter_replace_the_smallest():
    # 6 + 3 leaves 1; in place of 3, 2 + 2 fit the gap of 4 wholly
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0].lengths == (6, 2, 2)


def test_pack_is_an_exact_round_trip(spark):
    data = cases.rows() + [(900, "long " * 7000)]
    out = packing.pack(cases.frame(spark, data)).collect()
    tokenizer = whole()
    want = Counter()
    for i, text in data:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    filled = defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= -(-sum(r.length for r in out) // 2048) + 1


def test_ranks_without_gaps_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    df = spark.createDataFrame([(i, 0, 0, 5 if i % 3 else 9, i) for i in range(100)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    by = defaultdict(list)
    for r in packing.ranked(df).collect():
        by[r.length].append(r["rank"])
    assert {k: sorted(v) for k, v in by.items()} == {5: list(range(66)), 9: list(range(34))}


def test_empty_table(spark):
    assert packing.pack(cases.frame(spark, [])).count() == 0
