"""Near-duplicate documents and lines against brute force."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import components, jaccard, lines, pigeonhole, store
from tests.llm import cases


class Classes(dict):
    def find(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def distance(a, b):
    """Edits between two byte strings, by the recurrence."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def shingles(text, n):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[a : a + n]) for a in range(max(1, len(words) - n + 1))) if words else frozenset()


def classes_by_force(data, n, percent):
    """Classes over the rows' numbers: links between all pairs of sets."""
    sets = [shingles(t, n) for _, t in data]
    least = Classes((k, k) for k in range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                least.join(a, b)
    return sets, least


def test_unlike_texts_of_equal_weak_hash_stay_apart(spark, monkeypatch):
    data = cases.twins()
    _, least = classes_by_force(data, 4, 85)
    want = {i: least.find(k) for k, (i, _) in enumerate(data)}
    got = {r.doc_id: r.component_id for r in jaccard.classes(cases.frame(spark, data)).collect()}
    assert got == {i: data[k][0] for i, k in want.items()}
    seen, gone = set(), {}
    for i, text in data:
        kept = []
        for line in text.split("\n"):
            if line not in seen:
                kept.append(line)
            seen.add(line)
        gone[i] = "\n".join(kept)
    assert {r.doc_id: r.cut.rstrip("\n") for r in lines.dedup(cases.frame(spark, data), lines.EDITS).collect()} == gone


def test_names_that_clash_are_made_anew(spark, monkeypatch):
    data = cases.rows(n=24)
    right = lines.dedup(cases.frame(spark, data)).select("doc_id", "cut").collect(), jaccard.classes(cases.frame(spark, data)).collect()
    places, sets_of, salts = lines.places, jaccard.sets_of, []
    monkeypatch.setattr(lines, "places", lambda docs, least, salt: salts.append(salt) or (places(docs, least, salt) if salt else places(docs, least, salt).withColumn("line", F.lit(7).cast("long"))))
    monkeypatch.setattr(jaccard, "sets_of", lambda docs, n, percent, salt: salts.append(salt) or (sets_of(docs, n, percent, salt) if salt else sets_of(docs, n, percent, salt).withColumn("set", F.when(F.col("set").isNotNull(), 7).cast("long"))))
    assert sorted(map(str, lines.dedup(cases.frame(spark, data)).select("doc_id", "cut").collect())) == sorted(map(str, right[0]))
    key = lambda rows: sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)
    assert key(jaccard.classes(cases.frame(spark, data)).collect()) == key(right[1])
    assert salts == [0, 1, 0, 1]


def test_places_that_are_many_are_brought_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0)
    data = cases.rows(n=36)
    _, least = classes_by_force(data, 4, 85)
    groups = {}
    for k, (i, _) in enumerate(data):
        groups.setdefault(least.find(k), []).append(k)
    got = jaccard.classes(cases.frame(spark, data))
    assert "ShuffledHashJoin" in store.beside(jaccard.keyed(cases.frame(spark, data)), store.written(jaccard.keyed(cases.frame(spark, data)).groupBy("doc_id", "text_key").agg(F.collect_list("text").alias("t")), "t"), "t")._jdf.queryExecution().executedPlan().toString()
    assert sum(r.component_id == r.doc_id for r in got.collect() if r.doc_id is not None) > 0
    monkeypatch.undo()
    assert sorted(map(str, got.collect())) == sorted(map(str, jaccard.classes(cases.frame(spark, data)).collect()))


@pytest.mark.parametrize("n, percent, small, block", [(4, 85, 16, 1024), (5, 80, 16, 1024), (4, 85, 2, 4), (2, 60, 3, 5)])
def test_jaccard_classes(spark, monkeypatch, n, percent, small, block):
    monkeypatch.setattr(pigeonhole, "SMALL", small)
    monkeypatch.setattr(pigeonhole, "BLOCK", block)
    data = cases.rows(n=72)
    sets, least = classes_by_force(data, n, percent)
    ids = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            ids[least.find(k)] = min(ids.get(least.find(k), i), i)
    want = sorted((str(i), len(sets[k]), str(ids.get(least.find(k)) if sets[k] else i)) for k, (i, _) in enumerate(data))
    largest, segments, _ = jaccard.bands(percent, 6000)
    rng = np.random.default_rng(n)
    swaps = [(b, int(x), v) for b, m in enumerate(segments) for half in [rng.permutation(m)] for k in range(m // 3) for x, v in ((half[2 * k], 0), (half[2 * k + 1], 2))]
    for allocation in (None, tuple(swaps)):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.classes(cases.frame(spark, data), n, percent, allocation).collect())
        assert got == want


def test_costs_move_values_to_deletions(spark):
    rows = [(0, s, 10, 60, [1000 if s < 2 else 3] * jaccard.SIGNS, [1000 if s < 2 else 2000 if s > 7 else 5] * jaccard.SIGNS) for s in range(9)]
    told = spark.createDataFrame(rows, "band int, segment int, entries long, elements long, signs array<long>, both array<long>")
    assert jaccard.allocated(told) == ((0, 0, 0), (0, 1, 0), (0, 6, 2), (0, 7, 2))
    assert jaccard.allocated(told.where("segment > 1")) == ()


def test_bands_cover_all_similar_sizes():
    for percent in (60, 80, 85, 95):
        largest, segments, spare = jaccard.bands(percent, 5000)
        for u, m, e in zip(largest, segments, spare):
            assert m - e - 1 >= 2 * int(u) * (100 - percent) // (100 + percent)


def test_outlines_never_rule_out_similar_sets():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**62, rng.integers(1, 200)).astype(np.uint64))
        keep = x[rng.random(len(x)) < 0.93]
        y = np.unique(np.concatenate((keep, rng.integers(0, 2**62, rng.integers(0, 9)).astype(np.uint64))))
        if len(y) and jaccard.similar([x.tobytes()], [y.tobytes()], 80)[0]:
            assert jaccard.may_be_similar([jaccard.outline(x)], [jaccard.outline(y)], 80)[0]


def test_edit_distance_kernel():
    rng = np.random.default_rng(1)
    for edits in (1, 2, 4):
        a, b = [], []
        for _ in range(400):
            x = list(rng.integers(97, 100, rng.integers(1, 50)))
            y = list(x)
            for _ in range(rng.integers(0, edits + 3)):
                p = int(rng.integers(0, len(y) + 1))
                if rng.random() < 0.4:
                    y.insert(p, 97)
                elif p < len(y):
                    y.pop(p) if rng.random() < 0.5 else y.__setitem__(p, 98)
            a.append(np.array(x, np.uint8))
            b.append(np.array(y, np.uint8))
        full = [i for i in range(len(a)) if len(a[i]) and len(b[i])]
        found = lines.close_lines([a[i].tobytes() for i in full], [b[i].tobytes() for i in full], edits)
        assert found.tolist() == [lines._plain(a[i], b[i]) <= edits for i in full]
        want = [lines._plain(x, y) <= edits for x, y in zip(a, b)]
        assert lines.within(a, b, edits).tolist() == want


@pytest.mark.parametrize("edits, least, small", [(2, 40, 16), (1, 8, 2), (2, 5, 2)])
def test_line_dedup(spark, monkeypatch, edits, least, small):
    monkeypatch.setattr(pigeonhole, "SMALL", small)
    data = cases.rows(n=48)
    places = []
    for k, (i, text) in enumerate(data):
        at = 0
        for line in (text or "").encode().split(b"\n"):
            if len(line) >= least:
                places.append(((i is None, i or 0), k, at, line))
            at += len(line) + 1
    names = sorted({p[3] for p in places})
    tied = Classes((x, x) for x in names)
    for a in range(len(names)):
        for b in range(a):
            if abs(len(names[a]) - len(names[b])) <= edits and distance(names[a], names[b]) <= edits:
                tied.join(names[a], names[b])
    first = {}
    for order, k, at, line in places:
        root = tied.find(line)
        first[root] = min(first.get(root, (order, at)), (order, at))
    want = []
    for k, (i, text) in enumerate(data):
        gone = {at for order, j, at, line in places if j == k and (order, at) != first[tied.find(line)]}
        at, kept, every = 0, "", (text or "").split("\n")
        for k_, line in enumerate(every):
            if at not in gone:
                kept += line + "\n" * (k_ + 1 < len(every))  # a line goes with its own break
            at += len(line.encode()) + 1
        want.append((str(i), len(every) if text else 0, len(gone), str(text if text is None else kept)))
    got = lines.dedup(cases.frame(spark, data), edits, least)
    assert set(got.columns) == {"doc_id", "n_lines", "n_removed", "cut", "row"}
    rows = got.collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, str(r.cut)) for r in rows) == sorted(want)
    for r in rows:
        assert (r.cut is None) == (r.row.text is None)
        if r.n_removed == 0:
            assert r.cut == r.row.text


def test_short_lines_are_judged(spark):
    a, b = "a line of some thirty bytes ok", "a line that is longer than forty bytes, so two"
    data = [(1, f"Of.\n{a}\n{b}\n  \n"), (2, f"On.\n{a[:-2]}OK\n{b[:-3]}six\nOf."), (3, f"{a[:-1]}x\n  \n\nOf.\n{b[:-3]}too\nOn"), (4, f"Of.\n{a}\n{b}\n  \n"), (None, "Of.\n\u00e9\n\u00e9\n\t")]
    got = {r.doc_id: r.cut for r in lines.dedup(cases.frame(spark, data)).collect()}
    assert got == {1: data[0][1], 2: f"On.\n{a[:-2]}OK\n{b[:-3]}six\n", 3: "  \n\nOn", 4: "  \n", None: "\u00e9\n\t"}


def test_lines_of_graded_distance_against_brute_force(spark):
    rng = np.random.default_rng(8)
    names = []
    for length in (1, 2, 3, 10, 18, 19, 20, 21, 22, 38, 39, 40, 41, 42, 60):
        base = rng.integers(97, 123, length)
        for _ in range(8):
            x = list(base)
            for _ in range(rng.integers(0, 4)):
                p = int(rng.integers(0, len(x))) if x else 0
                x[p : p + int(rng.integers(0, 2))] = [97] * int(rng.integers(0, 2))
            names.append(bytes(np.array(x, np.uint8)))
    data = [(i, x.decode()) for i, x in enumerate(names)]
    least = Classes((k, k) for k in range(len(names)))
    for i, x in enumerate(names):
        for j, y in enumerate(names[:i]):
            short = min(len(x), len(y))
            edits = 2 if short >= 40 else 1 if short >= 20 else 0
            if short and lines._plain(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= edits:
                least.join(i, j)
    want = {i for i, x in enumerate(names) if x and least.find(i) != i}
    assert len(want) > 20
    assert {r.doc_id for r in lines.dedup(cases.frame(spark, data)).collect() if r.n_removed} == want


@pytest.mark.parametrize("one_task", [0, 300_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 50), (60, 70), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.roots(links).collect()}
    assert got == {i: 1 for i in range(2, 31)} | {60: 50, 70: 50}


def test_empty_tables(spark):
    empty = cases.frame(spark, [])
    assert jaccard.classes(empty).count() == 0
    assert lines.dedup(empty).count() == 0


@pytest.mark.parametrize("block", [16, 1 << 15])
def test_large_families_are_compared_without_copies_of_their_items(spark, monkeypatch, block):
    monkeypatch.setattr(pigeonhole, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, i // 3, int(rng.integers(10, 14)), rng.choice(40, 3, replace=False).tolist()) for i in range(150)]
    members = spark.createDataFrame(rows, "item long, root long, size int, segments array<long>")
    contents = spark.createDataFrame([(i, bytes([i % 7])) for i in range(150)], "item long, content binary")
    written, tables = [], store.written
    monkeypatch.setattr(store, "written", lambda *x, **y: written.append(tables(*x, **y)) or written[-1])
    counted = []
    monkeypatch.setattr(store, "drop", lambda *x: counted.extend(t.count() for t in x))
    close = lambda x, y: np.abs(x - y) <= 1
    linked = lambda x, y: np.array([bytes(a) == bytes(b) for a, b in zip(x, y)], bool)
    got = sorted(tuple(sorted(r)) for r in pigeonhole.across(members, contents, close, linked).collect())
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and abs(a[2] - b[2]) <= 1 and set(a[3]) & set(b[3]) and a[0] % 7 == b[0] % 7]
    assert got == want and len(want) > 50
    assert counted[0] == len(rows) and sum(counted) == len(rows) + len(want)
    if block < len(rows):
        assert len(written) > 5


@pytest.mark.parametrize("held, gathered", [(1 << 20, 1 << 19), (20, 50)])
def test_index_entries_go_in_blocks_and_none_is_lost(monkeypatch, held, gathered):
    for name, value in (("HELD", held), ("GATHERED", gathered), ("IN_BLOCK", 8), ("BITS", 2), ("SMALL", 3)):
        monkeypatch.setattr(pigeonhole, name, value)
    rng = np.random.default_rng(4)
    segment = np.concatenate((rng.integers(-60, 60, 500) * (1 << 56), np.full(300, 5 << 56), np.full(90, 6 << 56)))
    item, size = np.arange(len(segment)), rng.choice([-9, 9], len(segment))
    order = rng.permutation(len(segment))
    found = [pigeonhole.entries(segment[x], item[x], size[x]) for x in np.array_split(order, 9)]
    sent = list(pigeonhole.blocks(iter(found)))
    assert sum(x.num_rows for x in sent) < len(segment) / 2
    table = pa.Table.from_batches(sent).sort_by("bucket").combine_chunks()
    assert table.schema.names == ["bucket", "segment", "item", "size"]
    met = pigeonhole._met(iter(table.to_batches(max_chunksize=5)), lambda x, y: x == y)
    rows = [SimpleNamespace(**x) for batch in met for x in batch.to_pylist()]
    groups = {}
    for s, i in zip(segment.tolist(), item.tolist()):
        groups.setdefault(s, []).append(i)
    small = {(s, a, b) for s, g in groups.items() if 1 < len(g) <= 3 for a in g for b in g if a < b and max(size[a], size[b]) > 0}
    got = [(r.segment, min(r.a, r.b), max(r.a, r.b)) for r in rows if not r.pivot]
    assert sorted(got) == sorted(small)
    for s, g in groups.items():
        mine = [r for r in rows if r.pivot and r.segment == s]
        if len(g) > 3:
            assert sorted(r.b for r in mine) == g and len({r.a for r in mine}) == 1 and mine[0].a in g
            assert all((r.size_a, r.size_b) == (size[r.a], size[r.b]) for r in mine)
        else:
            assert not mine


def test_lines_compared_one_by_one_as_by_the_recurrence():
    rng = np.random.default_rng(6)
    for _ in range(1500):
        x = list(rng.integers(97, 100, rng.integers(0, 14)))
        y = list(x)
        for _ in range(rng.integers(0, 5)):
            p = int(rng.integers(0, len(y) + 1))
            y[p : p + int(rng.integers(0, 2))] = [98] * int(rng.integers(0, 2))
        a, b = np.array(x, np.uint8), np.array(y, np.uint8)
        assert [lines.reaches(a, b, e) for e in range(4)] == [lines._plain(a, b) <= e for e in range(4)]


def test_lines_are_found_whatever_stands_between_them():
    texts = ["", None, "\n", " \t\n x\n\n", "ab\n  \nc", "\n\n", "é\nlast", "", "  ", "one\n"]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    for least in (1, 2, 3):
        data, start, end, owner = lines._judged_lines(batch, 0, least)
        want = [(k, x) for k, t in enumerate(texts) for x in (t or "").encode().split(b"\n") if x.strip() and len(x) >= least]
        assert [(int(k), data[a:b].tobytes()) for a, b, k in zip(start, end, owner)] == want
