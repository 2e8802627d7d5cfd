import hashlib
import re

import pytest

from netloom.llm import decontam
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 200_000 if broadcast else 0)
    data = cases.rows()
    items = [(1, " ".join(f"P{i}" for i in range(5, 40))), (2, "short item"), (3, None), (4, "!!"), (10, "one"), (20, data[1][1].upper()), (20, "p9 p10 p11"), (31, "Éin ärger mit ßeltsamen ZEICHEN")]
    data = [*data, (700, "a SHORT, item! here"), (701, "é ÉIN ärger mit ßeltsamen zeichen"), (702, "Éin Ärger MIT")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for i, t in items:
        w = words(t)
        if w:
            found += [(str(i), tuple(w[a : a + 13])) for a in range(max(1, len(w) - 12))]
    want = []
    for i, t in data:
        w = words(t)
        hit, held = set(), set()
        for item, x in found:
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit.update(range(a, a + len(x)))
                    held.add(item)
        want.append((str(i), len(w), len(hit), ",".join(sorted(held)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    out = decontam.contamination(cases.frame(spark, data), benchmark)
    got = [(str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in out.collect()]
    assert sorted(got) == sorted(want)


def test_main_path_is_native(spark):
    plan = decontam.contamination(cases.frame(spark, cases.rows()), spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables_and_the_digest(spark, tmp_path):
    empty = spark.createDataFrame([], "item_id long, text string")
    out = decontam.contamination(cases.frame(spark, cases.rows()), empty)
    assert out.where("contaminated OR n_hit > 0").count() == 0 and out.count() == len(cases.rows())
    assert decontam.contamination(cases.frame(spark, []), empty).count() == 0
    cases.frame(spark, cases.rows()).write.parquet(str(tmp_path / "documents.parquet"))
    empty.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.items_sha256 for r in decontam.query(spark, str(tmp_path)).collect()} == {hashlib.sha256(b"").hexdigest()}
